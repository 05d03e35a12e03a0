"""Exact top-k inner products by a dual-tree search over two cover trees."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import Scratch, blobs

SCALE = 1024
ROWS, QUERIES, GROUPS, SAMPLE = 16384, 4096, 256, 8192  # rows and queries of a block, most groups of each, rows that choose their centres
LEAF, WIDTH, BASE, TILE = 256, 48, 1.3, 1024
HUGE = 1e100  # beyond it a group's ceiling says nothing
EXACT = 2.0**53
LONG = np.iinfo(np.int64)


class CoverTree:
    """Vectors under nested balls: each node has a centre, a radius that covers all its members, and children or members.

    Children's centres are chosen farthest first until all members lie within radius / BASE of one, so they are apart and
    cover; a node that would need more than WIDTH children gets that many, and its farther members wait for the next level.
    Bounds use the radii as measured, so they hold either way.
    """

    def __init__(self, x: np.ndarray):
        self.x, self.order = x, np.arange(len(x))
        centre, radius, span, kids = [], [], [], []

        def add(start: int, stop: int, of: np.ndarray, far: float) -> int:
            centre.append(of)
            radius.append(far)
            span.append((start, stop))
            kids.append((0, 0))
            return len(centre) - 1

        mean = np.floor(x.mean(0))
        open_ = [(add(0, len(x), mean, float(np.sqrt(((x - mean) ** 2).sum(1).max()))))]
        while open_:
            node = open_.pop()
            (start, stop), far = span[node], radius[node]
            if stop - start <= LEAF or far == 0:
                continue
            rows = self.order[start:stop]
            y = x[rows]
            gap = ((y - centre[node]) ** 2).sum(1)
            first = int(gap.argmin())
            best, whose, centres = ((y - y[first]) ** 2).sum(1), np.zeros(len(y), np.int64), [first]
            while len(centres) < WIDTH and best.max() > (far / BASE) ** 2:
                nxt = int(best.argmax())
                d = ((y - y[nxt]) ** 2).sum(1)
                closer = d < best
                best[closer], whose[closer] = d[closer], len(centres)
                centres.append(nxt)
            if len(centres) == 1:  # the centre alone covers: the same members within a smaller radius
                centre[node], radius[node] = y[first], float(np.sqrt(best.max()))
                open_.append(node)
                continue
            by = np.argsort(whose, kind="stable")
            self.order[start:stop] = rows[by]
            cut = start + np.searchsorted(whose[by], np.arange(len(centres) + 1))
            begin = len(centre)
            for k, c in enumerate(centres):
                mine = best[by[cut[k] - start : cut[k + 1] - start]]
                open_.append(add(int(cut[k]), int(cut[k + 1]), y[c], float(np.sqrt(mine.max()))))
            kids[node] = (begin, len(centre))
        self.centre, self.kids = np.array(centre), np.array(kids)
        self.radius = np.array(radius) * (1 + 1e-9)
        self.norm = np.sqrt((self.centre**2).sum(1)) * (1 + 1e-9)
        self.span = np.array(span)


def ceiling(a: CoverTree, i: np.ndarray | int, b: CoverTree, j: np.ndarray | int) -> np.ndarray:
    """At least the inner product of any members of nodes i and j: that of the centres, and what both radii may add."""
    added = a.norm[i] * b.radius[j] + a.radius[i] * b.norm[j] + a.radius[i] * b.radius[j]
    return (a.centre[i] * b.centre[j]).sum(-1) + added + 1e-9 * (a.norm[i] * b.norm[j] + added) + 1e-6


class Best:
    """The k best (score, id) of each query, ties to the smaller id, and the worst of them."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.score, self.id = np.full((n, k), -np.inf), np.full((n, k), LONG.max)
        self.floor = np.full(n, -np.inf) if floor is None else floor

    def worst(self, rows: np.ndarray) -> float:
        return float(np.maximum(self.score[rows, -1], self.floor[rows]).min())

    def take(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        score = np.where(own[:, None] == ids, -np.inf, score)
        better = np.flatnonzero((score >= np.maximum(self.score[rows, -1], self.floor[rows])[:, None]).any(1) & (score > -np.inf).any(1))
        if len(better):
            r, k = rows[better], self.score.shape[1]
            s = np.concatenate([self.score[r], score[better]], 1)
            i = np.concatenate([self.id[r], np.broadcast_to(ids, (len(r), len(ids)))], 1)
            i = np.where(s == -np.inf, LONG.max, i)
            o = np.lexsort((i, -s), axis=1)[:, :k]
            self.score[r], self.id[r] = np.take_along_axis(s, o, 1), np.take_along_axis(i, o, 1)


def search(queries: np.ndarray, own: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> Best:
    """The k largest inner products of each query with rows of data whose id isn't its own; scores under a query's floor may be missing.

    Both sides stand in trees. A pair of nodes is left out if its ceiling lies under the worst kth score of the query node's
    members; the query side is divided down to its leaves, and a leaf meets data nodes in order of their ceilings.
    """
    best = Best(len(queries), k, floor)
    if not len(queries) or not len(data):
        return best
    q, d = CoverTree(queries), CoverTree(data)

    def members(t: CoverTree, node: int) -> np.ndarray:
        return t.order[t.span[node, 0] : t.span[node, 1]]

    stack: list[tuple[int, np.ndarray]] = [(0, np.zeros(1, np.int64))]
    while stack:
        node, others = stack.pop()
        rows = members(q, node)
        if q.kids[node, 1]:
            # data nodes wider than this query node are divided first, then this node's children go on with those left
            while True:
                others = others[ceiling(q, node, d, others) >= best.worst(rows)]
                wide = (d.radius[others] > q.radius[node]) & (d.kids[others, 1] > 0)
                if not wide.any():
                    break
                others = np.concatenate([others[~wide], *(np.arange(a, b) for a, b in d.kids[others[wide]])])
            stack += [(int(c), others) for c in range(*q.kids[node])]
            continue
        heap = [(-b, int(o)) for b, o in zip(ceiling(q, node, d, others).tolist(), others.tolist(), strict=True)]
        heapq.heapify(heap)
        while heap and -heap[0][0] >= best.worst(rows):
            other = heapq.heappop(heap)[1]
            a, b = d.kids[other]
            if b:
                kids = np.arange(a, b)
                for bound, o in zip(ceiling(q, node, d, kids).tolist(), kids.tolist(), strict=True):
                    heapq.heappush(heap, (-bound, o))
            else:
                at = members(d, other)
                for i in range(0, len(rows), TILE):  # equal vectors may make a large leaf
                    for j in range(0, len(at), TILE):
                        some, mine = at[j : j + TILE], rows[i : i + TILE]
                        best.take(mine, queries[mine] @ data[some].T, ids[some], own[mine])
    return best


def whole(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) as doubles that hold whole numbers; infinite where that is beyond a double."""
    with np.errstate(over="ignore"):
        return np.floor(SCALE * x)


def exact_search(queries: np.ndarray, own: np.ndarray, data: np.ndarray, ids: np.ndarray, k: int) -> tuple[list[list[int]], list[list[int]]]:
    """As search, from raw vectors and in whole numbers of any size, for vectors too large for sums in doubles. Scores end at a long's limits."""
    number = np.vectorize(lambda v: int(v) * SCALE if abs(v) >= EXACT else math.floor(v * SCALE), otypes=[object])
    n, m = number(queries), number(data)
    scores, names = [], []
    for row, me in zip(n, own.tolist(), strict=True):
        found = heapq.nsmallest(k, ((-s, i) for s, i in zip(m.dot(row).tolist(), ids.tolist(), strict=True) if i != me))
        scores.append([int(min(max(-s, LONG.min), LONG.max)) for s, _ in found])
        names.append([i for _, i in found])
    return scores, names


def _array(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(len(column), -1)


def _grouped(centres: np.ndarray, width: int):
    """Rows padded to one width, each with its nearest centre and its distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = batch.slice(i, 2048)
                x = np.zeros((len(part), width))
                for r, v in zip(x, part.column(2).to_pylist(), strict=True):
                    r[: len(v)] = v
                y = np.clip(whole(x), -HUGE, HUGE)
                d = ((y**2).sum(1)[:, None] - 2 * y @ centres.T) + (centres**2).sum(1)
                near = d.argmin(1)
                far = np.sqrt(((y - centres[near]) ** 2).sum(1)) * (1 + 1e-9)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), blobs([r.tobytes() for r in x]), pa.array(near.astype(np.int32)), pa.array(far), pa.array(np.abs(y).max(1, initial=0.0))], names=["row", "id", "x", "part", "far", "most"])

    return run


def _centres(rows: DataFrame, groups: int, width: int) -> np.ndarray:
    """Centres of groups, chosen farthest first from a bounded sample; which vectors are drawn changes the work, not the result."""
    got = rows.orderBy(F.xxhash64(F.lit(5), "row"), "row").limit(SAMPLE).select("e").collect()
    x = np.zeros((len(got), width))
    for r, v in zip(x, got, strict=True):
        r[: len(v.e)] = v.e
    x = np.clip(whole(x), -HUGE, HUGE)
    first = np.floor(x.mean(0))
    picked, best = [first], ((x - first) ** 2).sum(1)
    while len(picked) < groups and best.max() > 0:
        picked.append(x[int(best.argmax())])
        best = np.minimum(best, ((x - picked[-1]) ** 2).sum(1))
    return np.array(picked)


def _compare(k: int):
    """Each pair of a block of queries and a block of data, held at once: both are bounded."""

    def work(t: pa.Table) -> pa.RecordBatch:
        side = t.column("query").to_numpy()
        x, ids, row, floor = _array(t.column("x").combine_chunks()), t.column("id").to_numpy(), t.column("row").to_numpy(), t.column("floor").to_numpy()
        q, d = np.flatnonzero(side), np.flatnonzero(~side)
        most = np.abs(whole(x)).max(1, initial=0.0)
        rows, found, scores = [], [], []
        if len(q) and len(d):
            if most[q].max() * most[d].max() * x.shape[1] < EXACT:
                best = search(whole(x[q]), ids[q], whole(x[d]), ids[d], k, floor[q])
                at, pos = np.nonzero(best.score > -np.inf)
                rows, found, scores = row[q][at], best.id[at, pos], best.score[at, pos].astype(np.int64)
            else:
                some, names = exact_search(x[q], ids[q], x[d], ids[d], k)
                rows = np.repeat(row[q], [len(s) for s in some])
                found, scores = [i for s in names for i in s], [v for s in some for v in s]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found, pa.int64()), pa.array(scores, pa.int64())], names=["row", "vec", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = np.stack([batch.column(n).to_numpy() for n in ("i", "j")])
            cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), len(batch)]
            for a, b in zip(cut, cut[1:], strict=False):
                if a == b:
                    continue
                now = tuple(key[:, a])
                if held and now != last:
                    yield work(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last = now
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def top_k(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of the largest inner products with each query row, ties to the smaller id.

    Components x count as floor(1024 * x) in double precision; scores are whole numbers and exact. Queries are the rows for
    which the column `is_query` holds; candidates are all rows but those of the query's own id.

    Rows are grouped by the nearest of a bounded number of centres and cut into blocks of bounded size; a pair of blocks
    meets in one task as two cover trees. First each query block meets the data group of the highest ceiling, which gives
    each query a floor; of the other pairs of groups, those whose ceiling lies under the worst floor are left out.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without an id. Shorter vectors
    count as padded with zeros; an empty one scores 0 with all. Queries that repeat an id are answered each, candidates that
    repeat one are listed each. Sums beyond 2**53 are taken in whole numbers of any size; scores end at a long's limits.
    Fewer than k candidates: all of them. An empty table gives an empty result. Other columns are not read.
    """
    spark = ship(vectors.sparkSession)
    scratch = Scratch(spark)
    e = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    fine = F.col(id_col).isNotNull() & F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(fine, e).alias("e"), F.coalesce(is_query, F.lit(False)).alias("query")).filter("e is not null")
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()))
    count, asked, width = rows.agg(F.count("*"), F.count_if("query"), F.max(F.size("e"))).first()
    width = max(width or 1, 1)
    sides = {}
    for name, test, n, block in (("d", F.lit(True), count, ROWS), ("q", F.col("query"), asked, QUERIES)):
        mine = rows.filter(test)
        centres = _centres(mine, min(GROUPS, max(1, math.ceil(n / block))), width) if n else np.zeros((1, width))
        parts = scratch.save(mine.select("row", "id", "e").mapInArrow(_grouped(centres, width), "row long, id long, x binary, part int, far double, most double"))
        stats = {r["part"]: r for r in parts.groupBy("part").agg(F.count("*").alias("n"), F.max(F.when(F.col("most") >= HUGE, F.lit(float("inf"))).otherwise(F.col("far"))).alias("far")).collect()}  # at most GROUPS rows
        blocks = F.lit(1)
        for part, r in stats.items():
            blocks = F.when(F.col("part") == part, math.ceil(r["n"] / block)).otherwise(blocks) if r["n"] > block else blocks
        sides[name] = (parts.withColumn("block", F.pmod(F.xxhash64("row"), blocks).cast("int")), centres, stats, {p: math.ceil(r["n"] / block) for p, r in stats.items()})
    (queries, qc, qs, qb), (data, dc, ds, db) = sides["q"], sides["d"]
    schema = "i long, j long, query boolean, row long, id long, x binary, floor double"

    def bound(p: int, r: int) -> float:
        if math.isinf(qs[p]["far"]) or math.isinf(ds[r]["far"]):
            return math.inf
        a, b = np.sqrt((qc[p] ** 2).sum()), np.sqrt((dc[r] ** 2).sum())
        return float((qc[p] @ dc[r] + a * ds[r]["far"] + b * qs[p]["far"] + qs[p]["far"] * ds[r]["far"]) * (1 + 1e-9) + 1e-9 * a * b + 1)

    def compared(pairs: list[tuple[int, int]], floors: DataFrame | None) -> DataFrame:
        """Blocks of each pair of groups meet; a block's number stands above its group's, of which there are GROUPS at most."""
        q = queries if floors is None else queries.join(floors, "row", "left")
        q = q.withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))) if floors is not None else F.lit(float("-inf")))
        table = spark.createDataFrame(pairs, "p int, r int")
        mates = table.withColumn("qblocks", _looked_up("p", qb)).withColumn("dblocks", _looked_up("r", db))
        number = lambda part, block: F.col(block).cast("long") * GROUPS + F.col(part)
        left = q.join(F.broadcast(mates), F.col("part") == F.col("p")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("dblocks") - 1)))
        left = left.select(number("part", "block").alias("i"), number("r", "other").alias("j"), F.lit(True).alias("query"), "row", "id", "x", "floor")
        right = data.join(F.broadcast(mates), F.col("part") == F.col("r")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("qblocks") - 1)))
        right = right.select(number("p", "other").alias("i"), number("part", "block").alias("j"), F.lit(False).alias("query"), "row", "id", "x", F.lit(float("-inf")).alias("floor"))
        met = left.unionAll(right).select(*schema.replace(" long", "").replace(" boolean", "").replace(" binary", "").replace(" double", "").split(", "))
        return met.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(_compare(k), "row long, vec long, score long")

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("row").orderBy(F.desc("score"), "vec")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    first = [(p, max(ds, key=lambda r: (ds[r]["n"] > k, bound(p, r)))) for p in qs] if ds else []
    found = scratch.save(best(compared(first, None)).drop("rank")) if first else spark.createDataFrame([], "row long, vec long, score long")
    floors = found.groupBy("row").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("floor")).filter(F.col("n") >= k).drop("n")
    worst = {r["part"]: r["worst"] for r in queries.select("row", "part").join(floors, "row", "left").groupBy("part").agg(F.min(F.coalesce("floor", F.lit(float("-inf")))).alias("worst")).collect()}  # at most GROUPS rows
    rest = [(p, r) for p in qs for r in ds if (p, r) not in set(first) and bound(p, r) >= worst[p]]
    if rest:
        found = found.unionAll(compared(rest, floors))
    named = rows.filter("query").select("row", F.col("id").alias("query_id"))
    return best(found).join(named, "row").select("query_id", F.col("rank").cast("int").alias("rank"), F.col("vec").alias("vec_id"), "score")


def _looked_up(column: str, table: dict[int, int]):
    """A number of each group, of which there are GROUPS at most."""
    out = F.lit(1)
    for key, value in table.items():
        out = F.when(F.col(column) == key, value).otherwise(out) if value > 1 else out
    return out


ORACLE = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10"""
