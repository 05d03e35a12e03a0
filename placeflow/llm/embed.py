"""Embedding near-duplicates by cross-polytope hashing after fast Hadamard rotations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, blobs
from .components import connected_components

TABLES, HASHES, PROBES, BLOCK = 16, 3, 4, 128
ROWS, SMALL, PAIRS = 8192, 64, 1 << 14


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, in d log d steps; d is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], 2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1. They are scaled by their largest component first, so that no square over- or underflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes(x: np.ndarray) -> np.ndarray:
    """Buckets of each row: rows x TABLES x PROBES numbers of 31 bits, its own first.

    A hash is the nearest of the 2d signed axes after three rounds of random signs and a transform. A table
    joins HASHES of them; each probe moves one hash to its second nearest axis.
    """
    n, d = x.shape
    rng = np.random.default_rng(d)
    signs = rng.choice([-1.0, 1.0], (TABLES, HASHES, 3, d))
    out = np.zeros((n, TABLES, PROBES), np.int32)
    rows = np.arange(n)
    for t in range(TABLES):
        near = np.zeros((HASHES, 2, n), np.uint64)
        for k in range(HASHES):
            y = x
            for r in range(3):
                y = hadamard(y * signs[t, k, r])
            far = np.abs(y)
            for m in range(2):
                axis = far.argmax(1)
                near[k, m] = 2 * axis + (y[rows, axis] < 0)
                far[rows, axis] = -1
        for p in range(PROBES):
            key = np.zeros(n, np.uint64)
            for k in range(HASHES):
                key = key * np.uint64(2 * d) + near[k, int(p == k + 1)]
            out[:, t, p] = (K.mix(key) >> np.uint64(33)).astype(np.int32)
    return out


def _rows(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        at = column.offsets.to_numpy()[:-1][rows] - column.offsets[0].as_py()
        out[rows, :d] = flat[at[:, None] + np.arange(d)]
    return out


def _hashed(width: int):
    """Unit vectors and their buckets, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.slice(i, 1024)
                x = unit(_rows(part.column(1), width))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), blobs([r.tobytes() for r in x]), blobs([r.tobytes() for r in codes(x)])], names=["node", "copies", "x", "codes"])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per vector and bucket."""
    for batch in batches:
        for i in range(0, len(batch), 2048):
            part = batch.slice(i, 2048)
            c = np.frombuffer(b"".join(part.column(1).to_pylist()), np.int32).reshape(-1, TABLES, PROBES).astype(np.int64) + (np.arange(TABLES) << 32)[:, None]
            node = np.repeat(part.column(0).to_numpy(), TABLES * PROBES)
            own = np.tile(np.arange(PROBES) == 0, len(part) * TABLES)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(c.ravel()), pa.array(own)], names=["node", "bucket", "own"])


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first bucket, table * 2**32 + code, that both rows of buckets share and that is one's own."""
    out = np.full(len(a), np.iinfo(np.int64).max)
    for t in range(TABLES - 1, -1, -1):
        found = np.full(len(a), np.iinfo(np.int64).max)
        for i in range(PROBES):
            for j in range(PROBES):
                if i == 0 or j == 0:
                    hit = a[:, t, i] == b[:, t, j]
                    found[hit] = np.minimum(found[hit], a[hit, t, i].astype(np.int64) + (t << 32))
        out = np.where(found < np.iinfo(np.int64).max, found, out)
    return out


def _compare(width: int, least: float):
    """Links of each (bucket, i, j): counts by member, and a spanning forest, not the pairs. Many small groups are compared at once."""

    def inside(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of rows of each of many groups."""
        within = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        row = np.repeat(starts, sizes) + within
        partners = np.repeat(sizes, sizes) - 1 - within
        a = np.repeat(row, partners)
        return a, a + 1 + np.arange(partners.sum()) - np.repeat(np.cumsum(partners) - partners, partners)

    def work(t: pa.Table) -> pa.RecordBatch:
        bucket, i, j, block, node, copies = (t.column(n).to_numpy() for n in ("bucket", "i", "j", "block", "node", "copies"))
        x = np.frombuffer(b"".join(t.column("x").to_pylist())).reshape(len(t), width)
        c = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.int32).reshape(len(t), TABLES, PROBES)
        starts = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        sizes = np.diff(np.r_[starts, len(t)])
        small = (i == j)[starts] & (sizes <= SMALL)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        a, b = inside(starts[small], sizes[small])
        for k in range(0, len(a), PAIRS):
            p, q = a[k : k + PAIRS], b[k : k + PAIRS]
            close = np.einsum("nd,nd->n", x[p], x[q]) >= least
            found.append((p[close], q[close]))
        for start, size in zip(starts[~small], sizes[~small], strict=True):
            rows = np.arange(start, start + size)
            same = i[start] == j[start]
            left, right = (rows, rows) if same else (rows[block[rows] == i[start]], rows[block[rows] != i[start]])
            for k in range(0, len(left), BLOCK):
                p, q = np.nonzero(x[left[k : k + BLOCK]] @ x[right].T >= least)
                p, q = left[k : k + BLOCK][p], right[q]
                found.append((p[p < q], q[p < q]) if same else (p, q))
        a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        own = np.zeros(len(a), bool)
        for k in range(0, len(a), PAIRS):  # each pair counts in its first bucket only
            own[k : k + PAIRS] = _first_common(c[a[k : k + PAIRS]], c[b[k : k + PAIRS]]) == bucket[a[k : k + PAIRS]]
        a, b = a[own], b[own]
        n, root = np.zeros(len(t), np.int64), np.arange(len(t))
        np.add.at(n, a, copies[b])
        np.add.at(n, b, copies[a])
        while True:  # least labels spread along the links, which stay inside a group
            before = root.copy()
            low = np.minimum(root[a], root[b])
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
            if np.array_equal(before, root):
                break
        some = np.flatnonzero(n)
        return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(n[some]), pa.array(node[root[some]])], names=["node", "n", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if len(held) < ROWS:
                continue
            key = np.stack([held.column(n).to_numpy() for n in ("bucket", "i", "j")])
            change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0))
            if len(change):  # the last group may go on
                cut = int(change[-1]) + 1
                yield work(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
        if held is not None and len(held):
            yield work(held.combine_chunks())

    return run


def embedding_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Equal vectors collapse to one with a number of copies. Members of a bucket of any table are candidates
    if it is one's own and at most a probe of the other's; their cosine is verified in double precision.
    Vectors are hashed once; bucket numbers travel alone to find those that are shared, and only members of
    shared buckets bring their vectors. A large bucket is dealt into blocks by hash and compared block by block,
    so a hot one is many small tasks; each returns counts and a spanning forest. A pair found in several buckets
    counts in the first.

    Vectors that are null, empty, zero, or hold null or non-finite components: n_links 0, own component, kept.
    Shorter vectors count as padded with zeros; very large and very small components are scaled, not lost.
    Null id: links with nothing, component_id null, kept true. Rows that repeat an id and a vector are copies of
    each other; different vectors under one id are judged each by itself. Other columns are not read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    e = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    fine = F.coalesce(F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(e, lambda v: v != 0), F.lit(False)) & F.col(id_col).isNotNull()
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.when(fine, e).alias("e"))
    named = rows.select("id", F.when(F.col("e").isNotNull(), F.xxhash64("e")).alias("k1"), F.when(F.col("e").isNotNull(), F.xxhash64(F.lit(1), "e")).alias("k2"), "e")
    reps = named.filter("e is not null").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first("e").alias("e"))
    reps = scratch.save(reps.withColumn("node", F.monotonically_increasing_id()))  # numbers a vector, whatever its id
    longest = reps.agg(F.max(F.size("e"))).first()[0] or 1
    width = 1 << max(1, (longest - 1).bit_length())
    hashed = scratch.save(reps.select("node", "e", "copies").mapInArrow(_hashed(width), "node long, copies long, x binary, codes binary"))
    keyed = hashed.select("node", "codes").mapInArrow(_keys, "node long, bucket long, own boolean")
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("size"), F.max("own").alias("any")).filter("size > 1 and any").select("bucket", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    members = scratch.save(keyed.drop("own").join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int")))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    dealt = dealt.join(hashed, "node").select("bucket", "i", "j", "block", "node", "copies", "x", "codes").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")
    found = scratch.save(dealt.mapInArrow(_compare(width, least), "node long, n long, root long"))
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    labels = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), scratch)
    first = labels.join(reps.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("first"))
    known = reps.select("k1", "k2", "rep", "copies", "node").join(counts, "node", "left").join(labels.join(first, "component"), "node", "left")
    known = known.select("k1", "k2", F.coalesce("first", "rep").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"))
    out = named.drop("e").join(known, ["k1", "k2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))
