"""MinHash near-duplicates with sequential Bayesian verification."""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, blobs, pieces, strings
from .components import connected_components

BANDS, ROWS, BATCH, MISS = 32, 6, 32, 1e-7
N = BANDS * ROWS
MORE, BLOCK = 768, 512
_rng = np.random.default_rng(77)
MULTIPLY = _rng.integers(1, 2**63, N, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(1, 2**63, N, dtype=np.uint64)
BAND = _rng.integers(1, 2**63, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
MORE_MULTIPLY = _rng.integers(1, 2**63, MORE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MORE_ADD = _rng.integers(1, 2**63, MORE, dtype=np.uint64)


def _low(x: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of minima: enough to tell them apart but for one pair in 2**bits, and that only adds candidates."""
    return x & np.uint64((1 << bits) - 1)


def _names(key: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two numbers that name each set of shingles."""
    return np.stack([np.add.reduceat(K.mix(key + np.uint64(1)), starts), np.add.reduceat(K.mix(key ^ np.uint64(0x5DEECE66D)), starts)])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = strings(batch.column(1))
        for i, j in pieces(offsets, 1 << 20):
            at = offsets[i : j + 1]
            key, bound = K.shingles(data[at[0] : at[-1]], at - at[0])
            size = np.diff(bound)
            some = np.flatnonzero(size)
            sig = np.zeros((len(some), N), np.uint16)
            names = np.zeros((2, j - i), np.uint64)
            if len(some):
                for k in range(N):
                    sig[:, k] = _low(np.minimum.reduceat((key * MULTIPLY[k] + ADD[k]) >> np.uint64(32), bound[:-1][some]), 16)
                names[:, some] = _names(key, bound[:-1][some])
            rows: list[bytes | None] = [None] * (j - i)
            for r, k in enumerate(some):
                rows[k] = sig[r].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(size.astype(np.int64)), pa.array(names[0].view(np.int64)), pa.array(names[1].view(np.int64)), blobs(rows)], names=["id", "n", "k1", "k2", "sig"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), N)


def banding(percent: int, slip: float = 3e-7) -> tuple[int, int]:
    """(bands, rows): the longest bands, up to ROWS minima, that a pair at the threshold shares none of with a chance of at most slip."""
    for rows in range(ROWS, 0, -1):
        if (1 - (percent / 100) ** rows) ** (N // rows) <= slip:
            return N // rows, rows
    return N, 1


def _bands(bands: int, rows: int):
    by = BAND.ravel()[: bands * rows].reshape(bands, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 4096):
                part = batch.slice(i, 4096)
                sig = _matrix(part.column(1))[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
                key = K.mix((sig * by).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(part.column(0).to_numpy(zero_copy_only=False), bands))], names=["key", "node"])

    return run


def least_matches(threshold: float, n: int, miss: float) -> int:
    """The fewest of n equal minima at which P(similarity >= threshold) is at least miss, from a uniform prior."""
    tail = 0.0
    for m in range(n + 1):  # the posterior is Beta(m + 1, n - m + 1); its tail is a binomial sum
        tail += exp(lgamma(n + 2) - lgamma(m + 1) - lgamma(n + 2 - m) + m * log(threshold) + (n + 1 - m) * log(1 - threshold))
        if tail >= miss:
            return m
    return n


def _prune(threshold: float, miss: float):
    need = [(n, least_matches(threshold, n, miss)) for n in range(BATCH, N + 1, BATCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 2048):
                part = batch.slice(i, 2048)
                a, b = _matrix(part.column(2)), _matrix(part.column(3))
                alive, equal = np.arange(len(part)), np.zeros(len(part), np.int64)
                for n, least in need:  # a batch of minima at a time, on what is still likely enough
                    equal[alive] += (a[alive, n - BATCH : n] == b[alive, n - BATCH : n]).sum(1)
                    alive = alive[equal[alive] >= least]
                yield part.select([0, 1]).take(pa.array(alive))

    return run


def _own_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (node, k1, k2, text): node and text, where the text is the node's own set (rows may share an id)."""
    for batch in batches:
        data, offsets = strings(batch.column(3))
        want = np.stack([batch.column(k).to_numpy().view(np.uint64) for k in (1, 2)])
        for i, j in pieces(offsets, 1 << 20):
            at = offsets[i : j + 1]
            key, bound = K.shingles(data[at[0] : at[-1]], at - at[0])
            some = np.flatnonzero(np.diff(bound))
            some = some[(_names(key, bound[:-1][some]) == want[:, i + some]).all(0)] if len(some) else some
            yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i).take(pa.array(some)) for c in (0, 3)], names=["node", "text"])


def _of_texts(columns: dict[str, pa.DataType], values):
    """Over (node, text): node and `values` of its shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for i, j in pieces(offsets, 1 << 20):
                at = offsets[i : j + 1]
                arrays = values(*K.shingles(data[at[0] : at[-1]], at - at[0]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(x, t) for x, t in zip(arrays, columns.values(), strict=True))], names=["node", *columns])

    return run


def _longer(key: np.ndarray, bound: np.ndarray) -> tuple:
    """Sizes of sets, and MORE further minima of each, 8 bits of one."""
    sig = np.zeros((len(bound) - 1, MORE), np.uint8)
    for k in range(MORE if len(sig) else 0):  # texts without words aren't among these
        sig[:, k] = _low(np.minimum.reduceat(key * MORE_MULTIPLY[k] + MORE_ADD[k] >> np.uint64(32), bound[:-1]), 8)
    return np.diff(bound), [r.tobytes() for r in sig]


def _items(key: np.ndarray, bound: np.ndarray) -> tuple:
    return ([key[s:e].tobytes() for s, e in zip(bound, bound[1:], strict=False)],)


def _compare(threshold: float, miss: float, bands: int):
    """Likely pairs of each (key, size, i, j): stragglers against members of other components, a few minima at a time.

    A pair that shares several keys comes from the least one, one of two stragglers from the smaller id.
    """
    need = [(n, least_matches(threshold, n, miss)) for n in (32, 64, 128, 256, 512, MORE)]

    def likely(g: pa.Table) -> pa.RecordBatch:
        side, ids, part = (g.column(c).to_numpy() for c in ("side", "node", "component"))
        sig = np.frombuffer(b"".join(g.column("more").to_pylist()), np.uint8).reshape(len(g), MORE)
        few, lists = g.column("few").to_numpy(), g.column("keys").combine_chunks()
        count = np.diff(lists.offsets.to_numpy())
        keys = np.full((len(g), bands), np.iinfo(np.int64).max)
        keys[np.repeat(np.arange(len(g)), count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)] = lists.flatten().to_numpy()
        key = g.column("key")[0].as_py()
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for x in left:
            alive = right[(part[right] != part[x]) & (~few[right] | (ids[x] < ids[right]))]
            equal, done = np.zeros(len(alive), np.int64), 0
            for n, least in need:
                equal += (sig[alive, done:n] == sig[x, done:n]).sum(1)
                alive, equal, done = alive[equal >= least], equal[equal >= least], n
            if len(alive):
                alive = alive[np.where(np.isin(keys[alive], keys[x, : count[x]]), keys[alive], np.iinfo(np.int64).max).min(1) == key]
            a.append(np.full(len(alive), ids[x]))
            b.append(ids[alive])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
            keys = np.stack([held.column(c).to_numpy() for c in ("key", "size", "i", "j")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()]
            for s, e in zip(edges, edges[1:], strict=False):
                yield likely(held.slice(s, e - s))
            held = held.slice(edges[-1])
        if held is not None and len(held):
            yield likely(held)

    return run


def _exact(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([a, b])
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, miss: float = MISS) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    A row's set holds its distinct five-word shingles (fewer words: the whole sequence as one). Rows
    link where 100 * intersection >= percent * union. Equal sets collapse to one node first;
    nodes sharing a band meet the band bucket's least and greatest member, candidates are
    pruned by the posterior over batches of minima, survivors are confirmed on whole sets. Buckets that
    still hold several components are compared again, at last each straggler (outside its bucket's largest
    component) with the rest of its bucket of about its size. That goes by blocks of at most about BLOCK rows on
    each side, with MORE minima of those texts, and only likely pairs leave a block; no candidate link is
    left out. Wide signatures are dropped once the shared buckets are known: those of nodes in none aren't needed again.
    Texts are looked up once, for all nodes in shared buckets.

    Null or empty text, or one without words: n_shingles 0, component_id its own id, kept. A null id
    links with nothing: component_id null, kept true. Rows that repeat an id are judged each by its own text;
    component_id is the least id of all rows reachable from that text. Other columns are not read. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    n_bands, n_rows = banding(percent)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sigs = scratch.save(docs.mapInArrow(_signatures, "id long, n long, k1 long, k2 long, sig binary"))
    named = sigs.filter("n > 0 and id is not null").groupBy("k1", "k2").agg(F.min("id").alias("rep"), F.first("sig").alias("sig"))
    wide = scratch.save(named.withColumn("node", F.monotonically_increasing_id()))
    rows = scratch.save(sigs.drop("sig"))
    scratch.drop(sigs)
    bands = wide.select("node", "sig").mapInArrow(_bands(n_bands, n_rows), "key long, node long")
    shared = bands.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi")
    cand = scratch.save(bands.join(shared, "key"))
    nodes = scratch.save(wide.drop("sig"))
    signed = scratch.save(wide.select("node", "sig").join(cand.select("node").distinct(), "node", "left_semi"))
    scratch.drop(wide)

    wanted = nodes.join(signed.select("node"), "node", "left_semi").withColumnRenamed("rep", "id")
    own = docs.join(wanted, "id").select("node", "k1", "k2", "text").mapInArrow(_own_texts, "node long, text string")
    texts = scratch.save(own.groupBy("node").agg(F.first("text").alias("text")))  # rows may repeat an id and a text

    def of_nodes(some: DataFrame, columns: dict[str, pa.DataType], schema: str, values) -> DataFrame:
        """`values` of the texts of some nodes, a row for each."""
        return texts.join(some, "node", "left_semi").mapInArrow(_of_texts(columns, values), f"node long, {schema}")

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of pairs (a, b) that are links."""
        pairs = pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        a, b = (signed.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
        return confirmed(pairs.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_prune(percent / 100, miss), "a long, b long"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        likely = scratch.save(pairs.distinct())
        ends = likely.select(F.col("a").alias("node")).unionAll(likely.select("b")).distinct()
        sets = of_nodes(ends, {"items": pa.binary()}, "items binary", _items)
        a, b = (sets.select(F.col("node").alias(x), F.col("items").alias(f"set_{x}")) for x in "ab")
        out = scratch.save(likely.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b").mapInArrow(_exact(percent), "a long, b long").select(F.col("a").alias("u"), F.col("b").alias("v")))
        scratch.drop(likely)
        return out

    links = verified(cand.select(F.col("node").alias("a"), F.explode(F.array("lo", "hi")).alias("b")))
    labels = connected_components(links, scratch)
    for last in (False, True):
        now = cand.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        mixed = now.groupBy("key").agg(F.min("component").alias("c0"), F.max("component").alias("c1")).filter("c0 < c1").select("key")
        now = scratch.save(now.join(mixed, "key", "left_semi"))
        if now.isEmpty():
            break
        if last:  # every straggler with all of its bucket outside its component
            scratch.drop(signed)
            main = now.groupBy("key", "component").count().groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
            keys = now.groupBy("node").agg(F.collect_list("key").alias("keys"))  # at most n_bands
            longer = scratch.save(of_nodes(now.select("node").distinct(), {"n": pa.int64(), "more": pa.binary()}, "n long, more binary", _longer))
            size = F.floor(F.log("n") / log(100 / percent)).cast("int")
            few = now.join(main, "key").join(longer.select("node", "n"), "node").select("key", "node", "component", size.alias("size"), (F.col("component") != F.col("main")).alias("few"))
            left = few.filter("few").withColumn("size", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1))).withColumn("side", F.lit(0))
            both = left.unionByName(few.withColumn("side", F.lit(1)))
            n = both.groupBy("key", "size").agg(*[F.ceil(F.count_if(F.col("side") == k) / BLOCK).cast("int").alias(f"n{k}") for k in (0, 1)]).filter("n0 > 0 and n1 > 0")
            mine, other = F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1")), F.when(F.col("side") == 0, F.col("n1")).otherwise(F.col("n0"))
            both = both.join(n, ["key", "size"]).withColumn("own", F.pmod(F.xxhash64("node"), mine).cast("int")).withColumn("their", F.explode(F.sequence(F.lit(0), other - 1)))
            both = both.select("key", "size", F.when(F.col("side") == 0, F.col("own")).otherwise(F.col("their")).alias("i"), F.when(F.col("side") == 0, F.col("their")).otherwise(F.col("own")).alias("j"), "side", "node", "component", "few")
            both = both.join(longer.select("node", "more").join(keys, "node"), "node")  # the wide columns move once, to their block
            blocks = both.repartition("key", "size", "i", "j").sortWithinPartitions("key", "size", "i", "j")
            found = blocks.mapInArrow(_compare(percent / 100, miss, n_bands), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            more = confirmed(found)
            scratch.drop(longer)
        else:  # two more members of each bucket, drawn by hash
            drawn = now.groupBy("key").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "component")).alias("x"), F.max(F.struct(F.xxhash64("node").alias("h"), "node", "component")).alias("y"))
            pairs = now.join(drawn, "key").select(F.col("node").alias("a"), "component", F.explode(F.array("x", "y")).alias("e")).filter("e.component <> component").select("a", F.col("e.node").alias("b"))
            more = verified(pairs)
        if not more.isEmpty():
            links = links.unionAll(more)
            labels = connected_components(links, scratch)
    first = labels.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("first"))
    label = nodes.join(labels.join(first, "component"), "node", "left").select("k1", "k2", F.coalesce("first", "rep").alias("component"))
    # rows without words match no node; their own ids spread them
    wordless = F.col("n") == 0
    out = rows.select("id", "n", F.when(wordless, F.xxhash64("id")).otherwise(F.col("k1")).alias("k1"), F.when(~wordless, F.col("k2")).alias("k2")).join(label, ["k1", "k2"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (F.col("id") == component)).alias("kept"))
