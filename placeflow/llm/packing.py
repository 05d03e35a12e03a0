"""Best-fit-decreasing packing of documents into token sequences."""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, pieces, strings

_TWO_SPACES = re.compile(r"\s\s")


def byte_bpe(path: str) -> tuple[str, dict[bytes, int], list[str]]:
    """Of a byte-level BPE tokenizer file: its split pattern, the ids of its words as bytes, and the contents of its added tokens."""
    import json

    import public_tokenizers
    from tokenizers.pre_tokenizers import ByteLevel

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    added = [t["content"] for t in file["added_tokens"]]
    # the letters that stand for bytes, in order of the bytes: printable ones for themselves, then the rest
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    if set(byte) != set(ByteLevel.alphabet()):
        raise ValueError(f"not a byte-level vocabulary: {path}")
    ranks = {bytes(byte[c] for c in word): i for word, i in file["model"]["vocab"].items() if word not in added}
    return public_tokenizers.PATTERN, ranks, added


def encoder(path: str):
    """texts -> little-endian ids of each, as the tokenizers library gives them with add_special_tokens=False.

    That library recognises its added tokens (such as an end mark) inside texts; texts that hold one go through
    it. The others go through tiktoken's encoder of the same vocabulary, which gives the same ids at a fifth of
    the time. Where no two white-space characters meet, the pattern's look-ahead for runs of them never decides,
    and without it the split runs twice as fast.
    """
    import tiktoken
    from tokenizers import Tokenizer

    pattern, ranks, added = byte_bpe(path)
    exact = Tokenizer.from_file(path)
    full, plain = (tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for name, p in (("full", pattern), ("plain", pattern.replace(r"\s+(?!\S)|", ""))))

    def ids(text: str) -> list[int]:
        if any(t in text for t in added):
            return exact.encode(text, add_special_tokens=False).ids
        return (full if _TWO_SPACES.search(text) else plain).encode_ordinary(text)

    return lambda texts: [np.asarray(ids(t), "<u4").tobytes() for t in texts]


def _cut(path: str, size: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        last = np.asarray([end], "<u4").tobytes()
        for batch in batches:
            _, offsets = strings(batch.column(1))
            for i, j in pieces(offsets, 1 << 20):
                rows: list[tuple] = []
                texts = [x or "" for x in batch.column(1).slice(i, j - i).to_pylist()]
                for doc, ids in zip(batch.column(0).slice(i, j - i).to_pylist(), encode(texts), strict=True):
                    ids += last
                    n = len(ids) // 4
                    at = 0
                    for k in range(-(-n // size)):
                        to = n - size * (-(-n // size) - 1 - k)
                        part = ids[4 * at : 4 * to]
                        rows.append((doc, k, at, to - at, zlib.crc32(part), np.frombuffer(part, "<u4").tolist() if with_ids else None))
                        at = to
                kinds = {"id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.list_(pa.int64())} if with_ids else {})
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))

    return run


def best_fit_runs(counts: dict[int, int], size: int) -> np.ndarray:
    """Best-fit decreasing over numbers of items by length: rows (length, rank, items, bin, offset, items a bin).

    A run puts `items` items of one length, by rank, into consecutive bins. A segment tree over remaining
    capacities finds the tightest open capacity in log(size) steps. Bins of equal capacity are
    interchangeable, and the tightest bin stays the tightest until it can't take the length again, so a run
    stands for as many steps of the plain algorithm as it has items, and the work depends on size only.
    """
    leaves = 1 << size.bit_length()
    tree = np.zeros(2 * leaves, np.int8)  # 1: some open bin below has this remaining capacity
    bins: list[deque[tuple[int, int]]] = [deque() for _ in range(size + 1)]
    runs, opened = [], 0

    def mark(c: int, on: int) -> None:
        i = leaves + c
        tree[i] = on
        while i > 1:
            i //= 2
            tree[i] = tree[2 * i] | tree[2 * i + 1]

    def tightest(c: int) -> int:
        i = leaves + c
        if tree[i]:
            return c
        while i > 1:
            if i % 2 == 0 and tree[i + 1]:
                i += 1
                while i < leaves:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - leaves
            i //= 2
        return -1

    def free(c: int, first: int, n: int) -> None:
        if c and n:
            bins[c].append((first, n))
            if len(bins[c]) == 1:
                mark(c, 1)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            c = tightest(length)
            if c < 0:
                c, first, n = size, opened, -(-left // (size // length))
                opened += n
            else:
                first, n = bins[c].popleft()
                if not bins[c]:
                    mark(c, 0)
            each = c // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, first, size - c, each))
                rank, left = rank + full * each, left - full * each
                free(c - full // full * each * length, first, full)
            if full < n:
                if left:
                    runs.append((length, rank, left, first + full, size - c, each))
                    free(c - left * length, first + full, 1)
                    rank, left, full = rank + left, 0, full + 1
                free(c, first + full, n - full)
    return np.asarray(runs, np.int64).reshape(-1, 6)


def _place(runs):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = runs.value
        key = r[:, 0] << 48 | r[:, 1]
        order = np.argsort(key)
        r, key = r[order], key[order]
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
            x = r[np.searchsorted(key, length << 48 | rank, "right") - 1]
            within = rank - x[:, 1]
            bin_, offset = x[:, 3] + within // x[:, 5], x[:, 4] + within % x[:, 5] * length
            names = [n for n in batch.schema.names if n not in ("rank", "part")]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), pa.array(bin_), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 2048, end: int = 0, with_ids: bool = False, part: int = 2000) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its ids, those of added tokens that its text spells out included, and then `end`. Only those longer than `size` are cut, all pieces but the first
    full. Lengths are counted (at most `size` rows), best-fit decreasing packs the counts, and pieces get
    their place by rank within their length. Ranks come from sums over parts of about `part` pieces, so a
    very common length is dealt over many tasks.

    Null or empty text: one piece, `end` alone. Repeated rows are packed each. Null ids stay null. An empty
    table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    schema = "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    cut = scratch.save(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_cut(tokenizer, size, end, with_ids), schema))
    counts = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}  # at most `size` rows
    runs = spark.sparkContext.broadcast(best_fit_runs(counts, size))
    parts = max(1, sum(counts.values()) // part)
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(parts)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("length", "part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).select("length", "part", "before")
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("within", within).join(sums, ["length", "part"]).withColumn("rank", (F.col("before") + F.col("within")).cast("long")).drop("before", "within")
    out = ranked.select("id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "part", "rank").mapInArrow(_place(runs), schema + ", sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
