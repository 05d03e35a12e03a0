"""Periodic runs of words by Crochemore's partition refinement, over many documents at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 1 << 20  # words refined together; a longer document is a batch of its own


def _segments(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start .. start + size - 1 of each pair, one after the other."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(start - total + size, size)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where any of some sorted keys changes, and the beginning."""
    change = np.ones(len(keys[0]), bool)
    change[1:] = False
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(change)


class Partition:
    """Positions of many sequences in classes of equal factors of one length, which refine() makes one longer.

    A position of its own ends each sequence, and one stands before them all, so that factors never cross an end.
    Members of a class are a segment of `order`, and a list in order of position through `after` and `before`.
    """

    def __init__(self, symbols: np.ndarray, bounds: np.ndarray):
        size = np.diff(bounds)
        self.first = bounds[:-1] + 1 + np.arange(len(size))
        n = self.n = int(bounds[-1]) + len(size) + 1
        key = np.full(n, -1, np.int64)
        key[_segments(self.first, size)] = symbols
        self.doc = np.repeat(np.arange(-1, len(size)), np.r_[1, size + 1])
        self.half = np.r_[0, size // 2][self.doc + 1]
        ends = np.r_[0, self.first + size]
        key[ends] = np.arange(len(ends)) + (int(symbols.max()) + 1 if len(symbols) else 0)
        self.order = order = np.argsort(key, kind="stable")
        begin = _starts(key[order], self.doc[order])
        self.start, self.size = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.start[: len(begin)], self.size[: len(begin)] = begin, np.diff(np.r_[begin, n])
        self.classes = len(begin)
        self.cls, self.slot = np.empty(n, np.int64), np.empty(n, np.int64)
        self.cls[order] = np.repeat(np.arange(len(begin)), self.size[: len(begin)])
        self.slot[order] = np.arange(n)
        self.moved = np.zeros(n + 1, bool)
        self.after, self.before = np.full(n + 1, n), np.zeros(n + 1, np.int64)
        same = self.cls[order[1:]] == self.cls[order[:-1]]
        self.after[order[:-1][same]], self.before[order[1:][same]] = order[1:][same], order[:-1][same]
        self.length = 1
        # of each document's classes all but the largest lead the first step
        of, count = self.doc[order[begin]], self.size[: len(begin)]
        by = np.lexsort((count, of))
        largest = by[np.r_[np.flatnonzero(np.diff(of[by])), len(by) - 1]]
        small = np.ones(len(begin), bool)
        small[largest] = False
        self.leaders = order[_segments(begin[small], count[small])]

    def refine(self) -> np.ndarray:
        """Makes factors one longer; returns the positions whose next class member changed.

        Only what stands before a member of a small class (a leader) moves: members of a class whose successors all lie in
        its parent's one large part stay together. Of what a class splits into, all but the largest part lead the next step.
        """
        self.length += 1
        at = self.leaders - 1
        keep = (self.size[self.cls[at]] > 1) & (self.half[at] >= self.length)
        at, lead = at[keep], self.cls[self.leaders[keep]]
        if not len(at):
            self.leaders = at
            return at
        own = self.cls[at]
        if self.n < 1 << 21:
            key = np.sort((own << 42) | (lead << 21) | at)
            own, lead, at = key >> 42, (key >> 21) & 0x1FFFFF, key & 0x1FFFFF
            listed = at[np.argsort((own << 21) | at)]
        else:
            o = np.lexsort((at, lead, own))
            own, lead, at = own[o], lead[o], at[o]
            listed = at[np.lexsort((at, own))]
        part = _starts(own, lead)
        length = np.diff(np.r_[part, len(at)])
        kind = _starts(own[part])
        old = own[part[kind]]
        moved = np.add.reduceat(length, kind)
        rest = self.size[old] - moved
        of = np.repeat(np.arange(len(old)), np.diff(np.r_[kind, len(part)]))
        most = np.maximum.reduceat(length, kind)
        big = np.flatnonzero(length == most[of])
        big = big[_starts(of[big])]  # the first largest part of each class

        # lists: chains of moved members are cut out, then moved members are linked part by part
        self.moved[at] = True
        left = self.before[listed[~self.moved[self.before[listed]]]]
        right = self.after[listed[~self.moved[self.after[listed]]]]
        self.after[left], self.before[right] = right, left
        self.after[at], self.before[at] = self.n, 0
        joined = np.ones(len(at), bool)
        joined[part] = False
        a, b = at[:-1][joined[1:]], at[1:][joined[1:]]
        self.after[a], self.before[b] = b, a

        # segments: moved members go to the end of their class's segment, in the order of their parts
        tail = _segments(self.start[old] + rest, moved)
        there = self.order[tail]
        gap = self.slot[at]
        gap = gap[gap < np.repeat(self.start[old] + rest, moved)]
        stay = there[~self.moved[there]]
        self.order[gap], self.slot[stay] = stay, gap
        self.order[tail], self.slot[at] = at, tail
        self.moved[at] = False

        fresh = np.ones(len(part), bool)
        fresh[big[rest == 0]] = False  # where nothing stays, the largest part keeps the number
        name = own[part].copy()
        name[fresh] = self.classes + np.arange(fresh.sum())
        self.classes += int(fresh.sum())
        self.size[old] = rest
        self.start[name], self.size[name] = tail[part], length
        self.cls[at] = np.repeat(name, length)

        leads = np.ones(len(part), bool)
        leads[big[most > rest]] = False
        some = (rest > 0) & (most > rest)
        self.leaders = np.concatenate([at[np.repeat(leads, length)], self.order[_segments(self.start[old[some]], rest[some])]])
        return np.concatenate([left[left > 0], at])


def squares(symbols: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, Partition, np.ndarray]]:
    """(period, partition, positions in order) of all squares whose root is no power, by period.

    A class member whose next one stands at a distance of the factors' length starts such a square. Distances only grow,
    so those within twice the present length wait in a table by distance, the others until it has doubled.
    """
    p = Partition(symbols, bounds)
    top = 2
    soon: dict[int, list[np.ndarray]] = {}
    later = [np.flatnonzero(p.after[: p.n] < p.n)]

    def put(at: np.ndarray) -> None:
        gap = p.after[at] - at
        fine = (p.after[at] < p.n) & (gap >= p.length) & (gap <= p.half[at])
        at, gap = at[fine], gap[fine]
        far = gap >= top
        if far.any():
            later.append(at[far])
            at, gap = at[~far], gap[~far]
        if len(at):
            o = np.argsort(gap, kind="stable")
            at, gap = at[o], gap[o]
            cut = _starts(gap)
            for k, part in zip(gap[cut].tolist(), np.split(at, cut[1:]), strict=True):
                soon.setdefault(k, []).append(part)

    while True:
        if p.length == top or p.length == 1:
            top = 2 * p.length
            marked = np.zeros(p.n, bool)
            for at in later:
                marked[at] = True
            later = []
            put(np.flatnonzero(marked))
        found = soon.pop(p.length, None)
        if found:
            at = np.unique(np.concatenate(found))
            at = at[p.after[at] - at == p.length]
            if len(at):
                yield p.length, p, at
        if not len(p.leaders):
            break
        changed = p.refine()
        if p.length < top:
            put(changed)
        else:
            later.append(changed)


def runs(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs of the sequences symbols[bounds[k]:bounds[k + 1]], by document, start and period.

    Squares of one period at neighbouring positions are one run; between two runs of a period stands a position without a square.
    """
    got = []
    for period, p, at in squares(symbols, bounds):
        begin = np.flatnonzero(np.r_[True, np.diff(at) > 1])
        end = np.r_[begin[1:] - 1, len(at) - 1]
        doc = p.doc[at[begin]]
        got.append(np.stack([doc, at[begin] - p.first[doc], at[end] - at[begin] + 2 * period, np.full(len(begin), period)]))
    if not got:
        return (np.zeros(0, np.int64),) * 4
    doc, start, length, period = np.concatenate(got, 1)
    o = np.lexsort((period, start, doc))
    return doc[o], start[o], length[o], period[o]


def _tail(n: int, h: int) -> np.ndarray | None:
    """Places of the words of a document with a planted periodic tail: from a on, words repeat with period p."""
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    src = np.arange(n)
    src[a:] = a + (src[a:] - a) % p
    return src


def _found(texts: list[bytes], h: list[int | None], least: int) -> Iterator[tuple[int, int, list, bytes]]:
    """(row, words, runs, collapsed text) of each text, shortest texts first."""
    def rows() -> Iterator[list[tuple[int, list[bytes]]]]:
        held, size = [], 0
        for k in sorted(range(len(texts)), key=lambda k: len(texts[k])):
            words = texts[k].split()
            if words and h[k] is not None:
                words = [words[i] for i in _tail(len(words), h[k]).tolist()]
            if held and size + len(words) > BATCH:
                yield held
                held, size = [], 0
            held.append((k, words))
            size += len(words)
        yield held

    for held in rows():
        bounds = np.cumsum([0, *(len(w) for _, w in held)])
        codes = pc.dictionary_encode(pa.array([x for _, w in held for x in w], pa.binary())).indices.to_numpy().astype(np.int64)
        doc, start, length, period = runs(codes, bounds)
        fine = length >= np.maximum(least, 2 * period)
        doc, start, length, period = doc[fine], start[fine], length[fine], period[fine]
        edge = np.zeros(int(bounds[-1]) + len(held) + 1, np.int64)
        np.add.at(edge, bounds[doc] + start + period, 1)
        np.add.at(edge, bounds[doc] + start + length, -1)
        kept = np.cumsum(edge)[: int(bounds[-1])] == 0
        cut = np.searchsorted(doc, np.arange(len(held) + 1))
        found = np.stack([start, length, period], 1).tolist()
        for j, (k, words) in enumerate(held):
            some = found[cut[j] : cut[j + 1]]
            if some:
                words_kept = [w for w, keep in zip(words, kept[bounds[j] : bounds[j + 1]].tolist(), strict=True) if keep]
            else:
                words_kept = words
            yield k, len(words), some, b" ".join(words_kept)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _mapped(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            out = sorted(_found(texts, batch.column(2).to_pylist(), least))
            sizes = np.cumsum([0, *(len(r) for _, _, r, _ in out)])
            flat = np.array([x for _, _, r, _ in out for x in r], np.int64).reshape(-1, 3)
            spans = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_RUN)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n, _, _ in out], pa.int64()), spans, pa.array([c for *_, c in out], pa.binary())], names=["_id", "n", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 12, planted: int = 0) -> DataFrame:
    """One row per input row: id, n (words), runs (array of start, length, period by start and period), collapsed.

    A run is a stretch of at least max(least, 2 * period) words in which words a period apart are equal, with no smaller
    period and not to be made longer. collapsed holds the words, one space between them, without those that a run
    repeats after its first period. With planted = m, documents whose id's crc32 is divisible by m (m a multiple of 10)
    first get a periodic tail: for tests of whole tables.

    Null or empty text, or white space alone: no words, no runs, collapsed empty. Null id: as any other, never planted.
    Repeated rows give equal rows. Texts of any length are worked on whole, in memory that grows with the longest text.
    An empty table gives an empty result. Other columns are not read.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    tail = F.when(h % planted == 0, h) if planted else F.lit(None).cast("long")
    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), tail.alias("_tail"))
    found = found.mapInArrow(_mapped(least), f"_id {kind}, n long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return found.select(F.col("_id").alias(id_col), "n", "runs", F.col("collapsed").cast("string").alias("collapsed"))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """What op11 returns: the longest run, and digests of all runs and of the collapsed text."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), longest.alias("r"), lines.alias("lines"), "collapsed")
    start, period = -F.col("r.start"), -F.col("r.period")
    return rows.select(id_col, "n_runs", start.alias("start"), F.col("r.length").alias("length"), period.alias("period"), F.floor(1000 * F.col("r.length") / period).cast("long").alias("exponent_milli"), F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
