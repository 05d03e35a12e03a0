"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import Scratch, blobs, held_out, pieces, strings
from .labelled import collected, sample, sampled_rows, scored, text_key, training_labels, verdict

BUCKETS, STARTS, FULL = 1 << 20, (5, 6, 7, 8), 20


def _terms(data: np.ndarray, offsets: np.ndarray, live: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term, count, bounds by text, words by text) of the hashed words and word starts of 5 to 8 bytes, A-Z lowered.

    Words are runs of letters. With `live`, only terms it holds true for.
    """
    n = len(offsets) - 1
    low = K.LOWER[data]
    starts, ends, owner = K.tokens(low, offsets)
    word = K.CLASS[low[starts]] == 1
    starts, ends, owner = starts[word], ends[word], owner[word]
    size = ends - starts
    p, q = K.powers(len(low))
    total = np.zeros(len(low) + 1, np.uint64)
    np.cumsum(K.BYTE[low] * p[: len(low)], out=total[1:])
    keys = []
    for k in (0, *STARTS):
        some = np.flatnonzero(size > k)
        s = starts[some]
        term = K.mix((total[s + k if k else ends[some]] - total[s]) * q[s] + np.uint64(k)) % np.uint64(BUCKETS)
        term = term.astype(np.int64)
        of = owner[some]
        if live is not None:
            keep = live[term]
            term, of = term[keep], of[keep]
        keys.append(of * BUCKETS + term)
    both, count = np.unique(np.concatenate(keys), return_counts=True)
    return both % BUCKETS, count, np.searchsorted(both, np.arange(n + 1) * BUCKETS), np.bincount(owner, minlength=n)


def _dense(count: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A term's share of the words, FULL times, at most 1."""
    return np.minimum(1.0, FULL * count / np.maximum(words, 1))


def _features(live: np.ndarray):
    """Per text its words, then its terms among `live` and their counts."""

    def run(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        mask = np.zeros(BUCKETS, bool)
        mask[live] = True
        term, count, bound, words = _terms(data, offsets, mask)
        out = np.stack([term, count]).astype(np.int32)
        return [np.concatenate([[w], out[0, s:e], out[1, s:e]]).astype(np.int32).tobytes() for s, e, w in zip(bound, bound[1:], words, strict=False)]

    return run


def _coded(live: np.ndarray | None):
    """Texts (k1, k2, text) to their terms among `live` (null: all), packed: words, steps between sorted terms, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = None
        if live is not None:
            mask = np.zeros(BUCKETS, bool)
            mask[live] = True
        for batch in batches:
            data, offsets = strings(batch.column(2))
            for i, j in pieces(offsets, 1 << 20):
                at = offsets[i : j + 1]
                term, count, bound, words = _terms(data[at[0] : at[-1]], at - at[0], mask)
                packed = [zlib.compress(np.concatenate([[w], np.diff(term[s:e], prepend=0), count[s:e]]).astype(np.int32).tobytes(), 1) for s, e, w in zip(bound, bound[1:], words, strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), blobs(packed)], names=["k1", "k2", "x"])

    return run


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums by term over packed texts: how many hold it, and their densities; term -1 counts the texts."""
    total, texts = np.zeros((2, BUCKETS)), 0
    for batch in batches:
        texts += len(batch)
        for x in batch.column(0).to_pylist():
            row = np.frombuffer(zlib.decompress(x), np.int32)
            n = len(row) // 2
            term = np.cumsum(row[1 : n + 1])
            total[0, term] += 1
            total[1, term] += _dense(row[n + 1 :], row[0])
    held = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, held]), pa.array(np.r_[float(texts), total[0, held]]), pa.array(np.r_[0.0, total[1, held]])], names=["term", "n", "d"])


def _sums(texts: DataFrame, live: np.ndarray | None = None) -> dict[int, tuple[float, float]]:
    """By term, how many different texts of (k1, k2, text) hold it and the sum of their densities; equal texts count once.

    A text is packed where it lies; its packed terms, not the text, meet by hash. At most BUCKETS terms reach the driver.
    """
    once = texts.mapInArrow(_coded(live), "k1 long, k2 long, x binary").groupBy("k1", "k2").agg(F.first("x").alias("x"))
    sums = once.select("x").mapInArrow(_tally, "term long, n double, d double").groupBy("term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    return {r["term"]: (r["n"], r["d"]) for r in sums.collect()}


def telling_terms(positives: DataFrame, texts: DataFrame, prior: float, seen: int = 3, apart: float = 5.0) -> np.ndarray:
    """Terms worth a weight: held by at least `seen` of the positives (k1, k2, text), with a share among them `apart` standard errors
    above that among the other `texts` (k1, k2, text), and a density that makes toxicity likelier than not.

    Shares count different texts, so copies shift nothing, and the positives' own texts aren't held against them. They
    are counted over the whole corpus, for terms that the positives hold. Positives are a bounded table.
    """
    mine = _sums(positives)
    n_p = max(mine.pop(-1, (0.0, 0.0))[0], 1.0)
    mine = {t: x for t, x in mine.items() if x[0] >= seen}
    if not mine:
        return np.zeros(0, np.int64)
    terms = np.array(sorted(mine), np.int64)
    found = _sums(texts.join(F.broadcast(positives.select("k1", "k2")), ["k1", "k2"], "left_anti"), terms)
    n_u = max(found.pop(-1, (0.0, 0.0))[0], 1.0)
    return terms[told(np.array([mine[t] for t in terms]).T, np.array([found.get(t, (0.0, 0.0)) for t in terms]).T, n_p, n_u, prior, apart)]


def told(positive: np.ndarray, other: np.ndarray, n_p: float, n_u: float, prior: float, apart: float) -> np.ndarray:
    """Whether each term tells: numbers of texts and sums of densities among n_p positives and n_u others."""
    (in_p, d_p), (in_u, d_u) = positive, other
    both = (in_p + in_u) / (n_p + n_u)
    error = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / n_p + 1 / n_u))
    return ((in_p / n_p - in_u / n_u) / error >= apart) & (prior * d_p / n_p >= (1 - prior) * d_u / n_u)


def _logits(weights: np.ndarray, bias: float, term: np.ndarray, dense: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Each text's sum over its terms of a weight for presence and one for density, and the bias."""
    total = np.concatenate([[0.0], np.cumsum(weights[0, term] + weights[1, term] * dense)])
    return total[bound[1:]] - total[bound[:-1]] + bias


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, rounds: int = 200, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights (presence and density by term) and bias of a logistic scorer that minimises the non-negative PU risk by Adam.

    The risk is prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)]) for the logistic loss l. Where the
    bracket turns negative the step goes against it, so the scorer can't win by fitting the unlabelled
    positives. Texts hold telling terms only: others would favour long texts, or learn few positives by heart.
    """
    texts = positive + unlabelled
    sizes = np.array([len(t) // 2 for t in texts])
    term = np.concatenate([t[1 : n + 1] for t, n in zip(texts, sizes, strict=True)]).astype(np.int64)
    dense = np.concatenate([_dense(t[n + 1 :], t[0]) for t, n in zip(texts, sizes, strict=True)])
    owner = np.repeat(np.arange(len(texts)), sizes)
    p = np.arange(len(texts)) < len(positive)
    n_p, n_u = max(p.sum(), 1), max((~p).sum(), 1)
    common, term = np.unique(term, return_inverse=True)
    bound = np.searchsorted(owner, np.arange(len(texts) + 1))
    w, bias = np.zeros((2, len(common))), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, rounds + 1):
        g = np.clip(_logits(w, bias, term, dense, bound), -30, 30)
        s = 1 / (1 + np.exp(-g))
        negative = np.log1p(np.exp(g[~p])).sum() / n_u - prior * np.log1p(np.exp(g[p])).sum() / n_p
        toward = np.where(p, prior * (s - 1) / n_p, 0.0)
        other = np.where(p, -prior * s / n_p, s / n_u)
        d = toward + other if negative >= 0 else -other
        step = np.stack([np.bincount(term, d[owner], minlength=len(common)), np.bincount(term, d[owner] * dense, minlength=len(common))]) + decay * w
        m, v = 0.9 * m + 0.1 * step, 0.999 * v + 0.001 * step * step
        w = np.maximum(w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8), 0)
        mb, vb = 0.9 * mb + 0.1 * d.sum(), 0.999 * vb + 0.001 * d.sum() ** 2
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    out = np.zeros((2, BUCKETS))
    out[:, common] = w
    return out, bias


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", positives: int = 2000, unlabelled: int = 8000, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1), predicted (score >= 0.5), then its own columns `keep`.

    Learns from at most `positives` confirmed toxic rows and `unlabelled` texts whose labels, if any, it
    doesn't see, both outside the held-out fold (crc32 of the id's text divisible by 5) and drawn by hash;
    the class prior is the share of toxic rows among all labelled ones outside the fold. Which terms get a weight
    is decided against all other texts outside the fold that have an id, each different text once: neither copies
    nor rows without an id change what is learned. Scores come from the whole text alone.

    Null or empty text scores as no words. Null id: scored, id null, held_out false. Repeated rows score
    alike. Without a toxic row to learn from, every score is the prior (0 without labels). An empty table
    gives an empty result. Columns besides these are not read.
    """
    spark = docs.sparkSession
    known = training_labels(labels, label, id_col)
    n, toxic = known.agg(F.count("*"), F.sum("y")).first()
    prior = float(np.clip((toxic or 0) / n, 1e-4, 0.9)) if n and toxic else 0.0
    if prior:
        yes = sample(known.filter("y = 1"), positives, 1)
        ids = docs.select(F.col(id_col).cast("long").alias("id")).filter(F.col("id").isNotNull() & ~held_out("id"))
        rest = sample(ids, unlabelled, 2).withColumn("y", F.lit(0))
        rows = Scratch(spark).save(sampled_rows(docs, yes.unionAll(rest), id_col, text_col))
        free = docs.filter(F.col(id_col).isNotNull() & ~held_out(id_col)).select(*text_key(text_col), F.col(text_col).alias("text"))
        got = collected(rows, _features(telling_terms(rows.filter("y = 1").select(*text_key(), "text"), free, prior)))
        sets = {y: [np.frombuffer(x, np.int32) for _, k, x in got if k == y] for y in (0, 1)}
        weights, bias = fit(sets[1], sets[0], prior) if sets[1] else (np.zeros((2, BUCKETS)), float(np.log(prior / (1 - prior))))
    else:
        weights, bias = np.zeros((2, BUCKETS)), -np.inf
    live = np.flatnonzero(weights.any(0))
    model = spark.sparkContext.broadcast((live, weights[:, live], bias))

    def score(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        live, some, bias = model.value
        w = np.zeros((2, BUCKETS))
        w[:, live] = some
        term, count, bound, words = _terms(data, offsets, w.any(0))
        dense = _dense(count, np.repeat(words, np.diff(bound)))
        return 1 / (1 + np.exp(-np.clip(_logits(w, bias, term, dense, bound), -700, 700)))

    return verdict(scored(docs, score, id_col, text_col, keep=keep), 0.5, id_col, keep)
