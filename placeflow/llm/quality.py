"""Quality by random-indexing word vectors, pooled, and a two-layer network with calibrated temperature."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import pieces, strings
from .labelled import collected, sample, sampled_rows, scored, training_labels, verdict

WORDS, DIM, SIGNS, NEAR = 1 << 13, 32, 2, 2


def _ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket, owner and shape of each token. Case is part of a word, so a capital is another word."""
    starts, ends, owner = K.tokens(data, offsets)
    kind = K.CLASS[data[starts]]
    upper = (data >= 65) & (data <= 90)
    caps = np.concatenate([[0], np.cumsum(upper)])
    long_caps = (caps[ends] - caps[starts] == ends - starts) & (ends - starts > 1)
    shape = np.where(kind == 1, np.where(long_caps, 1, 0), kind)  # 0 word, 1 capitals, 2 digits, 3 marks
    return (K.hashes(data, starts, ends) % np.uint64(WORDS)).astype(np.int64), owner, shape


def index_vectors(words: int = WORDS, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """The sparse random signs of each word: places and signs, SIGNS a word."""
    rng = np.random.default_rng(9)
    return rng.integers(0, dim, (words, SIGNS)), rng.choice([-1, 1], (words, SIGNS))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over a task's texts of the index vectors of up to NEAR neighbours on both sides, by word."""
    place, sign = index_vectors()
    total = np.zeros(WORDS * DIM, np.int64)
    count = np.zeros(WORDS, np.int64)
    for batch in batches:
        data, offsets = strings(batch.column(0))
        for i, j in pieces(offsets, 1 << 21):
            at = offsets[i : j + 1]
            word, owner, _ = _ids(data[at[0] : at[-1]], at - at[0])
            count += np.bincount(word, minlength=WORDS)
            for gap in range(1, NEAR + 1):
                near = np.flatnonzero(owner[gap:] == owner[:-gap])
                for a, b in ((near, near + gap), (near + gap, near)):
                    for k in range(SIGNS):
                        total += np.bincount(word[a] * DIM + place[word[b], k], sign[word[b], k], minlength=WORDS * DIM).astype(np.int64)
    live = np.flatnonzero(count)
    rows = total.reshape(WORDS, DIM)[live]
    yield pa.RecordBatch.from_arrays([pa.array(live), pa.array(count[live]), *(pa.array(rows[:, k]) for k in range(DIM))], names=["word", "n", *(f"d{k}" for k in range(DIM))])


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """WORDS x DIM unit vectors from every text: sums of neighbours' index vectors, less the corpus mean.

    A task emits at most WORDS rows whatever it reads; integer sums make the result the same in any order.
    """
    parts = docs.select(text_col).mapInArrow(_contexts, "word long, n long, " + ", ".join(f"d{k} long" for k in range(DIM)))
    rows = parts.groupBy("word").agg(F.sum("n"), *[F.sum(f"d{k}") for k in range(DIM)]).collect()  # at most WORDS rows
    sums, n = np.zeros((WORDS, DIM)), np.zeros(WORDS)
    for r in rows:
        sums[r[0]], n[r[0]] = r[2:], r[1]
    seen = n > 0
    if seen.any():
        sums[seen] /= n[seen, None]
        sums[seen] -= (sums[seen] * n[seen, None]).sum(0) / n.sum()
    return (sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def pooled(vectors: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row per text: mean and spread of its word vectors, then shares of token shapes, repetition and length."""
    n = len(offsets) - 1
    word, owner, shape = _ids(data, offsets)
    size = np.bincount(owner, minlength=n)
    some = np.maximum(size, 1)[:, None]
    mean, square = np.zeros((n, DIM)), np.zeros((n, DIM))
    if len(word):
        filled = np.flatnonzero(size)
        x = vectors[word].astype(np.float64)
        starts = np.concatenate([[0], np.cumsum(size)])[:-1][filled]
        mean[filled] = np.add.reduceat(x, starts, 0) / some[filled]
        square[filled] = np.add.reduceat(x * x, starts, 0) / some[filled]
    shares = np.stack([np.bincount(owner[shape == k], minlength=n) for k in range(4)], 1) / some
    distinct = np.bincount(np.unique(owner * WORDS + word) // WORDS, minlength=n)[:, None] / some
    letters = np.diff(offsets)[:, None]
    return np.hstack([mean, np.sqrt(np.maximum(square - mean**2, 0)), shares, distinct, np.log1p(size)[:, None], np.log1p(letters) - np.log1p(size)[:, None]])


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 300, rate: float = 0.01, decay: float = 1e-3) -> dict:
    """A two-layer network by full-batch Adam, standardised inputs; its temperature minimises the loss on a fifth kept apart."""
    rng = np.random.default_rng(4)
    apart = rng.permutation(len(x)) < len(x) // 5
    centre, spread = x[~apart].mean(0), x[~apart].std(0) + 1e-6
    z, t = (x - centre) / spread, y.astype(float)
    p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    a, b = z[~apart], t[~apart]
    for step in range(1, rounds + 1):
        h = np.tanh(a @ p[0] + p[1])
        g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - b) / len(b)
        back = np.outer(g, p[2]) * (1 - h * h)
        for k, d in enumerate((a.T @ back + decay * p[0], back.sum(0), h.T @ g + decay * p[2], g.sum(keepdims=True))):
            first[k], second[k] = 0.9 * first[k] + 0.1 * d, 0.999 * second[k] + 0.001 * d * d
            p[k] = p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model = {"centre": centre, "spread": spread, "p": p, "temperature": 1.0}
    if apart.sum() >= 20:
        logit, t = _logits(model, x[apart]), t[apart]
        grid = np.exp(np.linspace(-1.5, 2.5, 81))
        model["temperature"] = float(min(grid, key=lambda c: np.mean(np.logaddexp(0, logit / c) - t * logit / c)))
    return model


def _logits(model: dict, x: np.ndarray) -> np.ndarray:
    p = model["p"]
    return np.tanh((x - model["centre"]) / model["spread"] @ p[0] + p[1]) @ p[2] + p[3]


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", rows: int = 20000) -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1), predicted (score >= 0.3).

    Word vectors come from every text. Words share WORDS vectors by hash, so the table that goes to the driver and to
    every task is as large at any vocabulary (WORDS x DIM numbers); words that meet in one get a mean of their
    contexts, which the pooled features, sums over many words, bear. The network learns from at most `rows` labelled rows outside the
    held-out fold (crc32 of the id's text divisible by 5), drawn by hash. Scores come from the whole text alone.

    Null or empty text scores as a text without words. Null id: scored, id null, held_out false. Repeated
    rows score alike. Without labels of both kinds every score is the share of label 1 (0 without labels).
    An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    known = training_labels(labels, label, id_col)
    n, good = known.agg(F.count("*"), F.sum("y")).first()
    share = (good or 0) / n if n else 0.0
    vectors = spark.sparkContext.broadcast(word_vectors(docs, text_col) if 0 < share < 1 else np.zeros((WORDS, DIM), np.float32))
    got = collected(sampled_rows(docs, sample(known, rows, 3), id_col, text_col), lambda d, o: [r.tobytes() for r in pooled(vectors.value, d, o)]) if 0 < share < 1 else []
    x, y = np.array([np.frombuffer(r[2]) for r in got]), np.array([r[1] for r in got])
    model = spark.sparkContext.broadcast(fit(x, y) if len(set(y.tolist())) > 1 else None)

    def score(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if model.value is None:
            return np.full(len(offsets) - 1, share)
        logit = _logits(model.value, pooled(vectors.value, data, offsets)) / model.value["temperature"]
        return 1 / (1 + np.exp(-np.clip(logit, -700, 700)))

    return verdict(scored(docs, score, id_col, text_col), 0.3, id_col)
