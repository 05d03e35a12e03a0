"""What both classifiers share: a bounded sample of labelled rows, and scoring whole texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blobs, held_out, pieces, strings

Features = Callable[[np.ndarray, np.ndarray], list[bytes]]


def training_labels(labels: DataFrame, label: str, id_col: str = "doc_id") -> DataFrame:
    """(id, y) of labelled rows outside the held-out fold; null ids and labels are left out."""
    rows = labels.select(id_col, label).filter(F.col(id_col).isNotNull() & F.col(label).isNotNull() & ~held_out(id_col))
    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(label).cast("int").alias("y"))


def sample(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """At most `most` rows, the first by a hash of their id."""
    return rows.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(most)


def _mapped(features: Features):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(2))
            for i, j in pieces(offsets, 1 << 20):
                at = offsets[i : j + 1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), blobs(features(data[at[0] : at[-1]], at - at[0]))], names=["id", "y", "x"])

    return run


def text_key(text_col: str = "text") -> list:
    """Two hashes that stand for a text; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def sampled_rows(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, y, text) of the chosen (id, y), a bounded table: one row per id, and per y one row of equal texts.

    Of an id's different texts the one with the least hash stays, of equal texts the least id.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen.distinct()), "id")
    rows = rows.select("id", "y", "text", *text_key())
    one = rows.groupBy("id", "y").agg(F.min_by(F.struct("text", "k1", "k2"), F.struct("k1", "k2")).alias("r")).select("id", "y", "r.*")
    return one.groupBy("y", "k1", "k2").agg(F.min("id").alias("id"), F.first("text").alias("text")).select("id", "y", "text")


def collected(rows: DataFrame, features: Features) -> list:
    """(id, y, features) of sampled rows, in order of id."""
    got = rows.mapInArrow(_mapped(features), "id long, y int, x binary").collect()
    return sorted(((r["id"], r["y"], bytes(r["x"])) for r in got))


def scored(docs: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], id_col: str, text_col: str, schema: str = "long", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, score) of every row, and its columns `keep`; score maps bytes and offsets of many texts to doubles."""
    more = [c for c in keep if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            out = np.zeros(len(batch))
            for i, j in pieces(offsets, 1 << 20):
                at = offsets[i : j + 1]
                out[i:j] = score(data[at[0] : at[-1]], at - at[0])
            kept = [batch.column(1 if c == text_col else 2 + more.index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), *kept], names=["_id", "_score", *keep])

    fields = ["_id long", "_score double", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)]
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *more).mapInArrow(run, ", ".join(fields))
    return rows.select(F.col("_id").alias("id"), F.col("_score").alias("score"), *keep)


def verdict(scores: DataFrame, cut: float, id_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return scores.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"), *keep)
