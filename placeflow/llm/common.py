"""Shared plumbing: tables in the cluster's shared folder, and Arrow batches in bounded pieces."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, ship

WORD = r"[^\x20\x09-\x0D]+"


_open: ContextVar[list[Scratch] | None] = ContextVar("open", default=None)


@contextmanager
def temporary() -> Iterator[None]:
    """Drops, at its end, all tables that operators wrote inside; what they return must be written by then."""
    held: list[Scratch] = []
    token = _open.set(held)
    try:
        yield
    finally:
        _open.reset(token)
        for scratch in held:
            scratch.clear()


class Scratch:
    """Written tables that cut lineage: they survive lost executors and are dropped once nothing reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = ship(spark), f"{shared_dir(spark)}/placeflow-{uuid.uuid4().hex}", 0
        if (held := _open.get()) is not None:
            held.append(self)

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/t{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self._delete(t._scratch_path)

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (UTF-8) of a string or binary column, and int64 offsets; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    buffers = column.buffers()
    at = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def blobs(rows: list[bytes | None]) -> pa.Array:
    return pa.array(rows, pa.binary())


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id's decimal text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))
