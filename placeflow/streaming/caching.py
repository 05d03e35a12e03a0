"""A cache as keyed state: values expire, and each shard keeps a bounded number of them, first in first out."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "shard long, pos long, op string, key string, outcome string, value string, evicted string"
_NAMES = [c.split()[0] for c in OUT.split(", ")]
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


BATCH = 10_000  # answers handed on at once


def _in_order(frames: Iterator[pd.DataFrame]) -> pa.Table:
    """A shard's requests of a micro-batch in order of pos, packed in columns: as rows of Python they would take ten times the room."""
    schema = pa.schema([("pos", pa.int64()), ("ms", pa.int64()), ("op", pa.dictionary(pa.int8(), pa.string())), ("key", pa.string()), ("value", pa.string())])
    packed = [pa.RecordBatch.from_arrays([pa.array(f[c.name], pa.string() if c.name == "op" else c.type).cast(c.type) for c in schema], schema=schema) for f in frames]
    rows = pa.Table.from_batches(packed, schema)
    del packed
    return rows.take(pc.sort_indices(rows["pos"]))


class _Shard(StatefulProcessor):
    """State of a shard: entries by key (value, time, place in the queue), the queue's keys by place, and its ends, size and last write.

    A micro-batch reads the shard's entries once (they are at most most + 1), answers its requests from them, and writes back what is new,
    changed or gone. An event-time timer empties a shard whose newest write has expired, so that a shard nobody asks for
    holds nothing.
    """

    def __init__(self, most: int, ttl_ms: int):
        self.most, self.ttl = most, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "key string", "value string, at long, place long")
        self.queue = handle.getMapState("queue", "place long", "key string")
        self.ends = handle.getValueState("ends", "head long, tail long, size long, last long")

    def _clear(self) -> None:
        self.entries.clear()
        self.queue.clear()
        self.ends.clear()

    def _write(self, stored: dict, held: dict) -> None:
        """Brings the state from the entries it holds to others; a place in the queue belongs to one key for good."""
        for name, (_, _, place) in stored.items():
            now = held.get(name)
            if now is None:
                self.entries.removeKey((name,))
            if now is None or now[2] != place:
                self.queue.removeKey((place,))
        for name, entry in held.items():
            was = stored.get(name)
            if was != entry:
                self.entries.updateValue((name,), entry)
            if was is None or was[2] != entry[2]:
                self.queue.updateValue((entry[2],), (name,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        _, tail, _, last = self.ends.get() or (0, 0, 0, None)
        before, stored = last, {k[0]: tuple(v) for k, v in self.entries.iterator()}
        held = dict(sorted(stored.items(), key=lambda e: e[1][2]))  # in order of the queue
        for batch in _in_order(rows).to_batches(BATCH):
            out = []
            for pos, ms, op, name, value in zip(*[c.to_pylist() for c in batch.columns]):
                if last is not None and ms - last > self.ttl:
                    held.clear()
                    tail, last = 0, None
                found, evicted = held.get(name), None
                if op == "get":
                    outcome, value = "miss", None
                    if found is not None and ms - found[1] > self.ttl:
                        outcome = "expired"
                        del held[name]
                    elif found is not None:
                        outcome, value = "hit", found[0]
                else:
                    outcome = "stored"
                    if len(held) > self.most:
                        evicted = next(iter(held))
                        del held[evicted]
                        found = None if evicted == name else found
                    place = found[2] if found is not None else tail
                    tail += found is None
                    held[name] = (value, ms, place)
                    last = ms if last is None else max(last, ms)
                out.append((key[0], pos, op, name, outcome, value, evicted))
            yield pd.DataFrame(out, columns=_NAMES)
        self._write(stored, held)
        if last is not None:
            self.ends.update((next(iter(held.values()))[2] if held else tail, tail, len(held), last))
        elif before is not None:
            self.ends.clear()
        if last != before:
            if before is not None:
                self.handle.deleteTimer(before + self.ttl + 1)
            if last is not None:
                self.handle.registerTimer(last + self.ttl + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        ends = self.ends.get()
        if ends and expiredTimerInfo.getExpiryTimeInMs() > ends[3] + self.ttl:
            self._clear()
        return iter(())

    def close(self) -> None:
        pass


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(shards)).cast("long")


def cache(requests: DataFrame, shards: int = 64, most: int = 5000, ttl_s: int = 24 * 3600, late: str = "0 seconds") -> DataFrame:
    """A stream of requests (pos, at, op, key, value) answered by a cache: shard, pos, op, key, outcome, value, evicted.

    op is get or set. A get finds a value that is at most ttl_s old (hit), one that is older and goes (expired), or none
    (miss). A set stores a value (stored) under a key, which keeps its place in the queue if it has one; a shard that
    holds more than `most` keys first gives up the one that came first (evicted). A shard whose newest value has expired is
    empty. Keys go to shards by hash, so each shard's state is at most most + 1 entries and shards are independent; requests
    of a shard are taken in order of pos within a micro-batch, and micro-batches in theirs. Requests without a key or a
    known op are left out. Requests older than the watermark (the newest time less `late`) are dropped by it.

    Needs the RocksDB state store: start it inside rocks().
    """
    rows = requests.filter("key is not null and op in ('get', 'set')").select(F.col("pos").cast("long").alias("pos"), F.col("at").cast("timestamp").alias("at"), "op", "key", F.col("value").cast("string").alias("value"))
    rows = rows.withWatermark("at", late).withColumn("shard", shard_of(F.col("key"), shards)).withColumn("ms", F.unix_millis("at"))
    return rows.groupBy("shard").transformWithStateInPandas(_Shard(most, ttl_s * 1000), OUT, "Append", "EventTime")


@contextmanager
def rocks(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB; the session's setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def answer(requests: DataFrame, sink: str, checkpoint: str, **options) -> None:
    """Runs a stream of requests to its end, adding answers to a folder; a run that failed is taken up where it stopped."""
    with rocks(requests.sparkSession):
        query = cache(requests, **options).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
