"""Streams of job events: claims with one winner a job, the on-created handler, and sweeps over a snapshot."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import state as S
from ..operators.jobs import sweep
from ..sources.snapshots import Store


KEEP_MS = 24 * 3600 * 1000  # far beyond the age at which a job is swept


def _claim(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    taken = state.exists
    rows = pd.concat(list(batches)).sort_values("pos")
    run = []
    for status in rows["status"]:
        wins = not taken and status in (None, "pending")
        taken = taken or wins
        run.append(wins)
    if taken and not state.exists:
        state.update((True,))
        state.setTimeoutDuration(KEEP_MS)
    yield pd.DataFrame({"job_id": rows["job_id"], "pos": rows["pos"], "run": run})


def claims(events: DataFrame) -> DataFrame:
    """(job_id, pos, run) of a stream of claims (job_id, pos, status): the first pending one of a job runs, over all batches.

    A job's claim is remembered for a day of processing time.
    """
    rows = events.select("job_id", F.col("pos").cast("long").alias("pos"), "status")
    return rows.groupBy("job_id").applyInPandasWithState(_claim, "job_id string, pos long, run boolean", "taken boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def handled(created: DataFrame) -> DataFrame:
    """The outcome of each created job (status, url, user_id, age_s, http), stateless."""
    return created.withColumn("outcome", S.created_outcome(F.col("status"), F.col("url"), F.col("user_id"), F.col("age_s"), F.col("http")))


def into(stream: DataFrame, store: Store, table: str, key: str, checkpoint: str, buckets: int = 16) -> StreamingQuery:
    """Merges each micro-batch into a snapshot, rewriting the buckets of its keys alone; a batch that ran before merges to the same rows."""

    def put(batch: DataFrame, _: int) -> None:
        newest = batch.groupBy(key).agg(*[F.max_by(c, "pos").alias(c) for c in batch.columns if c != key])
        if store.version(table):
            store.upsert(table, newest)
        else:
            store.commit(table, newest, 0, key, buckets)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def swept(store: Store, table: str, now) -> int:
    """A sweep of a snapshot of jobs at `now`; only the buckets of jobs that it fails are rewritten."""
    return store.upsert(table, sweep(store.read(table), now))
