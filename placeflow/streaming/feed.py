"""A change feed: a table's versions as a stream, each with the rows in which it differs from the one before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import state as S
from ..sources.snapshots import Store

FILES = "path string, modificationTime timestamp, length long, content binary"


def feed(store: Store, table: str, checkpoint: str, sink: str, handle: Callable[[DataFrame], DataFrame], at_once: int = 16) -> StreamingQuery:
    """Handles every change of a table once: (key, op, before, after, version) of each version to a folder of `sink`.

    The stream is of version files, so its checkpoint knows which versions were taken; what one changed is read from the
    buckets that differ. A batch that failed in its middle runs again and writes the same folders again. A new checkpoint
    replays the table from its first version. Versions that were vacuumed before they were read fail the stream.
    """
    versions = store.spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", at_once).load(f"{store.root}/{table}/versions")

    def put(batch: DataFrame, _: int) -> None:
        for v in sorted(int(r[0]) for r in batch.select(F.element_at(F.split("path", "/"), -1)).collect()):  # at most at_once numbers
            rows = store.changes(table, v - 1, v).withColumn("version", F.lit(v).cast("long"))
            handle(rows).write.mode("overwrite").parquet(f"{sink}/v={v}")

    return versions.select("path").writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def created_jobs(changes: DataFrame, calls: DataFrame, now) -> DataFrame:
    """Changes of a table of jobs (status, url, user_id, created_at), those of new jobs with the outcome of the on-created handler.

    Calls (job_id, http) hold what the dispatched request answered; no row is a network error, to be tried again.
    """
    answers = calls.groupBy(F.col("job_id").alias("_j")).agg(F.min("http").alias("_http"))
    rows = changes.join(answers, F.col("job_id") == F.col("_j"), "left")
    j = F.col("after")
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(j["created_at"].cast("timestamp"))
    outcome = S.created_outcome(j["status"], j["url"], j["user_id"], age, F.col("_http"))
    return rows.withColumn("outcome", F.when(F.col("op") == "created", outcome)).drop("_j", "_http")


def settle(store: Store, table: str, handled: DataFrame) -> int:
    """Writes the failures of handled changes (job_id, outcome) back: a job that is still pending fails with the outcome as its reason."""
    bad = handled.filter(F.col("outcome").isNotNull() & ~F.col("outcome").isin("ok", "skip", "retry")).groupBy("job_id").agg(F.max("outcome").alias("_why"))

    def change(now: DataFrame, rows: DataFrame) -> DataFrame:
        hit = F.col("_why").isNotNull() & F.coalesce(F.col("status") == "pending", F.lit(False))
        out = now.join(rows, "job_id", "left").withColumn("failure_reason", F.when(hit, F.col("_why")).otherwise(F.col("failure_reason")))
        return out.withColumn("status", F.when(hit, "failed").otherwise(F.col("status"))).select(now.columns)

    return store.patch(table, bad, change)
