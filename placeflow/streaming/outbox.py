"""Messages of finished jobs: an outbox written with the verdicts, and drained so that no message is sent twice."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import state as S
from ..functions import variant as V
from ..session import written
from ..sources.snapshots import Store, with_id

MESSAGE = "message_id string, job_id string, user_id string, status string, place_name string, pin_id string, source_added boolean"
DELIVERY = "message_id string, job_id string, status string, error string, token_present boolean, batch long"
# fixed value: what a device's token looks like
TOKEN = r"^(Expo(nent)?PushToken\[.*\]|(?i)[a-z\d]{8}-[a-z\d]{4}-[a-z\d]{4}-[a-z\d]{4}-[a-z\d]{12})$"
INTERRUPTED = "interrupted: it may have been sent"

Dispatch = Callable[[DataFrame], DataFrame]


def messages(verdicts: DataFrame) -> DataFrame:
    """A row of the outbox for each verdict (job_id, user_id, status, place_name, pin_id, source_added) that has a message; its id is the job's and the status's, so a verdict written again is the same message."""
    told = verdicts.filter(S.push_message(F.col("status"), F.col("source_added"), F.col("place_name")).isNotNull())
    return with_id(told, "job_id", "status", name="message_id").select(*[f.split(" ")[0] for f in MESSAGE.split(", ")])


def ticket_error(answer) -> F.Column:
    """The detail of the first ticket (JSON array) that is an error; null if none is."""
    bad = F.get(F.filter(V.items(V.parsed(answer)), lambda t: F.try_variant_get(t, "$.status", "string") == "error"), F.lit(0))
    some = lambda p: F.nullif(F.try_variant_get(bad, p, "string"), F.lit(""))
    return F.when(bad.isNotNull(), F.coalesce(some("$.details.error"), some("$.message"), F.lit("unknown")))


def drain(store: Store, outbox: str, tokens: DataFrame, dispatch: Dispatch, checkpoint: str, table: str = "deliveries", buckets: int = 16, at_once: int = 1000) -> StreamingQuery:
    """Sends the outbox's messages, each once, and keeps how each fared: message_id, job_id, status, error, token_present, batch.

    status is no_token (the user has none, or none that is a token), sent, dispatch_failed (the call failed) or ticket_error.
    Tokens: user_id, token. dispatch gets rows (message_id, token, type, title, body, job_id, pin_id) and gives
    (message_id, answer, error): the tickets as JSON, or why the call failed; a row it leaves out failed.

    A batch first commits a claim of each message that has no row yet, then sends, then commits how it went. A batch that died
    in between runs again and finds its claims: those messages may have gone out, so they are not sent again but count as
    dispatch_failed. Messages that a later file of the outbox repeats have a row already and are left alone.
    """
    spark = store.spark
    if not store.version(table):
        store.commit(table, spark.createDataFrame([], DELIVERY), 0, "message_id", buckets)
    token = tokens.groupBy("user_id").agg(F.min("token").alias("token"))

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(["message_id"])
        seen = store.read(table).select("message_id", F.col("status").alias("_had"))
        rows = written(rows.join(seen, "message_id", "left").join(token, "user_id", "left").withColumn("batch", F.lit(number).cast("long")))
        status = F.when(F.col("_had") == "claimed", "dispatch_failed").otherwise("claimed")
        error = F.when(F.col("_had") == "claimed", INTERRUPTED)
        fresh = rows.filter("_had is null")
        store.upsert(table, rows.filter("_had is null or _had = 'claimed'").select("message_id", "job_id", status.alias("status"), error.alias("error"), F.col("token").isNotNull().alias("token_present"), "batch"))
        message = S.push_message(F.col("status"), F.col("source_added"), F.col("place_name"))
        fine = F.coalesce(F.col("token").rlike(TOKEN), F.lit(False))
        asked = fresh.filter(fine).select("message_id", "token", message.alias("m"), "job_id", "pin_id").select("message_id", "token", "m.*", "job_id", "pin_id")
        answers = written(dispatch(asked).select("message_id", "answer", F.col("error").alias("_error")))
        out = fresh.join(answers.withColumn("_there", F.lit(True)), "message_id", "left")
        bad = ticket_error(F.col("answer"))
        failed = F.when(F.col("_there").isNull(), "no answer").otherwise(F.col("_error"))
        status = F.when(~fine, "no_token").when(failed.isNotNull(), "dispatch_failed").when(bad.isNotNull(), "ticket_error").otherwise("sent")
        why = F.when(~fine, F.when(F.coalesce("token", F.lit("")) != "", "Invalid token format")).otherwise(F.coalesce(failed, bad))
        store.upsert(table, out.select("message_id", "job_id", status.alias("status"), why.alias("error"), (F.coalesce("token", F.lit("")) != "").alias("token_present"), "batch"))

    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", at_once).parquet(outbox).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
