"""The job state machine in batch form, and the aggregates around it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import state as S


def claims(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests (job_id, user_id, url, admin, pos) against stored jobs, in order of pos: code, run; at most one runs per job.

    The first request that may run turns the job to processing; later ones of the same job see that.
    """
    j = jobs.select("job_id", F.lit(True).alias("_found"), F.col("user_id").alias("_u"), F.col("url").alias("_l"), F.col("status").alias("_s"))
    out = requests.join(j, "job_id", "left").withColumn("_found", F.coalesce("_found", F.lit(False)))
    same = F.col("user_id").eqNullSafe(F.col("_u")) & F.col("url").eqNullSafe(F.col("_l"))
    out = out.withColumn("o", S.claim_outcome(F.col("_found"), same, F.col("_s"), F.col("admin")))
    order = Window.partitionBy("job_id").orderBy("pos")
    winner = F.first(F.when(F.col("o.run"), F.struct("pos", "user_id", "url")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = out.withColumn("_w", winner)
    lost = F.coalesce(F.col("_w.pos") < F.col("pos"), F.lit(False))
    agrees = F.col("user_id").eqNullSafe(F.col("_w.user_id")) & F.col("url").eqNullSafe(F.col("_w.url"))
    code = F.when(lost, F.when(agrees, 202).otherwise(403)).otherwise(F.col("o.code"))
    return out.select(*requests.columns, code.alias("code"), (F.col("o.run") & ~lost).alias("run"))


def sweep(jobs: DataFrame, now: Column) -> DataFrame:
    """Processing jobs that are silent or too old, failed with a reason. Jobs: job_id, status, updated_at, created_at."""
    return jobs.filter(S.stale(F.col("status"), F.col("updated_at"), F.col("created_at"), now)).select("job_id", F.lit("failed").alias("status"), F.lit("timeout").alias("failure_reason"))


def trip_signals(saved: DataFrame) -> DataFrame:
    """(signal_id, pin_count, categories, last_save) of newly saved pins: user_id, city, country, category, created_at, pin_id.

    Categories stand in order of first saving.
    """
    saves = saved.groupBy("user_id", "city", "country", "category").agg(F.count("*").alias("n"), F.min(F.struct("created_at", "pin_id")).alias("first"), F.max("created_at").alias("last"))
    # ids are derived once for each place and user, not for each save
    rows = saves.withColumn("signal_id", S.signal_id(F.col("user_id"), F.col("city"), F.col("country"))).filter("signal_id is not null")
    each = rows.groupBy("signal_id", "category").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))
    order = F.array_sort(F.collect_list(F.when(F.col("category").isNotNull(), F.struct("first", "category"))))
    return each.groupBy("signal_id").agg(F.sum("n").alias("pin_count"), F.transform(order, lambda x: x["category"]).alias("categories"), F.max("last").alias("last_save"))


def with_signal(pins: DataFrame, signals: DataFrame) -> DataFrame:
    """Pins with their trip signal's id and status; one that isn't there yet, or has an unknown status, is 'planning'."""
    out = pins.withColumn("signal_id", S.signal_id(F.col("user_id"), F.col("city"), F.col("country"))).join(signals.select("signal_id", F.col("status").alias("_s")), "signal_id", "left")
    known = F.when(F.col("_s").isin("planning", "traveling", "returned"), F.col("_s")).otherwise("planning")
    return out.withColumn("trip_status", F.when(F.col("signal_id").isNotNull(), known)).drop("_s")


def new_signals(pins: DataFrame, signals: DataFrame) -> DataFrame:
    """Seeds of signals that pins need and the table lacks."""
    need = pins.select(S.signal_id(F.col("user_id"), F.col("city"), F.col("country")).alias("signal_id")).filter("signal_id is not null").distinct()
    return need.join(signals, "signal_id", "left_anti").select("signal_id", F.lit("planning").alias("status"), F.lit("low").alias("confidence"), F.lit(0).alias("pin_count"), F.array().cast("array<string>").alias("categories"))


def deliveries(attempts: DataFrame) -> DataFrame:
    """(job_id, attempts, status, last_error) of delivery attempts: job_id, at, status, error."""
    return attempts.groupBy("job_id").agg(F.count("*").alias("attempts"), F.max_by("status", "at").alias("status"), F.max_by("error", "at").alias("last_error"))


def stage_failures(failures: DataFrame) -> DataFrame:
    """Failures of each job in order of time, equal ones once: job_id, stage, message, at."""
    each = failures.select("job_id", "at", "stage", S.error_kind(F.col("message")).alias("kind"), F.substring("message", 1, 500).alias("message")).distinct()
    return each.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("at", "stage", "kind", "message"))).alias("failures"))
