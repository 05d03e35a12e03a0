"""Stored tables: writes that touch the buckets of their keys, and the feed of what each version changed."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import functions as F

from ..operators import backfill as B
from ..operators import locks
from ..operators.members import reconciled
from ..operators.paged import backfill
from ..session import shared_dir
from ..sources.snapshots import Store, with_id
from ..sources.tables import frame, sql
from ..streaming import caching as C
from ..streaming import feed as D
from ..streaming import outbox as O
from .places import _CATEGORY
from .registry import query

NOW = "2024-01-15 00:00:00"


def _store(spark) -> Store:
    return Store(spark, f"{shared_dir(spark)}/placeflow-{uuid.uuid4().hex}")


_JOBS = f"""SELECT job_id, k, CASE WHEN k % 13 = 0 THEN '' ELSE user_id END AS user_id, CASE WHEN k % 11 <> 0 THEN concat('https://a.example/p/', k) END AS url, status, TIMESTAMP '{NOW}' - (k % 40) * INTERVAL '1' MINUTE AS created_at, CAST(NULL AS STRING) AS failure_reason
  FROM (SELECT job_id, user_id, status, CAST(substring(job_id, 2) AS BIGINT) AS k FROM <jobs>) x"""

_FEED = f"""WITH b AS (SELECT *, k % 4 <> 0 AS in1, k % 4 <> 0 OR k % 8 = 0 AS in2, (k % 4 <> 0 OR k % 8 = 0) AND k % 7 <> 0 AS in3 FROM ({_JOBS.replace('AS STRING', 'AS VARCHAR')}) j),
o AS (SELECT *, in3 OR k % 8 = 4 OR (k % 7 = 0 AND k % 3 = 0) AS in4, CASE WHEN in1 AND status = 'pending' AND k % 5 = 0 THEN 'processing' ELSE status END AS s2,
  CASE WHEN status <> 'pending' THEN 'skip' WHEN coalesce(url, '') = '' OR user_id = '' THEN 'malformed_pending_doc' WHEN k % 40 > 30 THEN 'cloud_function_max_retry_exceeded' WHEN k % 6 < 2 THEN 'ok' WHEN k % 6 = 2 THEN 'enrich_http_404' ELSE 'retry' END AS outcome FROM b),
s AS (SELECT *, CASE WHEN in3 THEN s2 ELSE status END AS s4 FROM o)
SELECT job_id, 1::BIGINT AS version, 'created' AS op, NULL AS before_status, status AS after_status, outcome FROM s WHERE in1
UNION ALL SELECT job_id, 2, 'created', NULL, status, outcome FROM s WHERE in2 AND NOT in1
UNION ALL SELECT job_id, 2, 'changed', status, s2, NULL FROM s WHERE in1 AND s2 <> status
UNION ALL SELECT job_id, 3, 'removed', s2, NULL, NULL FROM s WHERE in2 AND NOT in3
UNION ALL SELECT job_id, 4, 'created', NULL, status, outcome FROM s WHERE in4 AND NOT in3
UNION ALL SELECT job_id, 5, 'changed', 'pending', 'failed', NULL FROM s WHERE in4 AND s4 = 'pending' AND outcome NOT IN ('ok', 'skip', 'retry')"""


def fed(spark, sf_dir, store: Store, buckets: int = 16):
    """All jobs written in four versions and handled through the feed, which is started again in the middle; the failures are a fifth version."""
    jobs, k = sql(spark, sf_dir, _JOBS), F.col("k")
    calls = jobs.select("job_id", F.when(k % 6 == 0, 200).when(k % 6 == 1, 202).when(k % 6 == 2, 404).when(k % 6 == 3, 503).when(k % 6 == 4, 301).alias("http")).filter("http is not null")
    now = F.lit(NOW).cast("timestamp")
    checkpoint, sink = f"{store.root}/checkpoint", f"{store.root}/handled"
    pump = lambda: D.feed(store, "jobs", checkpoint, sink, lambda rows: D.created_jobs(rows, calls, now)).awaitTermination()
    store.commit("jobs", jobs.filter(k % 4 != 0), 0, "job_id", buckets)
    started = store.read("jobs").filter((F.col("status") == "pending") & (k % 5 == 0)).withColumn("status", F.lit("processing"))
    store.upsert("jobs", started.unionByName(jobs.filter(k % 8 == 0)))
    pump()
    store.delete("jobs", jobs.filter(k % 7 == 0).select("job_id"))
    store.upsert("jobs", jobs.filter((k % 8 == 4) | ((k % 7 == 0) & (k % 3 == 0))))
    pump()
    D.settle(store, "jobs", spark.read.parquet(sink))
    pump()
    return spark.read.parquet(sink)


@query(_FEED)
def change_feed(spark, sf_dir):
    """Every change of every job, once, with what the on-created handler did."""
    handled = fed(spark, sf_dir, _store(spark))
    return handled.select("job_id", "version", "op", F.col("before.status").alias("before_status"), F.col("after.status").alias("after_status"), "outcome")


_NEW = "SELECT s_suppkey AS k, concat('extra ', s_suppkey) AS name, concat('U', s_nationkey) AS owner_id FROM <supplier> WHERE s_suppkey % 4 = 1"


@query(f"""WITH c AS (SELECT list_id, count(*) AS n FROM <members> GROUP BY list_id), l AS (SELECT l.list_id, owner_id, name, coalesce(c.n, 0)::BIGINT AS pin_count FROM <lists> l LEFT JOIN c ON c.list_id = l.list_id WHERE substring(l.list_id, 2)::BIGINT % 9 <> 3)
SELECT list_id, owner_id, name, pin_count FROM l UNION ALL SELECT sha256(name || chr(31) || owner_id), owner_id, name, 0 FROM ({_NEW}) x""")
def stored_lists(spark, sf_dir):
    """All lists stored in buckets: counts mended by a patch of the lists that are wrong, some removed by key, others added under derived ids."""
    store = _store(spark)
    lists = frame(spark, sf_dir, "lists").withColumn("pin_count", F.col("pin_count").cast("long"))
    store.commit("lists", lists, 0, "list_id", 16)
    found = reconciled(store.read("lists"), frame(spark, sf_dir, "members")).filter("outcome = 'updated'")
    store.upsert("lists", found.select("list_id", F.col("actual").alias("pin_count")))
    store.delete("lists", lists.filter(F.substring("list_id", 2, 20).cast("long") % 9 == 3).select("list_id"))
    fresh = with_id(sql(spark, sf_dir, _NEW), "name", "owner_id", name="list_id").withColumn("pin_count", F.lit(0).cast("long"))
    store.upsert("lists", fresh.select(lists.columns))
    return store.read("lists")


def cache_requests(spark, sf_dir):
    """Every event as a request: views and clicks read one of a user's keys, the others write it."""
    e, c = frame(spark, sf_dir, "events"), F.col
    reads = c("event_type").isin("view", "click")
    return e.select(c("event_id").cast("long").alias("pos"), c("ts").cast("timestamp").alias("at"), F.when(reads, "get").otherwise("set").alias("op"), F.concat_ws("-", "user_id", c("event_id") % 10).alias("key"), F.when(~reads, F.concat(F.lit("v"), c("event_id"))).alias("value"))


@query()
def cache_answers(spark, sf_dir):
    """Every event asked of the cache in order of time, the stream started again in its middle. No oracle: each answer hangs on those before; the tests hold a loop against it."""
    root = f"{shared_dir(spark)}/placeflow-{uuid.uuid4().hex}"
    asked = cache_requests(spark, sf_dir)
    asked = asked.withColumn("pos", F.unix_micros("at"))
    middle = asked.agg(F.percentile_approx("pos", 0.5)).first()[0]
    stream = spark.readStream.schema(asked.schema).parquet(f"{root}/in/*")
    for part, test in (("a", F.col("pos") <= (middle or 0)), ("b", F.col("pos") > (middle or 0))):
        asked.filter(test).write.parquet(f"{root}/in/{part}")
        C.answer(stream, f"{root}/out", f"{root}/checkpoint", shards=8, most=10, ttl_s=3 * 24 * 3600)
    return spark.read.schema(C.OUT).parquet(f"{root}/out")


_TYPED = """SELECT pin_id, k, n.place_id, category, enrichment_version, CASE WHEN k % 2 = 0 THEN types_csv END AS csv FROM (SELECT *, CAST(substring(pin_id, 2) AS BIGINT) AS k FROM <pins>) n LEFT JOIN <places> pl ON pl.place_id = n.place_id"""
_PLAN6 = f"""(SELECT n.pin_id, n.csv, d.types_csv AS csv2, d.primary_type AS p2, CASE WHEN {_CATEGORY} <> 'other' THEN 'skippedAlreadyPopulated' WHEN d.place_id IS NULL THEN 'failures' WHEN d.types_csv IS NULL AND d.primary_type IS NULL THEN 'skippedNoApiSignal' WHEN k % 11 = 0 THEN 'raced' ELSE 'updated' END AS outcome, k
  FROM (SELECT *, NULL::VARCHAR AS p FROM ({_TYPED}) x) n LEFT JOIN <places> d ON d.place_id = n.place_id AND substring(d.place_id, 3)::BIGINT % 7 <> 0)"""


@query(f"""SELECT 'pin' AS part, pin_id AS name, CASE WHEN outcome = 'updated' THEN coalesce(csv2, '') WHEN k % 11 = 0 THEN 'museum' ELSE coalesce(csv, '') END AS types, CASE WHEN outcome = 'updated' THEN p2 END AS primary_type, NULL::BIGINT AS n FROM {_PLAN6} p
UNION ALL SELECT 'count', outcome, NULL, NULL, count(*) FROM {_PLAN6} p GROUP BY outcome""")
def paged_place_types(spark, sf_dir):
    """Types of all stored pins from details, by pages: another job takes the lock in the middle, the run goes on later, and somebody else changes pins meanwhile."""
    store = _store(spark)
    pins = sql(spark, sf_dir, _TYPED).select("pin_id", "place_id", F.split("csv", ",").alias("types"), F.lit(None).cast("string").alias("primary_type"))
    store.commit("pins", pins, 0, "pin_id", 6)
    places = frame(spark, sf_dir, "places").filter(F.substring("place_id", 3, 20).cast("long") % 7 != 0).select("place_id", F.split("types_csv", ",").alias("types"), "primary_type")
    minute, stolen = [0], []

    def clock() -> datetime:
        minute[0] += 1
        return datetime(2024, 1, 1, minute[0] // 60, minute[0] % 60)

    def meanwhile(page: set[int]) -> None:
        if 2 in page and not stolen:
            stolen.append(locks.acquire(store, "placeTypes", "other", datetime(2024, 1, 2)))
        else:
            store.upsert("pins", store.read("pins", None, page).filter(F.substring("pin_id", 2, 20).cast("long") % 11 == 0).withColumn("types", F.array(F.lit("museum"))))

    def run() -> dict:
        return backfill(store, "pins", "placeTypes", lambda rows: B.retype(rows, places), {"types": "new_types", "primary_type": "new_primary"}, ["types", "primary_type"], clock, size=2, planned=meanwhile)

    run()
    locks.release(store, "placeTypes", "other")
    report = run()
    held = store.read("pins").select(F.lit("pin").alias("part"), F.col("pin_id").alias("name"), F.coalesce(F.array_join("types", ","), F.lit("")).alias("types"), "primary_type", F.lit(None).cast("long").alias("n"))
    counts = spark.createDataFrame([("count", o, None, None, n) for o, n in report["counts"].items()], "part string, name string, types string, primary_type string, n long")  # a row per outcome
    return held.unionAll(counts)


@query("""SELECT pin_id, CASE WHEN enrichment_version IS DISTINCT FROM 4 AND l.place_id IS NOT NULL THEN 4 ELSE enrichment_version END::BIGINT AS enrichment_version, CASE WHEN enrichment_version IS DISTINCT FROM 4 THEN place_name END AS place_name FROM <pins> n LEFT JOIN <places> l ON l.place_id = n.place_id""")
def paged_refresh(spark, sf_dir):
    """Details of all stored pins of another version fetched again and written, with the new version, by pages."""
    store = _store(spark)
    pins = frame(spark, sf_dir, "pins").select("pin_id", "place_id", F.col("enrichment_version").cast("long").alias("enrichment_version"), F.lit(None).cast("string").alias("place_name"))
    store.commit("pins", pins, 0, "pin_id", 4)
    details = frame(spark, sf_dir, "places").select("place_id", "place_name")
    names = details.select("place_id", F.col("place_name").alias("new_name"))
    derive = lambda rows: B.refresh_details(rows, details).join(names, "place_id", "left").withColumn("new_version", F.lit(4).cast("long"))
    backfill(store, "pins", "mealTypes", derive, {"enrichment_version": "new_version", "place_name": "new_name"}, ["place_id", "enrichment_version"], lambda: datetime(2024, 1, 1), size=2)
    return store.read("pins").select("pin_id", "enrichment_version", "place_name")


_VERDICTS = "SELECT job_id, user_id, status, CASE WHEN k % 2 = 0 THEN 'Joe' END AS place_name, concat('P', k) AS pin_id, k % 3 = 0 AS source_added, k FROM (SELECT *, CAST(substring(job_id, 2) AS BIGINT) AS k FROM <jobs>) x"
_TOKENS = "SELECT user_id, CASE n % 5 WHEN 0 THEN 'wrong' WHEN 1 THEN '' ELSE concat('ExponentPushToken[', user_id, ']') END AS token, n FROM (SELECT user_id, CAST(substring(user_id, 2) AS BIGINT) AS n FROM <users>) x WHERE n % 7 <> 3"


@query(f"""SELECT job_id, status AS told, CASE WHEN coalesce(t.n % 5, 0) < 2 THEN 'no_token' WHEN k % 4 = 0 THEN 'dispatch_failed' WHEN k % 4 = 1 THEN 'ticket_error' ELSE 'sent' END AS status,
  CASE WHEN coalesce(t.n % 5, 0) < 2 THEN CASE WHEN token <> '' THEN 'Invalid token format' END WHEN k % 4 = 0 THEN CASE WHEN k % 8 = 0 THEN 'ECONNREFUSED' ELSE 'no answer' END WHEN k % 4 = 1 THEN CASE WHEN k % 8 = 1 THEN 'DeviceNotRegistered' ELSE 'too big' END END AS error, coalesce(token, '') <> '' AS token_present
FROM ({_VERDICTS}) v LEFT JOIN ({_TOKENS}) t ON t.user_id = v.user_id WHERE status IN ('complete', 'duplicate', 'failed')""")
def push_deliveries(spark, sf_dir):
    """The message of every finished job, written to the outbox in two parts, of which the second repeats some of the first, and drained in two runs."""
    store, root = _store(spark), f"{shared_dir(spark)}/placeflow-{uuid.uuid4().hex}"
    verdicts = sql(spark, sf_dir, _VERDICTS)

    def provider(asked):
        k = F.substring("job_id", 2, 20).cast("long")
        error = F.when(k % 8 == 1, '{"status":"error","message":"m","details":{"error":"DeviceNotRegistered"}}').otherwise('{"status":"error","message":"too big"}')
        answer = F.concat(F.lit('[{"status":"ok"}'), F.when(k % 4 == 1, F.concat(F.lit(","), error)).otherwise(""), F.lit("]"))
        return asked.filter(k % 8 != 4).select("message_id", F.when(k % 4 != 0, answer).alias("answer"), F.when(k % 4 == 0, "ECONNREFUSED").alias("error"))

    for test in (F.col("k") % 3 < 2, F.col("k") % 3 > 0):
        O.messages(verdicts.filter(test)).write.mode("append").parquet(f"{root}/outbox")
        O.drain(store, f"{root}/outbox", sql(spark, sf_dir, _TOKENS), provider, f"{root}/checkpoint").awaitTermination()
    told = O.messages(verdicts).select("message_id", F.col("status").alias("told"))
    return store.read("deliveries").join(told, "message_id").select("job_id", "told", "status", "error", "token_present")
