"""Queries over the job state machine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import state as S
from ..operators import jobs as J
from ..sources.tables import frame
from .registry import query, rows, values

NOW = "2024-01-15 00:00:00"


@query(f"SELECT job_id, 'failed' AS status, 'timeout' AS failure_reason FROM <jobs> WHERE status = 'processing' AND (created_at + INTERVAL (value::INT) MINUTE < TIMESTAMP '{NOW}' - INTERVAL 2 MINUTE OR created_at < TIMESTAMP '{NOW}' - INTERVAL 30 MINUTE)")
def job_sweep(spark, sf_dir):
    # the SQL's cast rounds, half to even
    jobs = frame(spark, sf_dir, "jobs").withColumn("updated_at", F.col("created_at") + F.make_dt_interval(mins=F.rint("value").cast("int")))
    return J.sweep(jobs, F.lit(NOW).cast("timestamp_ntz"))


_CLAIMS = "(SELECT event_id AS pos, concat('J', event_id % 700) AS job_id, concat('U', user_id) AS user_id, 'u' AS url, event_id % 5 = 0 AS admin FROM events)"



@query(f"""WITH r AS (SELECT c.*, j.job_id IS NOT NULL AS found, j.user_id AS ju, j.status FROM {_CLAIMS} c LEFT JOIN (SELECT job_id, user_id, status FROM <jobs> WHERE substring(job_id, 2)::BIGINT < 500) j ON j.job_id = c.job_id),
a AS (SELECT *, CASE WHEN found AND user_id <> ju THEN 403 WHEN found AND status = 'processing' THEN 202 WHEN found AND status <> 'pending' THEN 200 WHEN found THEN 202 WHEN admin THEN 403 ELSE 202 END AS code,
  CASE WHEN found THEN user_id = ju AND status = 'pending' ELSE NOT admin END AS can FROM r),
w AS (SELECT job_id, min(pos) AS pos, arg_min(user_id, pos) AS wu FROM a WHERE can GROUP BY job_id)
SELECT a.pos::BIGINT AS pos, CASE WHEN w.pos < a.pos THEN CASE WHEN a.user_id = wu THEN 202 ELSE 403 END ELSE code END::BIGINT AS code, can AND w.pos = a.pos AS run FROM a LEFT JOIN w ON w.job_id = a.job_id""".replace("can AND w.pos = a.pos AS run", "can AND coalesce(w.pos = a.pos, false) AS run"))
def job_claim(spark, sf_dir):
    e = frame(spark, sf_dir, "events")
    reqs = e.select(F.col("event_id").cast("long").alias("pos"), F.concat(F.lit("J"), F.col("event_id") % 700).alias("job_id"), F.concat(F.lit("U"), "user_id").alias("user_id"), F.lit("u").alias("url"), (F.col("event_id") % 5 == 0).alias("admin"))
    jobs = frame(spark, sf_dir, "jobs").filter(F.substring("job_id", 2, 20).cast("long") < 500).withColumn("url", F.lit("u"))
    return J.claims(reqs, jobs).select("pos", F.col("code").cast("long").alias("code"), "run")


CREATED = [(1, "processing", "u", "a", 0, 200), (2, "pending", None, "a", 0, 200), (3, "pending", "u", "", 0, 200), (4, "pending", "u", "a", 1801, 200), (5, "pending", "u", "a", 1800, 202), (6, "pending", "u", "a", 5, 404), (7, "pending", "u", "a", 5, 503), (8, "pending", "u", "a", 5, None), (9, "pending", "u", "a", 5, 301)]


_CREATED = f"""(SELECT k AS id, status, CASE WHEN k % 11 <> 0 THEN 'u' END AS url, CASE WHEN k % 13 = 0 THEN '' ELSE user_id END AS usr, (k * 37) % 2000 AS age, CASE k % 6 WHEN 0 THEN 200 WHEN 1 THEN 202 WHEN 2 THEN 404 WHEN 3 THEN 503 WHEN 4 THEN 301 END AS http FROM (SELECT *, substring(job_id, 2)::BIGINT AS k FROM <jobs>)
  UNION ALL SELECT -id, status, url, usr, age, http FROM {values(CREATED, 'id', 'status', 'url', 'usr', 'age', 'http')})"""


@query(f"""SELECT id::BIGINT AS id, CASE WHEN status <> 'pending' THEN 'skip' WHEN coalesce(url, '') = '' OR coalesce(usr, '') = '' THEN 'malformed_pending_doc' WHEN age > 1800 THEN 'cloud_function_max_retry_exceeded' WHEN http IN (200, 202) THEN 'ok' WHEN http >= 400 AND http < 500 THEN 'enrich_http_' || http ELSE 'retry' END AS outcome FROM {_CREATED}""")
def created_handler_outcome(spark, sf_dir):
    c, k = F.col, F.substring("job_id", 2, 20).cast("long")
    http = F.when(k % 6 == 0, 200).when(k % 6 == 1, 202).when(k % 6 == 2, 404).when(k % 6 == 3, 503).when(k % 6 == 4, 301)
    jobs = frame(spark, sf_dir, "jobs").select(k.alias("id"), "status", F.when(k % 11 != 0, "u").alias("url"), F.when(k % 13 == 0, "").otherwise(c("user_id")).alias("usr"), (k * 37 % 2000).alias("age"), http.alias("http"))
    more = rows(spark, "id long, status string, url string, usr string, age long, http int", [(-r[0], *r[1:]) for r in CREATED])
    return jobs.unionAll(more).select("id", S.created_outcome(c("status"), c("url"), c("usr"), c("age"), c("http")).alias("outcome"))


_HELD = f"(SELECT job_id, k, CASE WHEN k % 4 <> 0 THEN concat('J', k - k % 3) END AS holder, CASE WHEN k % 7 <> 0 THEN created_at END AS since, k % 5 = 0 AS frozen FROM (SELECT *, substring(job_id, 2)::BIGINT AS k FROM <jobs>))"


@query(f"""SELECT job_id, CASE WHEN holder IS NULL THEN 'acquired' WHEN since > TIMESTAMP '{NOW}' - INTERVAL 30 MINUTE THEN 'refused' ELSE 'taken_over' END AS ask, CASE WHEN holder IS NULL THEN 'missing' WHEN holder = job_id THEN 'renewed' ELSE 'not-owner' END AS renew,
  since <= TIMESTAMP '{NOW}' - INTERVAL 28 MINUTE AS stop, CASE WHEN NOT frozen THEN 'not_frozen' WHEN holder IS NULL THEN 'acquired' ELSE 'in_progress' END AS migrate, CASE WHEN holder IS NULL THEN 'unfrozen' ELSE 'in_progress' END AS unfreeze FROM {_HELD}""")
def lock_outcomes(spark, sf_dir):
    """What each job gets when it asks for, renews or frees a lock in some state."""
    k, now = F.col("k"), F.lit(NOW).cast("timestamp_ntz")
    held = frame(spark, sf_dir, "jobs").withColumn("k", F.substring("job_id", 2, 20).cast("long"))
    held = held.select("job_id", F.when(k % 4 != 0, F.concat(F.lit("J"), k - k % 3)).alias("holder"), F.when(k % 7 != 0, F.col("created_at")).alias("since"), (k % 5 == 0).alias("frozen"))
    h, since = F.col("holder"), F.col("since")
    return held.select("job_id", S.ttl_lock(h, since, now).alias("ask"), S.renewal(h, F.col("job_id")).alias("renew"), S.must_stop(since, now).alias("stop"), S.migration_lock(F.col("frozen"), h).alias("migrate"), S.unfreeze(h).alias("unfreeze"))


_SAVED = "(SELECT concat('U', c_custkey % 150) AS user_id, n_name AS city, r_name AS country, o_orderstatus AS category, o_orderdate AS created_at, o_orderkey AS pin FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_SIGNAL = "lower(user_id) || '_' || replace(lower(city), ' ', '_') || '_' || replace(lower(country), ' ', '_')"


def saved(spark, sf_dir):
    t = {n: frame(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region")}
    j = t["orders"].join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return j.select(F.concat(F.lit("U"), F.col("c_custkey") % 150).alias("user_id"), F.col("n_name").alias("city"), F.col("r_name").alias("country"), F.col("o_orderstatus").alias("category"), F.col("o_orderdate").alias("created_at"), F.col("o_orderkey").alias("pin_id"))


@query(f"""WITH s AS (SELECT {_SIGNAL} AS signal_id, category, created_at, pin FROM {_SAVED}), c AS (SELECT signal_id, category, count(*) AS n, min((created_at, pin)) AS f, max(created_at) AS l FROM s GROUP BY 1, 2)
SELECT signal_id, sum(n)::BIGINT AS pin_count, string_agg(category, ',' ORDER BY f) AS categories, max(l)::DATE::VARCHAR AS last_save FROM c GROUP BY signal_id""")
def trip_signal_agg(spark, sf_dir):
    return J.trip_signals(saved(spark, sf_dir)).select("signal_id", "pin_count", F.array_join("categories", ",").alias("categories"), F.date_format("last_save", "yyyy-MM-dd").alias("last_save"))


@query(f"SELECT {_SIGNAL} AS signal_id, 'planning' AS status, 'low' AS confidence FROM {_SAVED} WHERE city NOT LIKE '%1%' GROUP BY 1")
def trip_signal_seed(spark, sf_dir):
    s = saved(spark, sf_dir)
    have = s.filter(F.col("city").contains("1")).select(S.signal_id(F.col("user_id"), F.col("city"), F.col("country")).alias("signal_id")).distinct()
    return J.new_signals(s, have).select("signal_id", "status", "confidence")


PLACES = [(1, "uid", "Donostia / San Sebastián", "Spain"), (2, "uid", "St. Louis", "United States"), (3, "uid", "/", "Spain"), (4, "uid", "a\t \tb", "X"), (5, None, "a", "b"), (6, "U.1", "São Paulo", "Brazil")]


_WHERE = f"(SELECT c_custkey AS id, c_name AS usr, CASE WHEN c_custkey % 9 = 0 THEN '' ELSE n_name || CASE c_custkey % 4 WHEN 0 THEN ' / West' WHEN 1 THEN '.' ELSE '' END END AS city, r_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT -id, usr, city, country FROM {values(PLACES, 'id', 'usr', 'city', 'country')})"


@query(f"""SELECT id::BIGINT AS id, CASE WHEN u <> '' AND c <> '' AND n <> '' THEN u || '_' || c || '_' || n END AS signal_id FROM (SELECT id, {', '.join(f"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[/' || chr(92) || chr(92) || '.' || chr(92) || 'x00-' || chr(92) || 'x1f]', '_', 'g'), '\\s+', '_', 'g'), '_+', '_', 'g'), '_') AS {y}" for x, y in (('usr', 'u'), ('city', 'c'), ('country', 'n')))} FROM {_WHERE})""")
def trip_signal_id(spark, sf_dir):
    t = {n: frame(spark, sf_dir, n) for n in ("customer", "nation", "region")}
    k = F.col("c_custkey")
    city = F.when(k % 9 == 0, "").otherwise(F.concat("n_name", F.when(k % 4 == 0, " / West").when(k % 4 == 1, ".").otherwise("")))
    all_ = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(k.cast("long").alias("id"), F.col("c_name").alias("usr"), city.alias("city"), F.col("r_name").alias("country"))
    more = rows(spark, "id long, usr string, city string, country string", [(-r[0], *r[1:]) for r in PLACES])
    return all_.unionAll(more).select("id", S.signal_id(F.col("usr"), F.col("city"), F.col("country")).alias("signal_id"))


@query("SELECT concat('J', event_id % 300) AS job_id, count(*)::BIGINT AS attempts, arg_max(event_type, (ts, event_id)) AS status, arg_max('e' || event_id, (ts, event_id)) AS last_error FROM events GROUP BY 1")
def push_attempts(spark, sf_dir):
    e = frame(spark, sf_dir, "events").select(F.concat(F.lit("J"), F.col("event_id") % 300).alias("job_id"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("status"), F.concat(F.lit("e"), "event_id").alias("error"))
    return J.deliveries(e)


@query("SELECT job_id, string_agg(stage || ':' || kind, ',' ORDER BY ts, stage) AS failures FROM (SELECT DISTINCT concat('J', event_id % 300) AS job_id, event_type AS stage, CASE WHEN event_type = 'click' THEN 'dependency_timeout' ELSE 'dependency_error' END AS kind, ts FROM events) GROUP BY job_id")
def stage_failures(spark, sf_dir):
    message = F.when(F.col("event_type") == "click", "timeout").otherwise("x")
    e = frame(spark, sf_dir, "events").select(F.concat(F.lit("J"), F.col("event_id") % 300).alias("job_id"), F.col("event_type").alias("stage"), message.alias("message"), F.col("ts").alias("at"))
    return J.stage_failures(e).select("job_id", F.array_join(F.transform("failures", lambda x: F.concat(x["stage"], F.lit(":"), x["kind"])), ",").alias("failures"))


@query("""SELECT job_id, CASE status WHEN 'complete' THEN 'pin_saved' WHEN 'duplicate' THEN 'pin_duplicate' WHEN 'failed' THEN 'pin_failed' END AS type, CASE status WHEN 'complete' THEN '📍 Pin saved!' WHEN 'duplicate' THEN 'Already on your map' WHEN 'failed' THEN 'Couldn''t find a place' END AS title,
  CASE status WHEN 'complete' THEN CASE WHEN k % 2 = 0 THEN 'Joe added to your map' ELSE 'Your link is on the map' END WHEN 'duplicate' THEN CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'Joe — new link added' ELSE 'New link added to a place you saved' END ELSE CASE WHEN k % 2 = 0 THEN 'Joe — already saved' ELSE 'This place is already saved' END END WHEN 'failed' THEN 'Tap to see your failed link' END AS body
FROM (SELECT *, substring(job_id, 2)::BIGINT AS k FROM <jobs>) WHERE status IN ('complete', 'duplicate', 'failed')""")
def push_copy(spark, sf_dir):
    k = F.substring("job_id", 2, 20).cast("long")
    m = frame(spark, sf_dir, "jobs").select("job_id", S.push_message(F.col("status"), k % 3 == 0, F.when(k % 2 == 0, "Joe")).alias("m")).filter("m is not null")
    return m.select("job_id", "m.type", "m.title", "m.body")
