"""Model replies of every job read to candidates, and payloads of every place of which some are faulty."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import replies as R
from ..sources.tables import sql
from .registry import query

_REPLIES = """SELECT job_id, k, CASE WHEN k % 10 = 9 THEN concat('No places here, sorry ', k) WHEN k % 10 = 8 THEN concat('{"places": "none', k, '"}') ELSE concat(CASE k % 3 WHEN 0 THEN 'Sure! ' WHEN 1 THEN '```json' ELSE '' END, '{"places": ["Spot ', k, '", {"name": " Bar ', k % 7, ' ", "city": "Rome"}, 7, {"location": "x"}, ', CASE WHEN k % 4 = 0 THEN '"Spot ' ELSE '"Inn ' END, k, '"], "count": 3}', CASE k % 3 WHEN 0 THEN ' Enjoy {it}!' WHEN 1 THEN '```' ELSE '' END) END AS reply
  FROM (SELECT job_id, CAST(substring(job_id, 2) AS BIGINT) AS k FROM <jobs>) x"""


@query(f"""WITH j AS (SELECT job_id, k, 'Spot ' || k AS a, 'Bar ' || k % 7 AS b, CASE WHEN k % 4 = 0 THEN 'Spot ' ELSE 'Inn ' END || k AS c FROM ({_REPLIES}) r WHERE k % 10 < 8)
SELECT job_id, 1::BIGINT AS pos, a AS name, '' AS location, CASE WHEN b = c THEN b ELSE b || '|' || c END AS siblings FROM j UNION ALL SELECT job_id, 2, b, 'Rome', CASE WHEN a = c THEN a ELSE a || '|' || c END FROM j UNION ALL SELECT job_id, 5, c, '', CASE WHEN a = b THEN a ELSE a || '|' || b END FROM j""")
def reply_places(spark, sf_dir):
    """The places that a model named for every job, from replies in fences and prose, of which a fifth can't be read."""
    found = R.reply_places(sql(spark, sf_dir, _REPLIES).select("job_id", "reply"))
    return found.withColumn("siblings", F.array_join("siblings", "|"))


_PAYLOADS = """SELECT concat('PL', p_partkey) AS place_id, CASE p_partkey % 50 WHEN 10 THEN concat('<html>', repeat('x', 600)) WHEN 20 THEN '[1]' WHEN 30 THEN '{"types": "bar"}' WHEN 40 THEN '{"types": ["bar"], "geometry": 5}' WHEN 0 THEN '{"name": {"text": "x"}, "types": []}'
  ELSE concat('{"name": "', p_name, '", "types": ["bar"], "rating": 4.5, "geometry": null}') END AS body FROM <part>"""
_DONE = "SELECT job_id, CASE status WHEN 'processing' THEN 'complete' ELSE status END AS status, CASE WHEN status IN ('complete', 'processing') THEN concat('PL', CAST(substring(job_id, 2) AS BIGINT) % 190) END AS place_id FROM <jobs>"


@query(f"""SELECT job_id, CASE WHEN bad THEN 'failed' ELSE status END AS status, CASE WHEN NOT bad THEN place_id END AS place_id, CASE WHEN bad THEN CASE k % 50 WHEN 10 THEN left('details is not JSON: <html>' || repeat('x', 600), 500) WHEN 20 THEN 'details is array, not object' WHEN 30 THEN 'details.types is string, not array' WHEN 40 THEN 'details.geometry is number, not object' ELSE 'details.name is object, not string' END END AS error
FROM (SELECT *, coalesce(status = 'complete' AND k % 10 = 0 AND there, false) AS bad FROM (SELECT d.*, substring(d.place_id, 3)::BIGINT AS k, p_partkey IS NOT NULL AS there FROM ({_DONE}) d LEFT JOIN part ON concat('PL', p_partkey) = d.place_id) x) y""")
def faulty_payloads(spark, sf_dir):
    """Every finished job against its place's payload, one of ten of which is spoilt: those jobs fail with a message, the others stand."""
    return R.fail_faulty(sql(spark, sf_dir, _DONE), sql(spark, sf_dir, _PAYLOADS))
