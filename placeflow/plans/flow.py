"""The enrichment of every job, from its link to its verdict."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flow as W
from ..sources.tables import frame, sql
from .links import _CID, _NORMAL
from .registry import query

_VIDEO = "concat('https://www.tiktok.com/@u', k % 50, '/video/', k % 900)"
_MAP = "concat('https://www.google.com/maps/place/name+', k % 1500, '/@1.5,2.5,17z')"
# links of every kind: short ones to videos and maps too; captions, and posts of a tool or of tags, with and without a description
_JOBS = f"""SELECT job_id, k, user_id, CASE k % 8 WHEN 0 THEN {_VIDEO} WHEN 1 THEN CASE WHEN k % 16 = 9 THEN concat('https://maps.app.goo.gl/', k) ELSE {_MAP} END WHEN 7 THEN concat('https://vm.tiktok.com/', k) ELSE concat('https://a.example/p/', k) END AS url,
  CASE WHEN k % 16 = 9 THEN {_MAP} WHEN k % 8 = 7 THEN {_VIDEO} END AS target, CASE WHEN k % 7 = 0 THEN 'off main street' ELSE '' END AS caption, CASE WHEN k % 6 = 0 THEN concat('see name ', (k + 1) % 1500) ELSE '' END AS title, CASE WHEN k % 9 < 3 THEN 'by the park' ELSE '' END AS description,
  CASE WHEN k % 5 = 0 THEN 'yelp' ELSE '' END AS site, CASE WHEN k % 8 = 2 THEN {_VIDEO} ELSE concat('https://a.example/c/', k) END AS canonical, k % 8 >= 2 AND k % 8 <> 7 AS posted, CASE WHEN k % 3 = 0 THEN 'tool' ELSE 'tags' END AS via,
  CASE k % 6 WHEN 0 THEN concat('name ', (k + 1) % 1500) WHEN 1 THEN 'TikTok' ELSE NULL END AS guess FROM (SELECT job_id, concat('U', CAST(substring(job_id, 2) AS BIGINT) % 150) AS user_id, CAST(substring(job_id, 2) AS BIGINT) AS k FROM <jobs>) x"""
_CANDIDATES = f"SELECT job_id, CAST(pos AS BIGINT) AS pos, concat('name ', (k * 7 + pos * 13) % 1500) AS name, '' AS address, '' AS city, 'text' AS source FROM ({_JOBS}) j JOIN (SELECT 1 AS pos UNION ALL SELECT 2 UNION ALL SELECT 3) n ON pos <= k % 4 WHERE k % 8 >= 3"
# of images: the first name again in capitals, and another
_VISION = f"SELECT job_id, CAST(pos AS BIGINT) AS pos, CASE pos WHEN 1 THEN concat('NAME ', (k * 7 + 13) % 1500) ELSE concat('name ', (k * 11 + 5) % 1500) END AS name, '' AS location FROM ({_JOBS}) j JOIN (SELECT 1 AS pos UNION ALL SELECT 2) n ON k % 16 >= 13 OR (k % 16 = 5 AND pos = 1)"
# every part is a hit; a third of them under other words
_HITS = """SELECT concat(CASE WHEN p_partkey % 3 = 0 THEN 'other ' ELSE 'name ' END, p_partkey) AS query_key, 1 AS rank, concat('PL', p_partkey) AS place_id, concat('name ', p_partkey) AS name, concat('Main Street ', p_partkey) AS address, CAST(p_partkey % 200 AS BIGINT) AS ratings FROM <part>
  UNION ALL SELECT concat('name ', p_partkey), 2, concat('PL', p_partkey + 1), 'other', '', CAST(0 AS BIGINT) FROM <part> WHERE p_partkey % 6 = 2"""
_CHECKS = "SELECT concat(CASE WHEN p_partkey % 4 <= 1 THEN 'PL' ELSE 'QL' END, p_partkey) AS place_id, p_partkey % 4 = 1 AS matches, concat('name ', p_partkey + 3) AS better_query FROM <part>"
_DETAILS = "SELECT concat(CASE WHEN types_csv IS NULL THEN 'X' ELSE '' END, place_id) AS place_id FROM <places>"


def _form(url: str, what: str) -> str:
    return f"(SELECT {what} FROM (SELECT {url} AS url))"


def _known(pin: str, share: str) -> str:
    """Whether a pin has a link already: equal normal forms or content ids."""
    return f"coalesce({pin}_normal = {share}_normal, false) OR coalesce({pin}_cid = {share}_cid, false)"


def _write(name: str, place: str, link: str, test: str) -> str:
    """The pin that a write of a job's place hits, and whether that takes the link."""
    return f"""{name} AS (SELECT w.job_id, w.pin, NOT ({_known('p.url', 'w.link').replace('p.url_', 'p.').replace('w.link_', 'w.')}) AS added FROM (SELECT s.job_id, coalesce(a.pin, b.pin, c.pin) AS pin, {link}_normal AS normal, {link}_cid AS cid FROM s
  LEFT JOIN byplace a ON a.user_id = s.user_id AND a.place_id = s.{place} LEFT JOIN byurl b ON b.user_id = s.user_id AND b.url = s.{link} LEFT JOIN bynormal c ON c.user_id = s.user_id AND c.normal = s.{link}_normal WHERE s.{place} IS NOT NULL AND {test}) w JOIN p ON p.pin_id = w.pin)"""


def _score(h: str) -> str:
    return f"""(CASE WHEN contains(lower(title), lower({h}.name)) THEN 40 ELSE 0 END + CASE WHEN len(list_filter(regexp_split_to_array(lower({h}.address), '[,\\s]+'), lambda w: length(w) > 3 AND contains(lower(title || ' ' || text), w))) > 0 THEN 20 ELSE 0 END
  + CASE WHEN contains(site, 'yelp') THEN 20 ELSE 0 END + CASE WHEN {h}.ratings > 100 THEN 10 ELSE 0 END + CASE WHEN {h}.n_hits = 1 THEN 10 ELSE 0 END)"""


_RUN = f"""WITH p AS (SELECT pin_id, user_id, place_id, url, {_NORMAL} AS normal, {_CID} AS cid FROM <pins>),
byplace AS (SELECT user_id, place_id, min(pin_id) AS pin FROM p GROUP BY 1, 2), byurl AS (SELECT user_id, url, min(pin_id) AS pin FROM p GROUP BY 1, 2), bynormal AS (SELECT user_id, normal, min(pin_id) AS pin FROM p GROUP BY 1, 2), bycid AS (SELECT user_id, cid, min(pin_id) AS pin FROM p GROUP BY 1, 2),
h AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY query_key) AS n_hits FROM ({_HITS}) a) b WHERE rank = 1),
j0 AS (SELECT job_id, k, user_id, url, CASE WHEN k % 16 = 9 THEN target ELSE url END AS map, CASE WHEN posted THEN canonical WHEN k % 8 = 7 THEN target ELSE url END AS link, CASE WHEN posted THEN title ELSE '' END AS title, CASE WHEN posted THEN site ELSE '' END AS site,
  CASE WHEN NOT posted THEN caption WHEN via = 'tool' THEN coalesce(nullif(description, ''), caption) ELSE trim(description || chr(10) || caption, chr(10)) END AS text, CASE WHEN lower(guess) <> 'tiktok' THEN guess END AS query FROM ({_JOBS}) a),
j AS (SELECT *, {_form('link', _NORMAL)} AS link_normal, {_form('link', _CID)} AS link_cid, {_NORMAL} AS url_normal, {_CID} AS url_cid FROM j0),
m AS (SELECT j.job_id, h.place_id AS maps_place FROM j JOIN h ON h.query_key = replace(regexp_extract(j.map, 'maps/place/([^/@]+)', 1), '+', ' ') AND k % 8 = 1),
c AS (SELECT c.job_id, c.pos, h.place_id, e.pin, CASE WHEN h.place_id IS NULL THEN 'unresolved' WHEN e.pin IS NOT NULL THEN 'existing' WHEN d.place_id IS NULL THEN 'unresolved' ELSE 'new' END AS state, NOT ({_known('p', 'j.link').replace('p_', 'p.')}) AS added
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, lower(name) ORDER BY pos) AS nth FROM (SELECT job_id, pos, name FROM ({_CANDIDATES}) t UNION ALL SELECT job_id, pos + 1000000, name FROM ({_VISION}) v) u) w WHERE nth = 1) c JOIN j ON j.job_id = c.job_id LEFT JOIN h ON h.query_key = c.name LEFT JOIN byplace e ON e.user_id = j.user_id AND e.place_id = h.place_id LEFT JOIN ({_DETAILS}) d ON d.place_id = h.place_id LEFT JOIN p ON p.pin_id = e.pin),
t AS (SELECT job_id, count(*) FILTER (state = 'new') AS n_new, count(*) FILTER (state = 'existing') AS n_old, count(*) FILTER (state = 'unresolved') AS n_lost, arg_min(place_id, pos) FILTER (state = 'new') AS new_place, arg_min(pin, pos) FILTER (state = 'existing') AS first_match, arg_min(pin, pos) FILTER (state = 'existing' AND added) AS took FROM c GROUP BY job_id),
f1 AS (SELECT j.job_id, title, text, site, h.place_id, {_score('h')} AS score, x.better_query, x.matches FROM j JOIN h ON h.query_key = j.query LEFT JOIN ({_CHECKS}) x ON x.place_id = h.place_id),
f2 AS (SELECT f1.job_id, CASE WHEN g.place_id IS NOT NULL THEN g.place_id ELSE f1.place_id END AS back_place, CASE WHEN g.place_id IS NOT NULL THEN greatest({_score('g')}, 60) ELSE score END AS final FROM f1 LEFT JOIN h g ON score < 60 AND NOT coalesce(matches, true) AND g.query_key = better_query),
s AS (SELECT j.*, m.maps_place, coalesce(n_new, 0) AS n_new, coalesce(n_old, 0) AS n_old, coalesce(n_lost, 0) AS n_lost, new_place, first_match, took, back_place, coalesce(a.pin, b.pin) AS url_pin, x.pin AS content_pin FROM j LEFT JOIN m ON m.job_id = j.job_id LEFT JOIN t ON t.job_id = j.job_id LEFT JOIN (SELECT * FROM f2 WHERE final >= 30) f ON f.job_id = j.job_id
  LEFT JOIN byurl a ON a.user_id = j.user_id AND a.url = j.url LEFT JOIN bynormal b ON b.user_id = j.user_id AND b.normal = j.url_normal LEFT JOIN bycid x ON x.user_id = j.user_id AND x.cid = j.link_cid),
{_write('wm', 'maps_place', 'url', 'true')}, {_write('wn', 'new_place', 'link', 'n_new = 1')}, {_write('wb', 'back_place', 'link', 'n_new = 0')},
v AS (SELECT s.*, wm.pin AS mp, wm.added AS ma, wn.pin AS np, wn.added AS na, wb.pin AS bp, wb.added AS ba, NOT ({_known('p', 's.link').replace('p_', 'p.')}) AS ca, CASE WHEN url_pin IS NOT NULL THEN 'url' WHEN maps_place IS NOT NULL THEN 'maps' WHEN content_pin IS NOT NULL THEN 'content' WHEN n_new = 0 AND n_old > 0 AND n_lost = 0 THEN 'matches' WHEN n_new = 1 THEN 'candidate' WHEN n_new > 1 THEN 'candidates'
    WHEN back_place IS NOT NULL THEN 'fallback' WHEN n_old > 0 THEN 'matches' ELSE 'none' END AS step
  FROM s LEFT JOIN wm ON wm.job_id = s.job_id LEFT JOIN wn ON wn.job_id = s.job_id LEFT JOIN wb ON wb.job_id = s.job_id LEFT JOIN p ON p.pin_id = content_pin)
SELECT job_id, step, CASE step WHEN 'url' THEN url_pin WHEN 'maps' THEN mp WHEN 'content' THEN content_pin WHEN 'matches' THEN coalesce(took, first_match) WHEN 'candidate' THEN CASE WHEN np IS NOT NULL AND NOT na AND took IS NOT NULL THEN took ELSE np END WHEN 'fallback' THEN CASE WHEN bp IS NOT NULL AND NOT ba AND took IS NOT NULL THEN took ELSE bp END END AS pin,
  CASE WHEN step = 'maps' AND mp IS NULL THEN maps_place WHEN step = 'candidate' AND np IS NULL THEN new_place WHEN step = 'fallback' AND bp IS NULL THEN back_place END AS place_id,
  CASE step WHEN 'maps' THEN coalesce(ma, false) WHEN 'content' THEN ca WHEN 'matches' THEN took IS NOT NULL WHEN 'candidate' THEN np IS NOT NULL AND (na OR took IS NOT NULL) WHEN 'fallback' THEN bp IS NOT NULL AND (ba OR took IS NOT NULL) ELSE false END AS source_added,
  CASE WHEN step IN ('url', 'content', 'matches') THEN 'duplicate' WHEN step = 'candidates' THEN 'needs_selection' WHEN step = 'none' THEN 'failed' WHEN coalesce(CASE step WHEN 'maps' THEN mp WHEN 'candidate' THEN np ELSE bp END, '') = '' THEN 'complete' ELSE 'duplicate' END AS status FROM v"""


def lookups(spark, sf_dir):
    """Jobs and the tables that stand for outside services."""
    jobs = sql(spark, sf_dir, _JOBS)
    posts = jobs.filter("posted").select("url", "canonical", "via", "title", "description", "site")
    redirects = jobs.filter("target is not null").select("url", "target")
    pins = frame(spark, sf_dir, "pins").withColumn("sources", F.lit(None).cast("array<string>"))
    guesses = jobs.filter("guess is not null").select("job_id", "guess")
    return jobs.select("job_id", "user_id", "url", "caption"), posts, redirects, sql(spark, sf_dir, _CANDIDATES), sql(spark, sf_dir, _VISION), guesses, sql(spark, sf_dir, _CHECKS), sql(spark, sf_dir, _HITS), sql(spark, sf_dir, _DETAILS), pins


@query(_RUN)
def enrichment_run(spark, sf_dir):
    return W.run(*lookups(spark, sf_dir))


@query("SELECT job_id, CASE WHEN status = 'pending' AND k % 2 = 0 THEN 'failed' ELSE status END AS status, CASE WHEN status = 'pending' AND k % 2 = 0 THEN 'enrich_http_404' END AS error FROM (SELECT job_id, status, substring(job_id, 2)::BIGINT AS k FROM <jobs>)")
def failed_if_pending(spark, sf_dir):
    jobs = frame(spark, sf_dir, "jobs").select("job_id", "status", F.lit(None).cast("string").alias("error"))
    failures = jobs.filter(F.substring("job_id", 2, 20).cast("long") % 2 == 0).select("job_id", F.lit("enrich_http_404").alias("error"))
    return W.fail_if_pending(jobs, failures)
