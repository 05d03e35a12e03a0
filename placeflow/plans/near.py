"""Place search by name near each pin, and inside rectangles around users' homes."""

from __future__ import annotations

from ..operators import near as N
from ..sources.tables import sql
from .registry import query

# places stand around centres over the whole globe, some across 180 degrees and beside the poles; several share a point
_PLACES = """SELECT concat('PL', p_partkey) AS place_id, concat(CASE WHEN p_partkey % 2 = 0 THEN 'Spot ' ELSE ' spot  ' END, p_partkey % 5) AS name,
  CAST((p_partkey % 40) * 4.6 - 89.9 + ((p_partkey * 13) % 17) * 0.003 AS DOUBLE) AS lat, CAST((p_partkey % 36) * 10.2835 - 180.0 + ((p_partkey * 7) % 19) * 0.004 AS DOUBLE) AS lng FROM <part>"""
_PINS = """SELECT concat('P', o_orderkey) AS query_id, concat('spot ', o_orderkey % 6) AS text,
  CASE WHEN o_orderkey % 50 <> 7 THEN CAST((o_orderkey % 40) * 4.6 - 89.9 + ((o_orderkey * 11) % 17) * 0.003 AS DOUBLE) END AS lat, CAST((o_orderkey % 36) * 10.2835 - 180.0 + ((o_orderkey * 5) % 19) * 0.004 AS DOUBLE) AS lng FROM <orders>"""
_BOXES = """SELECT concat('U', c_custkey) AS query_id, concat('SPOT ', c_custkey % 5) AS text, CAST(c_custkey % 170 - 90 AS DOUBLE) AS low_lat, CAST((c_custkey * 3) % 360 - 180 AS DOUBLE) AS low_lng,
  CAST(c_custkey % 170 - 90 + (c_custkey % 7) * 2.9 AS DOUBLE) AS high_lat, CAST(((c_custkey * 3) % 360 + CASE c_custkey % 4 WHEN 0 THEN 0.2 WHEN 1 THEN 9 WHEN 2 THEN 70 ELSE 200 END) % 360 - 180 AS DOUBLE) AS high_lng FROM <customer>"""


def _metres(a: str, b: str, c: str, d: str) -> str:
    h = f"pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)"
    return f"round(2 * 6371 * atan2(sqrt({h}), sqrt(1 - ({h}))) * 1000)::BIGINT"


_KEY = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"


@query(f"""WITH p AS (SELECT place_id, {_KEY.format('name')} AS key, lat, lng FROM ({_PLACES}) x), q AS (SELECT query_id, {_KEY.format('text')} AS key, lat, lng FROM ({_PINS}) x),
d AS (SELECT query_id, place_id, {_metres('q.lat', 'q.lng', 'p.lat', 'p.lng')} AS metres FROM q JOIN p ON p.key = q.key), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY metres, place_id) AS rank FROM d WHERE metres <= 2000),
a AS (SELECT key, min(place_id) AS place_id FROM p GROUP BY key)
SELECT query_id, rank::INTEGER AS rank, place_id, metres, true AS near FROM n WHERE rank <= 3 UNION ALL SELECT query_id, 1, a.place_id, NULL, false FROM q JOIN a ON a.key = q.key WHERE query_id NOT IN (SELECT query_id FROM n)""")
def search_near_pins(spark, sf_dir):
    """Every pin's name searched with a bias of 2 km: the three nearest places of that name, else any."""
    return N.search_near(sql(spark, sf_dir, _PINS), sql(spark, sf_dir, _PLACES), 2000, 3)


@query(f"""WITH p AS (SELECT place_id, {_KEY.format('name')} AS key, lat, lng FROM ({_PLACES}) x), q AS (SELECT *, {_KEY.format('text')} AS key, high_lng - low_lng + CASE WHEN low_lng > high_lng THEN 360 ELSE 0 END AS width FROM ({_BOXES}) x),
d AS (SELECT query_id, place_id, {_metres('(low_lat + high_lat) / 2', '((low_lng + width / 2 + 540) % 360 - 180)', 'p.lat', 'p.lng')} AS metres FROM q JOIN p ON p.key = q.key AND lat BETWEEN low_lat AND high_lat AND (CASE WHEN low_lng <= high_lng THEN lng BETWEEN low_lng AND high_lng ELSE lng >= low_lng OR lng <= high_lng END))
SELECT query_id, rank::INTEGER AS rank, place_id, metres FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY metres, place_id) AS rank FROM d) r WHERE rank <= 2""")
def search_inside_boxes(spark, sf_dir):
    """A name searched inside a rectangle of each customer: from a fifth of a degree to more than half the globe, some around 180."""
    return N.search_inside(sql(spark, sf_dir, _BOXES), sql(spark, sf_dir, _PLACES), 2)
