"""Parquet inputs, and domain views over them in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame, SparkSession

from ..session import ship

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "places": """SELECT concat('PL', p_partkey) AS place_id, p_name AS place_name,
  CASE p_size % 12 WHEN 0 THEN 'italian_restaurant,restaurant' WHEN 1 THEN 'cafe,bakery' WHEN 2 THEN 'wine_bar,bar' WHEN 3 THEN 'lodging' WHEN 4 THEN 'museum,tourist_attraction'
    WHEN 5 THEN 'park' WHEN 6 THEN 'shopping_mall,store' WHEN 7 THEN 'spa' WHEN 8 THEN 'movie_theater' WHEN 9 THEN 'point_of_interest,establishment' WHEN 10 THEN 'steak_house' ELSE NULL END AS types_csv,
  CASE p_type WHEN 'PROMO' THEN 'sushi_restaurant' WHEN 'LARGE' THEN 'coffee_shop' ELSE NULL END AS primary_type FROM <part>""",
    "pins": """SELECT concat('P', o_orderkey) AS pin_id, concat('U', o_custkey % 150) AS user_id, concat('PL', o_orderkey % 500) AS place_id, o_orderdate AS created_at,
  CASE WHEN o_orderkey % 3 = 0 THEN 'food' ELSE 'other' END AS category, CASE WHEN o_orderkey % 4 = 0 THEN 4 ELSE NULL END AS enrichment_version,
  concat('https://www.tiktok.com/@u', o_custkey % 50, '/video/', o_orderkey % 900, CASE WHEN o_orderkey % 2 = 0 THEN '?utm_source=s&_t=1' ELSE '/' END) AS url FROM <orders>""",
    "pin_lists": """SELECT DISTINCT concat('P', l_orderkey) AS pin_id, CASE WHEN l_suppkey % 17 = 5 THEN concat('GHOST', l_suppkey) ELSE concat('L', l_suppkey) END AS list_id FROM <lineitem>""",
    "members": """SELECT DISTINCT concat('L', l_suppkey) AS list_id, concat('P', l_orderkey) AS pin_id, CASE WHEN l_orderkey % 50 = 0 THEN 'U_WRONG' ELSE concat('U', o_custkey % 150) END AS pin_owner_id
  FROM <lineitem> JOIN <orders> ON l_orderkey = o_orderkey WHERE l_linenumber <= 2
  UNION ALL SELECT concat('L', s_suppkey), concat('P_GONE', s_suppkey), 'U0' FROM <supplier>""",
    "lists": """SELECT concat('L', s_suppkey) AS list_id, concat('U', s_nationkey) AS owner_id, s_name AS name,
  CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 3 = 1 THEN n ELSE s_suppkey * 6 END AS pin_count
  FROM <supplier> LEFT JOIN (SELECT list_id AS lid, count(*) AS n FROM <members> GROUP BY list_id) m ON m.lid = concat('L', s_suppkey)""",
    "users": """SELECT concat('U', c_custkey % 150) AS user_id, CASE WHEN min(c_custkey) % 11 = 0 THEN NULL ELSE CAST(min(c_custkey) % 200 - 100 AS DOUBLE) END AS home_lat,
  CAST((min(c_custkey) * 7) % 361 - 180 AS DOUBLE) AS home_lng FROM <customer> GROUP BY c_custkey % 150""",
    "jobs": """SELECT concat('J', event_id) AS job_id, concat('U', user_id) AS user_id, ts AS created_at, value,
  CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'click' THEN 'complete' WHEN 'purchase' THEN 'duplicate' ELSE 'failed' END AS status FROM <events>""",
    "posts": """SELECT doc_id AS post_id, coalesce(substring(text, 1, 80), '') AS title, coalesce(text, '') AS description FROM <documents>""",
    "links": """SELECT page_id AS id, url FROM <pages>""",
}

_NAME = re.compile(rf"<({'|'.join([*TABLES, *VIEWS])})>")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table or a domain view over a folder of tables."""
    if name not in VIEWS:
        return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return sql(spark, sf_dir, VIEWS[name])


def sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A query in which <name> stands for a table or view."""
    for name in set(_NAME.findall(text)):
        alias = f"placeflow_{name}_{zlib.crc32(sf_dir.encode())}"
        frame(spark, sf_dir, name).createOrReplaceTempView(alias)
        text = text.replace(f"<{name}>", alias)
    return spark.sql(text)


def oracle(text: str) -> str:
    """The same query with views written out, for an engine that knows the tables by name."""

    def put(m: re.Match) -> str:
        return f"({oracle(VIEWS[m[1]])})" if m[1] in VIEWS else m[1]

    return _NAME.sub(put, text)
