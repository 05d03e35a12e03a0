"""External services as lookup tables: search hits, details, redirects, caches and extracted posts.

A live provider fills these tables; the joins stay the same. A missing row degrades as a failed call does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolved(links: DataFrame, redirects: DataFrame, url: str = "url") -> DataFrame:
    """Links with their target; without one, the link itself."""
    first = redirects.groupBy(F.col("url").alias("from_url")).agg(F.min("target").alias("target"))
    return links.join(first, F.col(url) == F.col("from_url"), "left").withColumn("target", F.coalesce("target", F.col(url))).drop("from_url")


def cached(keys: DataFrame, cache: DataFrame, now: Column, key: str = "key") -> DataFrame:
    """Keys with the newest value that hasn't expired at `now`, else null."""
    live = cache.filter(F.col("expires_at") > now).groupBy("key").agg(F.max_by("value", "expires_at").alias("value"))
    return keys.join(live.withColumnRenamed("key", "_k"), F.col(key) == F.col("_k"), "left").drop("_k")


def cache_rows(values: DataFrame, now: Column, ttl_s: int = 24 * 3600) -> DataFrame:
    """(key, value) with an expiry."""
    return values.withColumn("expires_at", now + F.make_dt_interval(secs=F.lit(ttl_s).cast("decimal(18,6)")))


def evicted(cache: DataFrame, most: int = 5000, order: str = "inserted_at") -> DataFrame:
    """The newest `most` entries of a cache."""
    return cache.orderBy(F.col(order).desc(), F.col("key").desc()).limit(most)


def first_hits(queries: DataFrame, search: DataFrame, query: str = "query_key") -> DataFrame:
    """Queries with their rank-1 hit and the number of hits; without any, nulls and 0."""
    w = Window.partitionBy("query_key")
    top = search.withColumn("n_hits", F.count("*").over(w)).filter("rank = 1").withColumnRenamed("query_key", "_q").drop("rank")
    return queries.join(top, F.col(query) == F.col("_q"), "left").drop("_q").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))


def details(places: DataFrame, table: DataFrame) -> DataFrame:
    return places.join(table, "place_id", "left")


def extract_chain(requests: DataFrame, cache: DataFrame, redirects: DataFrame, posts: DataFrame, now: Column) -> DataFrame:
    """Requests (url) with a post: cached under the link, else under its target, else extracted; `via` says which."""
    from ..functions import url as U

    r = resolved(requests, redirects).withColumn("k1", U.cache_form(F.col("url"))).withColumn("k2", F.when(U.is_short(F.col("url")), U.cache_form(F.col("target"))))
    r = cached(r, cache, now, "k1").withColumnRenamed("value", "v1")
    r = cached(r, cache, now, "k2").withColumnRenamed("value", "v2")
    p = posts.select(F.col("url").alias("_p"), F.col("post").alias("v3"))
    r = r.join(p, F.col("target") == F.col("_p"), "left").drop("_p")
    via = F.when(F.col("v1").isNotNull(), "cache").when(F.col("v2").isNotNull(), "canonical").when(F.col("v3").isNotNull(), "extracted").otherwise("failed")
    return r.withColumn("post", F.coalesce("v1", "v2", "v3")).withColumn("via", via).drop("k1", "k2", "v1", "v2", "v3")


def realigned(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Every input row (pos, name) with its answer by trimmed name, the later of equal names; confidence is one of three, low otherwise."""
    last = answers.groupBy(F.trim("name").alias("_n")).agg(F.max_by(F.struct("region", "confidence"), "pos").alias("a"))
    level = F.when(F.col("a.confidence").isin("high", "medium", "low"), F.col("a.confidence")).otherwise("low")
    return rows.join(last, F.trim("name") == F.col("_n"), "left").select("pos", "name", "a.region", level.alias("confidence"))
