"""Connected components as joins and minima, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _least(edges: DataFrame, both: bool) -> DataFrame:
    """Each u's least neighbour or itself; edges run from the larger to the smaller end."""
    down = edges.select("u", "v")
    all_ = down.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else down
    return all_.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for the ends of edges (u, v), any order; component is the least node reachable.

    Each round replaces every edge by one to the least neighbour of an end, so paths shorten by a
    constant factor and hubs never gather their neighbours: a hub's rows meet only its one minimum.
    """
    now = scratch.save(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        # large star: every larger neighbour v of u links to u's least neighbour
        out = now.select("u", "v").unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = out.join(_least(now, True), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = scratch.save(large)
        # small star: u and its smaller neighbours link to the least of them
        small = large.join(_least(large, False), "u")
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        new = scratch.save(small)
        scratch.drop(now, large)
        now = new
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select("v", "v").distinct())
