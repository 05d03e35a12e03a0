"""Place search near a point and inside a rectangle: a cell index joined by equality, then exact distances."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_KM, distance_km
from ..functions.text import match_form

LEVELS = 20  # sides of a rectangle's cells: 180 degrees halved up to so many times


def _row(lat: Column, step: float) -> Column:
    return F.floor((lat + 90) / step).cast("long")


def _columns(row: Column, step: float) -> Column:
    """How many cells a row has: as many as keep a cell's narrower edge at least one row high."""
    edge = F.greatest(F.abs(row * step - 90), F.abs((row + 1) * step - 90))
    return F.greatest(F.floor(360 * F.cos(F.radians(F.least(edge, F.lit(90.0)))) / step), F.lit(1)).cast("long")


def _column(lng: Column, row: Column, step: float) -> Column:
    n = _columns(row, step)
    return F.pmod(F.floor((lng + 180) * n / 360), n).cast("long")


def cell(lat: Column, lng: Column, step: float) -> Column:
    """struct(row, col) of a point in rows of `step` degrees; columns go around, so -180 and 180 meet."""
    row = _row(lat, step)
    return F.struct(row.alias("row"), _column(lng, row, step).alias("col"))


def cells_around(lat: Column, lng: Column, step: float) -> Column:
    """All cells that a circle of one row's height around a point can touch: three rows, and in each those that its width covers."""
    reach = math.radians(step)
    over = F.abs(lat) + step >= 90
    wide = F.when(over, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(reach)) / F.cos(F.radians(lat))))))

    def of(row: Column) -> Column:
        n = _columns(row, step)
        first, last = (F.floor((lng + s * wide + 180) * n / 360).cast("long") for s in (-1, 1))
        columns = F.sequence(first, F.least(last, first + n - 1))  # never around twice
        return F.transform(columns, lambda c: F.struct(row.alias("row"), F.pmod(c, n).alias("col")))

    rows = F.sequence(_row(lat, step) - 1, _row(lat, step) + 1)
    return F.array_distinct(F.flatten(F.transform(F.filter(rows, lambda r: (r >= 0) & (r * step < 180.0 + step)), of)))


def metres(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    return F.round(distance_km(lat1, lng1, lat2, lng2) * 1000).cast("long")


def _spots(places: DataFrame, k: int) -> DataFrame:
    """(key, lat, lng, ids): places of one name at one point, of which the k least ids can be among k best."""
    fine = places.filter("place_id is not null and lat between -90 and 90 and lng between -180 and 180")
    rows = fine.select(match_form(F.col("name")).alias("key"), F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"), "place_id").distinct()
    w = Window.partitionBy("key", "lat", "lng").orderBy("place_id")
    first = rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k)
    return first.groupBy("key", "lat", "lng").agg(F.sort_array(F.collect_list("place_id")).alias("ids"))


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy("metres", "place_id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search_near(queries: DataFrame, places: DataFrame, radius_m: int = 2000, k: int = 1) -> DataFrame:
    """Queries (query_id, text, lat, lng) with their hits: query_id, rank, place_id, metres, near.

    A hit is a place (place_id, name, lat, lng) of the same name (case and extra space aside). Those within the
    radius come first, nearest first, at most k; the point is a bias, so a query without any gets the least place_id of
    that name anywhere, `near` false and metres null. Distances are whole metres; ties go to the lesser id. Queries
    without a hit, and with a null id or text, are left out; one without a point has no near hits.

    Both sides meet by name and cell, so a common name is no group, and each different (text, point) is searched
    once however many queries ask it. Places of one name at one point are one spot with their k least ids.
    """
    step = radius_m / 1000 / EARTH_KM * 180 / math.pi * 1.001
    asked = queries.filter("query_id is not null and text is not null").select("query_id", match_form(F.col("text")).alias("key"), F.col("lat").cast("double").alias("qlat"), F.col("lng").cast("double").alias("qlng"))
    points = asked.filter("qlat between -90 and 90 and qlng between -180 and 180").select("key", "qlat", "qlng").distinct()
    around = points.withColumn("cell", F.explode(cells_around(F.col("qlat"), F.col("qlng"), step)))
    spots = _spots(places, k).withColumn("cell", cell(F.col("lat"), F.col("lng"), step))
    met = around.join(spots, ["key", "cell"]).withColumn("metres", metres(F.col("qlat"), F.col("qlng"), F.col("lat"), F.col("lng"))).filter(F.col("metres") <= radius_m)
    near = _best(met.select("key", "qlat", "qlng", "metres", F.explode("ids").alias("place_id")), ["key", "qlat", "qlng"], k)
    close = asked.join(near, ["key", "qlat", "qlng"]).select("query_id", "rank", "place_id", "metres", F.lit(True).alias("near"))
    any_ = places.filter("place_id is not null").groupBy(match_form(F.col("name")).alias("key")).agg(F.min("place_id").alias("place_id"))
    far = asked.join(near.select("key", "qlat", "qlng").distinct(), ["key", "qlat", "qlng"], "left_anti").join(any_, "key")
    return close.unionByName(far.select("query_id", F.lit(1).alias("rank"), "place_id", F.lit(None).cast("long").alias("metres"), F.lit(False).alias("near")))


def search_inside(queries: DataFrame, places: DataFrame, k: int = 1) -> DataFrame:
    """Queries (query_id, text, low_lat, low_lng, high_lat, high_lng) with their hits inside the rectangle: query_id, rank, place_id, metres.

    Edges count as inside. A rectangle whose low_lng lies above its high_lng goes around 180; one whose low_lat lies above
    its high_lat is empty. Hits rank by whole metres from the rectangle's middle, ties by the lesser id; at most k.
    Queries without a hit are left out, as are null ids, texts and edges; rows that repeat count once.

    Each different (text, rectangle) is searched once however many queries ask it. It is covered by cells of a size of its own, at most three by three, and places stand in the cells of every
    size that some rectangle asks for, so the join is one of equality at any size.
    """
    edges = ["low_lat", "low_lng", "high_lat", "high_lng"]
    asked = queries.select("query_id", match_form(F.col("text")).alias("key"), *[F.col(e).cast("double").alias(e) for e in edges]).dropna().filter("low_lat <= high_lat").distinct()
    width = F.col("high_lng") - F.col("low_lng") + F.when(F.col("low_lng") > F.col("high_lng"), 360.0).otherwise(0.0)
    q = asked.select("key", *edges).distinct().withColumn("width", width)
    side = F.greatest("width", F.col("high_lat") - F.col("low_lat"), F.lit(180.0 / 2**LEVELS))
    q = q.withColumn("level", F.least(F.greatest(F.floor(F.log2(180.0 / side)), F.lit(0)), F.lit(LEVELS)).cast("int"))
    size = lambda: F.lit(180.0) / F.pow(F.lit(2.0), F.col("level"))
    number = lambda x: F.floor(x / size()).cast("long")
    around = (F.pow(F.lit(2.0), F.col("level")) * 2).cast("long")
    first = number(F.col("low_lng") + 180)
    columns = F.array_distinct(F.transform(F.sequence(first, F.least(number(F.col("low_lng") + F.col("width") + 180), first + around - 1)), lambda c: F.pmod(c, around)))
    rows = F.sequence(number(F.col("low_lat") + 90), number(F.col("high_lat") + 90))
    q = q.withColumn("row", F.explode(rows)).withColumn("col", F.explode(columns))
    levels = [r["level"] for r in q.select("level").distinct().collect()]  # LEVELS + 1 numbers at most
    spots = _spots(places, k).withColumn("level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    spots = spots.withColumn("row", number(F.col("lat") + 90)).withColumn("col", F.pmod(number(F.col("lng") + 180), around))
    met = q.join(spots, ["key", "level", "row", "col"])
    east = F.pmod(F.col("lng") - F.col("low_lng"), F.lit(360.0))  # how far east of the western edge
    met = met.filter(F.col("lat").between(F.col("low_lat"), F.col("high_lat")) & ((east <= F.col("width")) | (F.col("width") >= 360)))
    middle = F.pmod(F.col("low_lng") + F.col("width") / 2 + 180, F.lit(360.0)) - 180
    met = met.withColumn("metres", metres((F.col("low_lat") + F.col("high_lat")) / 2, middle, F.col("lat"), F.col("lng")))
    hits = met.select("key", *edges, "metres", F.explode("ids").alias("place_id"))
    best = _best(hits, ["key", *edges], k)
    # a query that asks several rectangles ranks the hits of all of them
    found = asked.join(best.drop("rank"), ["key", *edges])
    return _best(found, ["query_id"], k).select("query_id", "rank", "place_id", "metres")
