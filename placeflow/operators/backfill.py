"""Backfills: scan, derive, decide an outcome per row, write what changed if the row is still the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import taxonomy as T
from ..functions import variant as V
from .members import ladder


def page(rows: DataFrame, key: str, after: str | None, size: int) -> tuple[DataFrame, Column]:
    """The next rows by key, strictly after a cursor that need not exist, and the test for more: as many as asked for."""
    some = rows if after is None else rows.filter(F.col(key) > after)
    return some.orderBy(key).limit(size), F.count("*") == size


def reclassify(pins: DataFrame, any_category: bool = False) -> DataFrame:
    """Food pins (category, types, primary_type) with new_category, new_cuisine and outcome."""
    category, cuisine = T.classes(pins)
    out = pins.withColumn("new_category", category).withColumn("new_cuisine", cuisine).drop("_category", "_cuisine")
    fits = F.lit(any_category) | F.col("new_category").isin(*T.FOOD)
    return out.withColumn("outcome", ladder((~F.col("category").eqNullSafe("food"), "skippedNonCohort"), (~fits, "skippedUnclassifiable"), last="updated"))


def refresh_details(pins: DataFrame, details: DataFrame, version: int = 4) -> DataFrame:
    """Pins re-enriched by version: no place and the right version are skipped, missing details fail. `details` has place_id and found."""
    out = pins.join(details.select("place_id", F.lit(True).alias("_d")).distinct(), "place_id", "left")
    steps = ((F.coalesce(F.col("place_id"), F.lit("")) == "", "skippedNoPlace"), (F.col("enrichment_version").eqNullSafe(version), "skippedVersion"), (F.col("_d").isNull(), "failed"))
    return out.withColumn("outcome", ladder(*steps, last="updated")).drop("_d")


def retype(pins: DataFrame, details: DataFrame) -> DataFrame:
    """Unclassifiable pins with types from details (place_id, types, primary_type): outcome and new types."""
    one = details.groupBy("place_id").agg(F.min(F.struct("types", "primary_type")).alias("d"))  # a place has one row, whatever the table holds
    d = one.select("place_id", F.lit(True).alias("_d"), F.col("d.types").alias("new_types"), F.col("d.primary_type").alias("new_primary"))
    out = pins.join(d, "place_id", "left")
    steps = (
        (T.category(F.col("types"), F.col("primary_type")) != "other", "skippedAlreadyPopulated"),
        (F.coalesce(F.col("place_id"), F.lit("")) == "", "skippedNoPlaceId"),
        (F.col("_d").isNull(), "failures"),
        ((F.coalesce(F.size("new_types"), F.lit(0)) <= 0) & F.col("new_primary").isNull(), "skippedNoApiSignal"),
    )
    return out.withColumn("outcome", ladder(*steps, last="updated")).drop("_d")


def spend(counts: DataFrame, paid: tuple[str, ...] = ("updated", "raced", "failures", "skippedNoApiSignal")) -> DataFrame:
    """Paid calls from outcome counts."""
    return counts.agg(F.coalesce(F.sum(F.when(F.col("outcome").isin(*paid), F.col("n"))), F.lit(0)).cast("long").alias("paid_calls"))


def convert_profiles(lists: DataFrame) -> DataFrame:
    """Lists with profiles (variant): arrays become maps, maps stay, anything else is reset to an empty map."""
    return lists.withColumn("outcome", V.profile_outcome(F.col("profiles"))).withColumn("converted", F.when(F.col("outcome") == "convertedFromArray", V.profiles(F.col("profiles"))))


def resolve_homes(users: DataFrame, hits: DataFrame) -> DataFrame:
    """Users (home_lat, home_lng, home_city) against the top hit of their city (query_key, name, types, lat, lng; failed marks a failed search)."""
    top = hits.filter("rank = 1") if "rank" in hits.columns else hits
    top = top.groupBy("query_key").agg(F.min(F.struct("name", "types", "lat", "lng", "failed")).alias("h")).select("query_key", "h.*")
    top = top.select(F.col("query_key").alias("_q"), F.col("name").alias("hit_name"), F.col("types").alias("hit_types"), F.col("lat").alias("hit_lat"), F.col("lng").alias("hit_lng"), "failed")
    out = users.withColumn("_c", F.trim(F.coalesce("home_city", F.lit("")))).join(top, F.col("_c") == F.col("_q"), "left").drop("_q")
    bad = F.col("hit_lat").isNull() | F.col("hit_lng").isNull() | F.isnan("hit_lat") | F.isnan("hit_lng")
    steps = (
        (G.valid_home(F.col("home_lat"), F.col("home_lng")), "alreadyResolved"),
        (F.col("_c") == "", "noHomeCity"),
        (F.col("failed"), "searchFailed"),
        (F.col("hit_name").isNull(), "noMatch"),
        (~G.city_match(F.col("hit_types"), F.col("hit_name"), F.col("_c")), "ambiguous"),
        (bad, "ambiguous"),
    )
    return out.withColumn("outcome", ladder(*steps, last="resolved")).drop("_c", "failed")


def still_same(planned: DataFrame, current: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Planned updates against the current rows: those whose columns changed or that are gone are 'raced'."""
    now = current.select(key, F.lit(True).alias("_now"), *[F.col(c).alias(f"_{c}") for c in columns])
    same = F.col("_now").isNotNull()
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    out = planned.join(now, key, "left").withColumn("outcome", F.when((F.col("outcome") == "updated") & ~same, "raced").otherwise(F.col("outcome")))
    return out.select(*planned.columns)
