"""Addresses, distances and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import match_form, trim

EARTH_KM = 6371
# fixed values: place types that are cities or administrative areas
CITY_TYPES = ("locality", "administrative_area_level_1", "administrative_area_level_2", "administrative_area_level_3", "administrative_area_level_4")


def distance_km(lat_a: Column, lng_a: Column, lat_b: Column, lng_b: Column) -> Column:
    rad = lambda x: x * F.pi() / 180
    a = F.pow(F.sin(rad(lat_b - lat_a) / 2), 2.0) + F.cos(rad(lat_a)) * F.cos(rad(lat_b)) * F.pow(F.sin(rad(lng_b - lng_a) / 2), 2.0)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def round_km(d: Column) -> Column:
    return F.floor(d * 10 + 0.5) / 10


def valid_home(lat: Column, lng: Column) -> Column:
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lng) & lat.between(-90, 90) & lng.between(-180, 180), F.lit(False))


def city_match(types: Column, name: Column, home: Column) -> Column:
    """A city-like place whose first comma-separated part is the home city's."""
    first = lambda x: match_form(F.substring_index(match_form(x), ",", 1))
    typed = F.coalesce(F.arrays_overlap(types, F.array(*map(F.lit, CITY_TYPES))), F.lit(False))
    return typed & (match_form(name) != "") & (match_form(home) != "") & (first(name) == first(home))


def location_of_parts(parts: Column) -> Column:
    """struct(country, region, city) of array<struct<name, types>> address parts.

    The last country and first-level area win, the first locality and district do. A missing city is the
    region (which then is null), else the district.
    """
    has = lambda c, *t: F.arrays_overlap(c["types"], F.array(*map(F.lit, t)))
    kind = lambda c: (
        F.when(has(c, "country"), "country").when(has(c, "administrative_area_level_1"), "region")
        .when(has(c, "locality", "postal_town", "administrative_area_level_2"), "city").when(has(c, "sublocality_level_1", "sublocality"), "district")
    )
    names = lambda k: F.transform(F.filter(parts, lambda c: kind(c) == k), lambda c: c["name"])
    country, region = (F.try_element_at(names(k), F.lit(-1)) for k in ("country", "region"))
    city, district = (F.get(F.filter(names(k), lambda n: n != ""), F.lit(0)) for k in ("city", "district"))
    return F.struct(country.alias("country"), F.when(city.isNotNull(), region).alias("region"), F.coalesce(city, region, district).alias("city"))


def location_of_address(address: Column) -> Column:
    """struct(country, region, city) of a comma-separated address.

    The last of two or more parts is the country. Of the others, those that begin with a digit are skipped, a
    state code with a number names the region, the first plain one the city and the next the region.
    """
    parts = F.transform(F.split(address, ","), trim)
    some = F.coalesce(address != "", F.lit(False))
    body = F.filter(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: ~p.rlike(r"^\d"))
    start = F.struct(F.lit(None).cast("string").alias("region"), F.lit(None).cast("string").alias("city"))
    coded = lambda p: p.rlike(r"^[A-Z]{2}\s+\d{4,}")

    def step(acc: Column, p: Column) -> Column:
        none = lambda x: F.coalesce(x, F.lit("")) == ""
        region = F.when(coded(p), F.regexp_replace(p, r"\s+\d+.*$", "")).when(~none(acc["city"]) & none(acc["region"]), p).otherwise(acc["region"])
        return F.struct(region.alias("region"), F.when(~coded(p) & none(acc["city"]), p).otherwise(acc["city"]).alias("city"))

    found = F.aggregate(body, start, step)
    country = F.when(some & (F.size(parts) >= 2), F.element_at(parts, -1))
    return F.struct(country.alias("country"), F.when(some, found["region"]).alias("region"), F.when(some, found["city"]).alias("city"))
