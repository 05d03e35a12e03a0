"""Categories, cuisines and confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import cleaned

# fixed values: place types by category, first match wins; any type that ends in _restaurant is a restaurant
CATEGORIES = {
    "restaurant": ("restaurant", "meal_takeaway", "meal_delivery", "fast_food_restaurant", "food_court", "bar_and_grill", "steak_house", "barbecue_restaurant", "pizza_restaurant"),
    "cafe": ("cafe", "coffee_shop", "bakery", "ice_cream_shop", "dessert_shop", "sandwich_shop", "bagel_shop"),
    "bar": ("bar", "wine_bar", "pub", "night_club"),
    "accommodation": ("lodging", "campground", "motel", "resort"),
    "attraction": ("tourist_attraction", "museum", "art_gallery", "amusement_park", "zoo", "aquarium", "stadium"),
    "nature": ("park", "natural_feature", "hiking_area"),
    "shopping": ("shopping_mall", "store", "clothing_store", "book_store", "supermarket"),
    "wellness": ("spa", "gym", "beauty_salon", "hair_care"),
    "entertainment": ("movie_theater", "bowling_alley", "casino", "concert_hall"),
}
# fixed values: cuisines by place type; a steak house has none of the fifteen and so is 'other'
CUISINES = {
    "american_restaurant": "american", "barbecue_restaurant": "bbq", "chinese_restaurant": "chinese", "french_restaurant": "french", "greek_restaurant": "mediterranean",
    "indian_restaurant": "indian", "italian_restaurant": "italian", "japanese_restaurant": "japanese", "korean_restaurant": "korean", "lebanese_restaurant": "mediterranean",
    "mediterranean_restaurant": "mediterranean", "mexican_restaurant": "mexican", "middle_eastern_restaurant": "mediterranean", "pizza_restaurant": "pizza",
    "ramen_restaurant": "japanese", "seafood_restaurant": "seafood", "spanish_restaurant": "spanish", "sushi_restaurant": "japanese", "thai_restaurant": "thai",
    "turkish_restaurant": "mediterranean", "vietnamese_restaurant": "vietnamese",
}
TRAVEL_SITES = ("tripadvisor", "yelp", "google", "opentable", "michelin", "timeout")
#: The categories that `food` splits into.
FOOD = ("restaurant", "cafe", "bar")


def is_restaurant(kind: Column) -> Column:
    return F.coalesce(kind.isin(*CATEGORIES["restaurant"]) | kind.endswith("_restaurant"), F.lit(False))


def _is(kind: Column, category: str) -> Column:
    return is_restaurant(kind) if category == "restaurant" else F.coalesce(kind.isin(*CATEGORIES[category]), F.lit(False))


def _any(types: Column, category: str) -> Column:
    return F.coalesce(F.exists(types, lambda t: _is(t, category)), F.lit(False))


def _first(test) -> Column:
    out = F
    for c in CATEGORIES:
        out = out.when(test(c), c)
    return out.otherwise("other")


def category(types: Column, primary: Column) -> Column:
    """The first category that a type has, else the primary type's, else 'other'."""
    return F.coalesce(F.nullif(_first(lambda c: _any(types, c)), F.lit("other")), _first(lambda c: _is(primary, c)))


def cuisine(types: Column, primary: Column) -> Column:
    """Null unless food; the first of [primary, types] with a cuisine, else 'other'."""
    food = _any(types, "restaurant") | _any(types, "cafe") | _is(primary, "restaurant") | _is(primary, "cafe")
    known = F.create_map(*[F.lit(x) for pair in CUISINES.items() for x in pair])
    order = F.filter(F.concat(F.array(primary), F.coalesce(types, F.array().cast("array<string>"))), lambda t: t.isNotNull())
    hits = F.filter(F.transform(order, lambda t: F.try_element_at(known, t)), lambda c: c.isNotNull())
    return F.when(food, F.coalesce(F.get(hits, F.lit(0)), F.lit("other")))


def confidence(name: Column, address: Column, ratings: Column, results: Column, title: Column, description: Column, site: Column) -> Column:
    """A place's score against a page: name in the title 40, a longer address word 20, a travel site 20, many ratings 10, sole result 10."""
    low = lambda x: F.lower(F.coalesce(x, F.lit("")))
    page = F.struct(low(cleaned(F.coalesce(title, F.lit("")))).alias("head"), low(cleaned(F.coalesce(description, F.lit("")))).alias("body"))
    given = F.struct(page.alias("page"), low(name).alias("name"), F.filter(F.split(low(address), r"[,\s]+"), lambda w: F.length(w) > 3).alias("words"), low(site).alias("site"), ratings.alias("ratings"), results.alias("results"))

    def score(g: Column) -> Column:
        points = (
            (40, (g["name"] != "") & g["page"]["head"].contains(g["name"])),
            (20, F.exists(g["words"], lambda w: F.concat(g["page"]["head"], F.lit(" "), g["page"]["body"]).contains(w))),
            (20, F.exists(F.array(*map(F.lit, TRAVEL_SITES)), lambda s: g["site"].contains(s))),
            (10, g["ratings"] > 100),
            (10, g["results"] == 1),
        )
        out = F.lit(0)
        for n, test in points:
            out = out + F.when(test, n).otherwise(0)
        return out

    # a page is cleaned once, not once a word of the address
    return F.when(results > 0, F.element_at(F.transform(F.array(given), score), 1)).otherwise(0)


def gate(score: Column, matches: Column, better: Column) -> Column:
    """Final score of a hit: 60 and above stay; a lower one that the verifier replaces gets at least 60; under 30 goes (null)."""
    new = F.when((score < 60) & ~F.coalesce(matches, F.lit(True)) & better.isNotNull(), F.greatest(better, F.lit(60))).otherwise(score)
    return F.when(new >= 30, new)


def classified(places: DataFrame) -> DataFrame:
    """Places (types, primary_type) with their category and cuisine in _category and _cuisine: classified once each, whatever joins them."""
    return places.withColumn("_category", category(F.col("types"), F.col("primary_type"))).withColumn("_cuisine", cuisine(F.col("types"), F.col("primary_type")))


def classes(rows: DataFrame) -> tuple[Column, Column]:
    """Category and cuisine of rows: those of `classified`, or worked out from types and primary_type."""
    if "_category" in rows.columns:  # a row that no place joined has no types
        return F.coalesce("_category", F.lit("other")), F.col("_cuisine")
    return category(F.col("types"), F.col("primary_type")), cuisine(F.col("types"), F.col("primary_type"))
