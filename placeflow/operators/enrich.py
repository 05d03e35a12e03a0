"""From a shared link to pins: candidates, resolution, verdicts and the pin record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import state as S
from ..functions import taxonomy as T
from ..functions import text as X
from ..sources.lookup import details as with_details
from ..sources.lookup import first_hits

# fixed values: snake-case details by the pin's field
FLAGS = {
    "servesBreakfast": "serves_breakfast", "servesLunch": "serves_lunch", "servesDinner": "serves_dinner", "servesBrunch": "serves_brunch", "servesBeer": "serves_beer", "servesWine": "serves_wine",
    "servesCocktails": "serves_cocktails", "servesCoffee": "serves_coffee", "servesDessert": "serves_dessert", "servesVegetarianFood": "serves_vegetarian_food", "outdoorSeating": "outdoor_seating",
    "goodForChildren": "good_for_children", "goodForGroups": "good_for_groups", "allowsDogs": "allows_dogs", "restroom": "restroom", "menuForChildren": "menu_for_children", "liveMusic": "live_music",
}
PAYMENT = ("accepts_credit_cards", "accepts_debit_cards", "accepts_cash_only", "accepts_nfc")
PARKING = ("free_parking_lot", "paid_parking_lot", "free_street_parking", "paid_street_parking", "valet_parking", "free_garage_parking", "paid_garage_parking")
ACCESS = ("wheelchair_accessible_parking", "wheelchair_accessible_entrance", "wheelchair_accessible_restroom", "wheelchair_accessible_seating")


def _camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.title() for w in rest)


def atmosphere(details: Column) -> Column:
    """struct of the 17 flags, status, summary and option structs of a details variant; missing ones are null, and the struct is there for null details."""
    get = lambda p, t="boolean": F.try_variant_get(details, f"$.{p}", t)

    def options(at: str, names: tuple[str, ...]) -> Column:
        return F.when(get(at, "variant").isNotNull(), F.struct(*[get(f"{at}.{n}").alias(_camel(n)) for n in names])).alias(_camel(at))

    summary = F.when(get("editorial_summary", "variant").isNotNull(), F.struct(get("editorial_summary.text", "string").alias("text"), get("editorial_summary.language_code", "string").alias("languageCode")))
    corner = lambda c: F.struct(get(f"viewport.{c}.latitude", "double").alias("latitude"), get(f"viewport.{c}.longitude", "double").alias("longitude")).alias(c)
    return F.struct(
        *[get(v).alias(k) for k, v in FLAGS.items()], get("business_status", "string").alias("businessStatus"), summary.alias("editorialSummary"),
        F.when(get("viewport", "variant").isNotNull(), F.struct(corner("low"), corner("high"))).alias("viewport"),
        options("payment_options", PAYMENT), options("parking_options", PARKING), options("accessibility_options", ACCESS),
    )


def price_range(raw: Column) -> Column:
    """Flat start and end amounts of a price variant, null where not a number; the start's currency, else the end's."""
    number = lambda p: (lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x))(F.try_variant_get(raw, p, "string").try_cast("double"))
    parts = [number(f"$.{side}_price.{unit}").cast("long").alias(f"{side}{unit.title()}") for side in ("start", "end") for unit in ("units", "nanos")]
    code = F.coalesce(*[F.try_variant_get(raw, f"$.{s}_price.currency_code", "string") for s in ("start", "end")])
    return F.when(raw.isNotNull(), F.struct(*parts, code.alias("currencyCode")))


def periods(hours: Column, current: bool = False) -> Column:
    """Opening periods of array<struct<open, close>> (day, hour, minute): missing parts are 0; a missing close is 0:0:0, or null for current hours."""
    at = lambda t: F.struct(*[F.coalesce(t[k], F.lit(0)).alias(k) for k in ("day", "hour", "minute")])
    end = lambda t: F.when(t.isNotNull(), at(t)) if current else at(t)
    return F.transform(hours, lambda p: F.struct(end(p["open"]).alias("open"), end(p["close"]).alias("close")))


def candidates(text: DataFrame, vision: DataFrame) -> DataFrame:
    """(job_id, pos, name, city, address, source) of text then vision candidates, the first of each name in a job; vision's location is its city."""
    v = vision.select("job_id", (F.col("pos") + 1_000_000).alias("pos"), "name", F.col("location").alias("city"), F.lit("").alias("address"), F.lit("vision").alias("source"))
    rows = text.select("job_id", "pos", "name", "city", "address", "source").unionByName(v).withColumn("k", X.name_key(F.col("name"))).filter("k <> ''")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("job_id", "k").orderBy("pos"))).filter("_n = 1").drop("_n", "k")


def resolve(rows: DataFrame, search: DataFrame, details: DataFrame, pins: DataFrame) -> DataFrame:
    """Candidates with a place and state: unresolved (no query, hit or details), existing (the user has it) or new."""
    q = rows.withColumn("query", S.candidate_query(F.col("name"), F.col("address"), F.col("city")))
    hit = first_hits(q, search.select("query_key", "rank", "place_id"), "query")
    found = with_details(hit, details.select("place_id", F.lit(True).alias("_d")).distinct())
    mine = pins.groupBy("user_id", "place_id").agg(F.min("pin_id").alias("existing_pin"))
    out = found.join(mine, ["user_id", "place_id"], "left")
    state = F.when(F.col("place_id").isNull(), "unresolved").when(F.col("existing_pin").isNotNull(), "existing").when(F.col("_d").isNull(), "unresolved").otherwise("new")
    return out.withColumn("state", state).drop("_d", "n_hits")


def verdicts(tallies: DataFrame) -> DataFrame:
    """Terminal status of jobs from tallies, first match wins.

    Columns: url_pin, maps_pin, maps_existing, content_pin, n_new, n_existing, n_unresolved, raced, fallback
    (null, duplicate, new or existing), failed.
    """
    c = F.col
    status = (
        F.when(F.coalesce(c("failed"), F.lit(False)), "failed")
        .when(c("url_pin").isNotNull(), "duplicate")
        .when(c("maps_existing").isNotNull(), "duplicate")
        .when(c("maps_pin").isNotNull(), "complete")
        .when(c("content_pin").isNotNull(), "duplicate")
        .when((c("n_new") == 0) & (c("n_existing") > 0) & (c("n_unresolved") == 0), "duplicate")
        .when((c("n_new") == 1) & F.coalesce(c("raced"), F.lit(False)), "duplicate")
        .when(c("n_new") == 1, "complete")
        .when(c("n_new") > 1, "needs_selection")
        .when(c("fallback").isin("duplicate", "existing"), "duplicate")
        .when(c("fallback") == "new", "complete")
        .when(c("n_existing") > 0, "duplicate")
        .otherwise("failed")
    )
    return tallies.withColumn("status", status)


def pin_records(places: DataFrame, users: DataFrame, reason: str = "enrichment") -> DataFrame:
    """Pins of resolved places: user_id, url, place_id, name, address, lat, lng, types, primary_type, rating, utc_offset.

    Empty text and 0 count as missing where the record says so; coordinates stay. Adds category, cuisine,
    source, address parts and the distance from a valid home.
    """
    homes = users.select("user_id", F.when(G.valid_home(F.col("home_lat"), F.col("home_lng")), F.col("home_lat")).alias("_hlat"), F.col("home_lng").alias("_hlng"))
    c = F.col
    rows = places.join(homes, "user_id", "left").withColumn("where", G.location_of_address(c("address")))
    category, cuisine = T.classes(rows)
    from ..functions import url as U

    return rows.select(
        "user_id", "url", U.source_app(c("url")).alias("source_app"), U.domain(c("url")).alias("source_domain"), "place_id", F.nullif(c("name"), F.lit("")).alias("place_name"), F.nullif(c("address"), F.lit("")).alias("formatted_address"),
        c("lat").alias("latitude"), c("lng").alias("longitude"), category.alias("category"), cuisine.alias("cuisine"), F.nullif(c("rating"), F.lit(0.0)).alias("rating"),
        c("utc_offset").alias("utc_offset_minutes"), c("where.country").alias("country"), c("where.region").alias("region"), c("where.city").alias("city"), F.lit("pinned").alias("status"), F.lit(85).alias("confidence_score"),
        S.assert_save_reason(F.lit(reason)).alias("save_origin"), G.round_km(G.distance_km(c("lat"), c("lng"), c("_hlat"), c("_hlng"))).alias("distance_from_home_km"),
        F.lit(None).cast("double").alias("distance_from_user_km"), F.lit(None).cast("string").alias("rec_attribution_id"),
    )
