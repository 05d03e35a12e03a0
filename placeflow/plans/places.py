"""Queries over places: taxonomy, geography, confidence, pin records and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import state as S
from ..functions import taxonomy as T
from ..functions import text as X
from ..operators import backfill as B
from ..operators import dedup
from ..operators import enrich as E
from ..operators import members as M
from ..sources import lookup
from ..sources.tables import frame
from .registry import query, rows, spread, spread_sql, values

TYPES = [
    (-1, "cafe,bar", None), (-2, "wine_bar", "italian_restaurant"), (-3, "point_of_interest,establishment", "italian_restaurant"), (-4, None, None), (-5, "ethiopian_restaurant", None), (-6, "night_club", None), (-7, "sushi_restaurant,ramen_restaurant", None),
    (-8, "greek_restaurant", "turkish_restaurant"), (-9, "steak_house", None), (-10, "park", None), (-11, "italian_restaurant,japanese_restaurant", "japanese_restaurant"), (-12, None, "lebanese_restaurant"), (-13, "bakery", "store"), (-14, "gym,store", None),
]
_T = f"(SELECT substring(place_id, 3)::BIGINT AS id, types_csv AS csv, primary_type AS p FROM <places> UNION ALL SELECT id, csv, p FROM {values(TYPES, 'id', 'csv', 'p')} v)"


def _bucket(test: str) -> str:
    """A CASE over buckets; test has {} for a condition on t."""
    out = "CASE"
    for name, types in T.CATEGORIES.items():
        cond = "t IN (" + ", ".join(f"'{x}'" for x in types) + ")" + (" OR t LIKE '%\\_restaurant' ESCAPE '\\'" if name == "restaurant" else "")
        out += f" WHEN {test.replace('{}', cond)} THEN '{name}'"
    return out + " ELSE 'other' END"


_ANY = _bucket("len(list_filter(string_split(coalesce(csv, ''), ','), lambda t: {})) > 0")
_ONE = _bucket("len(list_filter([coalesce(p, '')], lambda t: {})) > 0")
_CATEGORY = f"coalesce(nullif({_ANY}, 'other'), {_ONE})"
_FOOD = "(" + " OR ".join(f"len(list_filter(list_append(string_split(coalesce(csv, ''), ','), coalesce(p, '')), lambda t: {c})) > 0" for c in ("t IN (" + ", ".join(f"'{x}'" for x in (*T.CATEGORIES["restaurant"], *T.CATEGORIES["cafe"])) + ")", "t LIKE '%\\_restaurant' ESCAPE '\\'")) + ")"
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.CUISINES.items()) + "}"
_CUISINE = f"CASE WHEN {_FOOD} THEN coalesce(list_filter(list_transform(list_prepend(coalesce(p, ''), string_split(coalesce(csv, ''), ',')), lambda t: {_MAP}[t]), lambda c: c IS NOT NULL)[1], 'other') END"


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = frame(spark, sf_dir, "places").select(F.substring("place_id", 3, 20).cast("long").alias("id"), F.col("types_csv").alias("csv"), F.col("primary_type").alias("p"))
    return places.unionAll(rows(spark, "id long, csv string, p string", TYPES)).select("id", F.split("csv", ",").alias("types"), F.col("p").alias("primary_type"))


@query(f"SELECT id, {_CATEGORY} AS category, {_CUISINE} AS cuisine FROM {_T}")
def category_cuisine(spark, sf_dir):
    t, p = F.col("types"), F.col("primary_type")
    return typed(spark, sf_dir).select("id", T.category(t, p).alias("category"), T.cuisine(t, p).alias("cuisine"))


@query(f"SELECT id, array_to_string(list_filter(list_concat(string_split(coalesce(csv, ''), ','), CASE WHEN p IS NULL OR list_contains(string_split(coalesce(csv, ''), ','), p) THEN [] ELSE [p] END), lambda x: x <> ''), ',') AS types FROM {_T}")
def types_union(spark, sf_dir):
    return typed(spark, sf_dir).select("id", F.array_join(dedup.types_union(F.col("types"), F.array("primary_type"), F.col("types")), ",").alias("types"))


ADDRESSES = [
    (1, "65 4th Ave, New York, NY 10003, USA"), (2, "Paris, France"), (3, "Japan"), (4, ""), (5, None), (6, "Soho, London, Greater London, UK"), (7, "12345, Berlin, Germany"), (8, "CA 94016, San Jose, USA"), (9, "A, NY 10003, B, C, USA"),
]


_ADDR = f"""(SELECT c_custkey AS id, c_custkey % 300 || ' Road, ' || CASE WHEN c_custkey % 3 = 0 THEN n_name || ' Town, ' ELSE '' END || CASE WHEN c_custkey % 4 = 0 THEN 'AB 1' || (1000 + c_custkey % 999) || ' x, ' ELSE '' END || CASE WHEN c_custkey % 7 = 0 THEN '12 Area, County, ' ELSE '' END || r_name AS addr
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT -id, addr FROM {values(ADDRESSES, 'id', 'addr')})"""


@query(f"""WITH p AS (SELECT id, addr, unnest(string_split(addr, ',')) AS x, generate_subscripts(string_split(addr, ','), 1) AS i, len(string_split(addr, ',')) AS n FROM {_ADDR}),
k AS (SELECT id, i, trim(x) AS x FROM p WHERE i < n AND NOT regexp_matches(trim(x), '^\\d')),
s AS (SELECT *, regexp_matches(x, '^[A-Z]{{2}}\\s+\\d{{4,}}') AS coded FROM k),
c AS (SELECT *, row_number() OVER (PARTITION BY id, coded ORDER BY i) AS m FROM s),
r AS (SELECT id, max(x) FILTER (NOT coded AND m = 1) AS city, max(i) FILTER (coded) AS last_code, min(i) FILTER (NOT coded AND m = 2) AS second FROM c GROUP BY id)
SELECT a.id::BIGINT AS id, CASE WHEN contains(addr, ',') THEN trim(string_split(addr, ',')[-1]) END AS country,
  CASE WHEN last_code IS NOT NULL THEN regexp_replace(trim(string_split(addr, ',')[last_code]), '\\s+\\d+.*$', '') WHEN second IS NOT NULL THEN trim(string_split(addr, ',')[second]) END AS region, city
FROM {_ADDR} a LEFT JOIN r ON r.id = a.id""")
def location_address(spark, sf_dir):
    """An address for every customer, of two to six parts."""
    t = {n: frame(spark, sf_dir, n) for n in ("customer", "nation", "region")}
    k = F.col("c_custkey").cast("long")
    j = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    addr = F.concat(k % 300, F.lit(" Road, "), F.when(k % 3 == 0, F.concat("n_name", F.lit(" Town, "))).otherwise(""), F.when(k % 4 == 0, F.concat(F.lit("AB 1"), 1000 + k % 999, F.lit(" x, "))).otherwise(""), F.when(k % 7 == 0, "12 Area, County, ").otherwise(""), F.col("r_name"))
    all_ = j.select(k.alias("id"), addr.alias("addr")).unionAll(rows(spark, "id long, addr string", [(-i, a) for i, a in ADDRESSES]))
    return all_.select("id", G.location_of_address(F.col("addr")).alias("w")).select("id", "w.*")


PARTS = [(1, "France", "country"), (1, "Paris", "locality"), (1, "Île-de-France", "administrative_area_level_1"), (2, "Tokyo", "administrative_area_level_1"), (2, "Japan", "country"), (3, "Shibuya", "sublocality"), (4, "A", "postal_town"), (4, "B", "locality"), (4, "C1", "country"), (4, "C2", "country")]


# parts of every customer's address, in one of the orders above
_PARTS = f"(SELECT CASE WHEN c.k IS NULL THEN -v.id ELSE c.k END AS id, CASE WHEN c.k IS NULL THEN v.name ELSE v.name || ' ' || (c.k % 50) END AS name, v.type, v.i FROM {values([(i, *p) for i, p in enumerate(PARTS)], 'i', 'id', 'name', 'type')} v LEFT JOIN (SELECT c_custkey AS k, 1 + c_custkey % 4 AS m FROM customer UNION ALL SELECT NULL, unnest([1, 2, 3, 4])) c ON c.m = v.id)"


@query(f"""WITH p AS (SELECT * FROM {_PARTS} x),
g AS (SELECT id, arg_max(name, i) FILTER (type = 'country') AS country, arg_max(name, i) FILTER (type = 'administrative_area_level_1') AS admin, arg_min(name, i) FILTER (type IN ('locality', 'postal_town', 'administrative_area_level_2')) AS town,
  arg_min(name, i) FILTER (type IN ('sublocality', 'sublocality_level_1')) AS district FROM p GROUP BY id)
SELECT id::BIGINT AS id, country, CASE WHEN town IS NOT NULL THEN admin END AS region, coalesce(town, admin, district) AS city FROM g""")
def location_components(spark, sf_dir):
    k = F.col("c_custkey").cast("long")
    known = rows(spark, "i int, m long, name string, type string", [(i, *p) for i, p in enumerate(PARTS)])
    every = frame(spark, sf_dir, "customer").select(k.alias("id"), (1 + k % 4).alias("m")).join(F.broadcast(known), "m")  # ten rows
    r = every.select("id", "i", F.concat_ws(" ", "name", F.col("id") % 50).alias("name"), "type").unionAll(known.select(-F.col("m"), "i", "name", "type"))
    parts = r.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "name", "type"))), lambda x: F.struct(x["name"].alias("name"), F.array(x["type"]).alias("types"))).alias("parts"))
    return parts.select("id", G.location_of_parts(F.col("parts")).alias("w")).select("id", "w.*")


@query("""SELECT p.pin_id, CASE WHEN u.home_lat BETWEEN -90 AND 90 AND u.home_lng BETWEEN -180 AND 180 THEN
  floor(2 * 6371 * atan2(sqrt(a), sqrt(1 - a)) * 10 + 0.5) / 10 END AS km FROM (SELECT p.pin_id, p.user_id, u.home_lat, u.home_lng,
  pow(sin(radians(k % 170 - 85 - u.home_lat) / 2), 2) + cos(radians(u.home_lat)) * cos(radians(k % 170 - 85)) * pow(sin(radians(k % 350 - 175 - u.home_lng) / 2), 2) AS a
  FROM (SELECT *, substring(pin_id, 2)::BIGINT AS k FROM <pins>) p LEFT JOIN <users> u ON u.user_id = p.user_id) p LEFT JOIN <users> u ON u.user_id = p.user_id""")
def home_distance(spark, sf_dir):
    k = F.substring("pin_id", 2, 20).cast("long")
    pins = frame(spark, sf_dir, "pins").select("pin_id", "user_id", (k % 170 - 85).cast("double").alias("lat"), (k % 350 - 175).cast("double").alias("lng"))
    joined = pins.join(frame(spark, sf_dir, "users"), "user_id", "left")
    km = G.round_km(G.distance_km(F.col("home_lat"), F.col("home_lng"), F.col("lat"), F.col("lng")))
    return joined.select("pin_id", F.when(G.valid_home(F.col("home_lat"), F.col("home_lng")), km).alias("km"))


CITIES = [(1, "locality", "Brooklyn, NY", "Brooklyn"), (2, "locality", "New York", "New York City"), (3, "neighborhood", "Soho", "Soho"), (4, "administrative_area_level_1", " TOKYO ,  Japan", "tokyo"), (5, None, "Rome", "Rome"), (6, "locality", "", "Rome")]


_CITIES = f"""(SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'locality' WHEN 1 THEN 'neighborhood' ELSE 'administrative_area_level_2' END AS type, n_name || CASE WHEN c_custkey % 2 = 0 THEN ' , ' || r_name ELSE '' END AS name, CASE WHEN c_custkey % 5 = 0 THEN r_name ELSE '  ' || lower(n_name) END AS home
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT -id, type, name, home FROM {values(CITIES, 'id', 'type', 'name', 'home')})"""


@query(f"""SELECT id::BIGINT AS id, coalesce(type IN ('locality', 'administrative_area_level_1', 'administrative_area_level_2', 'administrative_area_level_3', 'administrative_area_level_4'), false) AND trim(name) <> '' AND trim(home) <> ''
  AND regexp_replace(trim(lower(split_part(name, ',', 1))), '\\s+', ' ', 'g') = regexp_replace(trim(lower(split_part(home, ',', 1))), '\\s+', ' ', 'g') AS matches FROM {_CITIES}""")
def city_match(spark, sf_dir):
    """A hit for every customer's nation against a home that is, or isn't, that one."""
    t = {n: frame(spark, sf_dir, n) for n in ("customer", "nation", "region")}
    k = F.col("c_custkey").cast("long")
    j = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    kind = F.when(k % 3 == 0, "locality").when(k % 3 == 1, "neighborhood").otherwise("administrative_area_level_2")
    r = j.select(k.alias("id"), kind.alias("type"), F.concat("n_name", F.when(k % 2 == 0, F.concat(F.lit(" , "), "r_name")).otherwise("")).alias("name"), F.when(k % 5 == 0, F.col("r_name")).otherwise(F.concat(F.lit("  "), F.lower("n_name"))).alias("home"))
    more = rows(spark, "id long, type string, name string, home string", [(-c[0], *c[1:]) for c in CITIES])
    return r.unionAll(more).select("id", G.city_match(F.array("type"), F.col("name"), F.col("home")).alias("matches"))


@query()
def confidence_score(spark, sf_dir):
    """Every document against its place; without a place there are no results, and the score is 0. No oracle: the engines lower-case and
    trim other alphabets differently; the tests hold this against a loop."""
    from pyspark.sql import Window

    d = frame(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.concat(F.lit("PL"), F.col("doc_id") % 200).alias("place_id"))
    places = frame(spark, sf_dir, "places").select("place_id", "place_name", F.lit(1).alias("hit"))
    j = d.join(places, "place_id", "left").withColumn("results", F.count("hit").over(Window.partitionBy(F.col("id") % 7, "place_id")))
    score = T.confidence(F.col("place_name"), F.concat(F.lit("Main Street, "), F.col("place_name")), F.col("id") % 200, F.col("results"), F.col("text"), F.lit(""), F.when(F.col("id") % 4 == 0, "My Yelp page").otherwise("blog"))
    return j.select("id", score.cast("long").alias("score"))


GATES = [(1, 70, None, None), (2, 50, True, None), (3, 50, False, 40), (4, 20, False, 90), (5, 20, True, None), (6, 40, False, None), (7, 29, None, 80)]


_GATES = f"(SELECT event_id AS id, event_id * 7 % 100 AS score, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS m, CASE WHEN event_id % 4 > 0 THEN event_id * 13 % 100 END AS b FROM events UNION ALL SELECT -id, score, m, b FROM {values(GATES, 'id', 'score', 'm', 'b')})"


@query(f"SELECT id::BIGINT AS id, CASE WHEN s >= 30 THEN s END::BIGINT AS score FROM (SELECT id, CASE WHEN score < 60 AND NOT coalesce(m, true) AND b IS NOT NULL THEN greatest(b, 60) ELSE score END AS s FROM {_GATES})")
def confidence_gate(spark, sf_dir):
    k = F.col("event_id").cast("long")
    e = frame(spark, sf_dir, "events").select(k.alias("id"), (k * 7 % 100).alias("score"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("m"), F.when(k % 4 > 0, k * 13 % 100).alias("b"))
    more = rows(spark, "id long, score long, m boolean, b long", [(-r[0], *r[1:]) for r in GATES])
    return e.unionAll(more).select("id", T.gate(F.col("score"), F.col("m"), F.col("b")).alias("score"))


def food_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = T.classified(frame(spark, sf_dir, "places").select("place_id", "place_name", F.split("types_csv", ",").alias("types"), "primary_type"))
    return frame(spark, sf_dir, "pins").join(places, "place_id", "left")


_JOB4 = f"(SELECT pin_id, CASE WHEN category <> 'food' THEN 'skippedNonCohort' WHEN new_category IN ('restaurant', 'cafe', 'bar') THEN 'updated' ELSE 'skippedUnclassifiable' END AS outcome, new_category, cuisine FROM (SELECT pin_id, category, {_CATEGORY} AS new_category, {_CUISINE} AS cuisine FROM (SELECT n.pin_id, n.category, pl.types_csv AS csv, pl.primary_type AS p FROM <pins> n LEFT JOIN <places> pl ON pl.place_id = n.place_id)))"


@query(f"SELECT outcome, count(*)::BIGINT AS n FROM {_JOB4} GROUP BY outcome")
def backfill_category_stats(spark, sf_dir):
    return M.outcome_counts(B.reclassify(food_pins(spark, sf_dir)))


@query(f"SELECT pin_id, outcome, new_category, cuisine AS new_cuisine FROM {_JOB4} WHERE outcome = 'updated'")
def backfill_category_updates(spark, sf_dir):
    planned = B.reclassify(food_pins(spark, sf_dir)).select("pin_id", "category", "outcome", "new_category", "new_cuisine")
    return B.still_same(planned, frame(spark, sf_dir, "pins"), "pin_id", ["category"]).filter("outcome = 'updated'").select("pin_id", "outcome", "new_category", "new_cuisine")


@query(f"SELECT outcome, pin_id FROM (SELECT outcome, pin_id, row_number() OVER (PARTITION BY outcome ORDER BY pin_id) AS n FROM {_JOB4}) WHERE n <= 20")
def backfill_samples(spark, sf_dir):
    return M.samples(B.reclassify(food_pins(spark, sf_dir)).select("outcome", "pin_id"), "pin_id")


@query("SELECT pin_id, user_id FROM <pins> WHERE pin_id > 'P12' ORDER BY pin_id LIMIT 200")
def keyset_page(spark, sf_dir):
    """A page is the operator: the limit is the feature."""
    return B.page(frame(spark, sf_dir, "pins"), "pin_id", "P12", 200)[0].select("pin_id", "user_id")


@query("SELECT outcome, count(*)::BIGINT AS n FROM (SELECT CASE WHEN enrichment_version = 4 THEN 'skippedVersion' WHEN l.place_id IS NULL THEN 'failed' ELSE 'updated' END AS outcome FROM <pins> n LEFT JOIN <places> l ON l.place_id = n.place_id) GROUP BY outcome")
def version_skip(spark, sf_dir):
    return M.outcome_counts(B.refresh_details(frame(spark, sf_dir, "pins"), frame(spark, sf_dir, "places")))


_JOB6 = f"(SELECT CASE WHEN {_CATEGORY} <> 'other' THEN 'skippedAlreadyPopulated' WHEN d.place_id IS NULL THEN 'failures' WHEN d.csv2 IS NULL AND d.p2 IS NULL THEN 'skippedNoApiSignal' ELSE 'updated' END AS outcome FROM (SELECT n.place_id, CASE WHEN length(n.pin_id) % 2 = 0 THEN pl.types_csv END AS csv, NULL::VARCHAR AS p FROM <pins> n LEFT JOIN <places> pl ON pl.place_id = n.place_id) n LEFT JOIN (SELECT place_id, types_csv AS csv2, primary_type AS p2 FROM <places>) d ON d.place_id = n.place_id)"


@query(f"SELECT outcome, count(*)::BIGINT AS n, (SELECT count(*) FROM {_JOB6} WHERE outcome IN ('updated', 'raced', 'failures', 'skippedNoApiSignal'))::BIGINT AS paid FROM {_JOB6} GROUP BY outcome")
def place_types_outcomes(spark, sf_dir):
    places = frame(spark, sf_dir, "places").select("place_id", F.split("types_csv", ",").alias("types"), "primary_type")
    pins = frame(spark, sf_dir, "pins").join(places.drop("primary_type"), "place_id", "left")
    pins = pins.select("pin_id", "place_id", F.when(F.length("pin_id") % 2 == 0, F.col("types")).alias("types"), F.lit(None).cast("string").alias("primary_type"))
    counts = M.outcome_counts(B.retype(pins, places))
    return counts.withColumn("_k", F.lit(0)).join(F.broadcast(B.spend(counts).withColumn("_k", F.lit(0))), "_k").select("outcome", "n", F.col("paid_calls").alias("paid"))


HITS = [("Oslo", "Oslo, Norway", "locality", 59.9, 10.7, False), ("Bern", "Bern Bar", "bar", 46.9, 7.4, False), ("Rome", "Rome, Italy", "locality", None, None, False), ("Fail", None, None, None, None, True)]


@query(f"""WITH u AS (SELECT user_id, home_lat, home_lng, CASE substring(user_id, 2)::INT % 6 WHEN 0 THEN 'Oslo' WHEN 1 THEN ' Bern ' WHEN 2 THEN 'Rome' WHEN 3 THEN 'Fail' WHEN 4 THEN 'Nowhere' END AS city FROM <users>)
SELECT user_id, CASE WHEN home_lat BETWEEN -90 AND 90 AND home_lng BETWEEN -180 AND 180 THEN 'alreadyResolved' WHEN coalesce(trim(city), '') = '' THEN 'noHomeCity' WHEN h.failed THEN 'searchFailed' WHEN h.name IS NULL THEN 'noMatch' WHEN h.type <> 'locality' THEN 'ambiguous' WHEN h.lat IS NULL THEN 'ambiguous' ELSE 'resolved' END AS outcome
FROM u LEFT JOIN {values(HITS, 'q', 'name', 'type', 'lat', 'lng', 'failed')} h ON h.q = trim(city)""")
def home_location_outcomes(spark, sf_dir):
    hits = rows(spark, "query_key string, name string, type string, lat double, lng double, failed boolean", HITS).withColumn("types", F.array("type"))
    k = F.substring("user_id", 2, 9).cast("int") % 6
    city = F.when(k == 0, "Oslo").when(k == 1, " Bern ").when(k == 2, "Rome").when(k == 3, "Fail").when(k == 4, "Nowhere")
    return B.resolve_homes(frame(spark, sf_dir, "users").withColumn("home_city", city), hits).select("user_id", "outcome")


PRICES = [(1, '{"start_price":{"units":"10","nanos":5,"currency_code":"EUR"},"end_price":{"units":"20"}}'), (2, '{"end_price":{"units":"abc","nanos":"1000000000","currency_code":"USD"}}'), (3, "{}"), (4, None)]


_PRICED = f"(SELECT k AS id, CASE WHEN k < 0 THEN body ELSE replace(body, '20', (k % 500)::VARCHAR) END AS body FROM {spread_sql(PRICES, 'id', 'body')} x)"


@query(f"""SELECT id::BIGINT AS id, TRY_CAST(body::JSON->'start_price'->>'units' AS BIGINT) AS start_units, TRY_CAST(body::JSON->'start_price'->>'nanos' AS BIGINT) AS start_nanos, TRY_CAST(body::JSON->'end_price'->>'units' AS BIGINT) AS end_units, TRY_CAST(body::JSON->'end_price'->>'nanos' AS BIGINT) AS end_nanos,
  coalesce(body::JSON->'start_price'->>'currency_code', body::JSON->'end_price'->>'currency_code') AS currency FROM {_PRICED} p""")
def price_range(spark, sf_dir):
    k = F.col("k")
    body = F.when(k < 0, F.col("body")).otherwise(F.replace("body", F.lit("20"), (k % 500).cast("string")))
    r = spread(spark, sf_dir, "id long, body string", PRICES).select(k.alias("id"), E.price_range(F.try_parse_json(body)).alias("p"))
    return r.select("id", *[F.col(f"p.{a}{b.title()}").alias(f"{a}_{b}") for a in ("start", "end") for b in ("units", "nanos")], F.col("p.currencyCode").alias("currency"))


DETAILS = [(1, '{"serves_beer":true,"live_music":false,"business_status":"OPERATIONAL","payment_options":{"accepts_nfc":true},"editorial_summary":{"text":"t"}}'), (2, "{}"), (3, None)]


_DETAILED = f"(SELECT k AS id, CASE WHEN k < 0 THEN body ELSE replace(body, 'OPERATIONAL', 'STATE ' || k % 7) END AS body FROM {spread_sql(DETAILS, 'id', 'body')} x)"


@query(f"SELECT id::BIGINT AS id, (body::JSON->>'serves_beer')::BOOLEAN AS beer, (body::JSON->>'live_music')::BOOLEAN AS music, (body::JSON->>'restroom')::BOOLEAN AS restroom, body::JSON->>'business_status' AS state, (body::JSON->'payment_options'->>'accepts_nfc')::BOOLEAN AS nfc, coalesce(json_exists(body::JSON, '$.parking_options'), false) AS parking, body::JSON->'editorial_summary'->>'text' AS summary FROM {_DETAILED} p")
def atmosphere_fields(spark, sf_dir):
    k = F.col("k")
    body = F.when(k < 0, F.col("body")).otherwise(F.replace("body", F.lit("OPERATIONAL"), F.concat(F.lit("STATE "), k % 7)))
    r = spread(spark, sf_dir, "id long, body string", DETAILS).select(k.alias("id"), E.atmosphere(F.try_parse_json(body)).alias("a"))
    return r.select("id", F.col("a.servesBeer").alias("beer"), F.col("a.liveMusic").alias("music"), F.col("a.restroom").alias("restroom"), F.col("a.businessStatus").alias("state"), F.col("a.paymentOptions.acceptsNfc").alias("nfc"), F.col("a.parkingOptions").isNotNull().alias("parking"), F.col("a.editorialSummary.text").alias("summary"))


@query(f"""SELECT pin_id, 'yelp' AS app, category, cuisine, 'City ' || (k % 9) AS city, 'Land' AS country, CASE WHEN k % 5 = 0 THEN NULL ELSE (k % 5)::DOUBLE END AS rating, CASE WHEN home_lat BETWEEN -90 AND 90 AND home_lng BETWEEN -180 AND 180 THEN floor(2 * 6371 * atan2(sqrt(a), sqrt(1 - a)) * 10 + 0.5) / 10 END AS km
FROM (SELECT n.pin_id, substring(n.pin_id, 2)::BIGINT AS k, {_CATEGORY} AS category, {_CUISINE} AS cuisine, u.home_lat, u.home_lng, pow(sin(radians(u.home_lat - 10.0) / 2), 2) + cos(radians(10.0)) * cos(radians(u.home_lat)) * pow(sin(radians(u.home_lng - 20.0) / 2), 2) AS a
  FROM (SELECT n.*, pl.types_csv AS csv, pl.primary_type AS p FROM <pins> n JOIN <places> pl ON pl.place_id = n.place_id) n LEFT JOIN <users> u ON u.user_id = n.user_id)""")
def pin_projection(spark, sf_dir):
    k = F.substring("pin_id", 2, 20).cast("long")
    p = food_pins(spark, sf_dir).filter("place_name is not null")
    p = p.select("user_id", F.concat(F.lit("https://www.yelp.com/"), "pin_id").alias("url"), "place_id", F.col("place_name").alias("name"), F.concat(F.lit("12 Road, City "), k % 9, F.lit(", Land")).alias("address"), F.lit(10.0).alias("lat"), F.lit(20.0).alias("lng"), "types", "primary_type", "_category", "_cuisine", (k % 5).cast("double").alias("rating"), F.lit(60).alias("utc_offset"))
    r = E.pin_records(p, frame(spark, sf_dir, "users"))
    return r.select(F.substring_index("url", "/", -1).alias("pin_id"), F.col("source_app").alias("app"), "category", "cuisine", "city", "country", "rating", F.col("distance_from_home_km").alias("km"))


TALLY = [
    (1, "p", None, None, None, 0, 0, 0, False, None, False), (2, None, "m", None, None, 0, 0, 0, False, None, False), (3, None, "m", "e", None, 0, 0, 0, False, None, False), (4, None, None, None, "c", 0, 0, 0, False, None, False), (5, None, None, None, None, 0, 2, 0, False, None, False),
    (6, None, None, None, None, 0, 2, 1, False, None, False), (7, None, None, None, None, 0, 2, 1, False, "new", False), (8, None, None, None, None, 1, 3, 1, False, None, False), (9, None, None, None, None, 1, 0, 0, True, None, False), (10, None, None, None, None, 2, 0, 0, False, None, False),
    (11, None, None, None, None, 0, 0, 1, False, "existing", False), (12, None, None, None, None, 0, 0, 1, False, None, False), (13, "p", None, None, None, 0, 0, 0, False, None, True),
]
_TALLY = ("id", "url_pin", "maps_pin", "maps_existing", "content_pin", "n_new", "n_existing", "n_unresolved", "raced", "fallback", "failed")


# a tally of every event: one of those above, with numbers of its own
_TALLIES = f"(SELECT k AS id, * EXCLUDE (k, n_new, n_unresolved), CASE WHEN k < 0 THEN n_new ELSE (n_new + k // 13) % 3 END AS n_new, CASE WHEN k < 0 THEN n_unresolved ELSE (k // 26) % 2 END AS n_unresolved FROM {spread_sql(TALLY, *_TALLY)} x)"


@query(f"""SELECT id::BIGINT AS id, CASE WHEN failed THEN 'failed' WHEN url_pin IS NOT NULL OR maps_existing IS NOT NULL THEN 'duplicate' WHEN maps_pin IS NOT NULL THEN 'complete' WHEN content_pin IS NOT NULL THEN 'duplicate' WHEN n_new > 1 THEN 'needs_selection' WHEN n_new = 1 THEN CASE WHEN raced THEN 'duplicate' ELSE 'complete' END
  WHEN n_existing > 0 AND n_unresolved = 0 THEN 'duplicate' WHEN fallback = 'new' THEN 'complete' WHEN fallback IS NOT NULL OR n_existing > 0 THEN 'duplicate' ELSE 'failed' END AS status FROM {_TALLIES} t""")
def enrich_verdict(spark, sf_dir):
    schema = "id long, url_pin string, maps_pin string, maps_existing string, content_pin string, n_new long, n_existing long, n_unresolved long, raced boolean, fallback string, failed boolean"
    k, every = F.col("k"), spread(spark, sf_dir, schema, TALLY)
    some = every.withColumn("n_new", F.when(k < 0, F.col("n_new")).otherwise((F.col("n_new") + F.floor(k / 13)) % 3)).withColumn("n_unresolved", F.when(k < 0, F.col("n_unresolved")).otherwise(F.floor(k / 26) % 2))
    return E.verdicts(some).select(k.alias("id"), "status")


@query("""WITH c AS (SELECT o_orderkey AS job, concat('U', o_custkey % 150) AS user_id, concat('name ', o_orderkey % 300) AS q FROM orders), h AS (SELECT concat('name ', p_partkey) AS q, concat('PL', p_partkey) AS place_id FROM part WHERE p_partkey % 3 <> 0)
SELECT c.job::BIGINT AS job_id, CASE WHEN h.place_id IS NULL THEN 'unresolved' WHEN e.pin IS NOT NULL THEN 'existing' WHEN d.place_id IS NULL THEN 'unresolved' ELSE 'new' END AS state, h.place_id, e.pin AS existing_pin
FROM c LEFT JOIN h ON h.q = c.q LEFT JOIN (SELECT place_id FROM <places> WHERE types_csv IS NOT NULL) d ON d.place_id = h.place_id LEFT JOIN (SELECT user_id, place_id, min(pin_id) AS pin FROM <pins> GROUP BY 1, 2) e ON e.user_id = c.user_id AND e.place_id = h.place_id""")
def candidate_resolution(spark, sf_dir):
    c = frame(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("job_id"), F.concat(F.lit("U"), F.col("o_custkey") % 150).alias("user_id"), F.lit("name").alias("name"), (F.col("o_orderkey") % 300).cast("string").alias("address"), F.lit("").alias("city"))
    hits = frame(spark, sf_dir, "part").select(F.concat(F.when(F.col("p_partkey") % 3 == 0, "other ").otherwise("name "), "p_partkey").alias("query_key"), F.lit(1).alias("rank"), F.concat(F.lit("PL"), "p_partkey").alias("place_id"))
    return E.resolve(c, hits, frame(spark, sf_dir, "places").filter("types_csv is not null"), frame(spark, sf_dir, "pins")).select("job_id", "state", "place_id", "existing_pin")


ASKED = [(1, "Ippudo "), (2, "Lucali"), (3, "Joe")]
ANSWERS = [(1, "Lucali", "Brooklyn", "high"), (2, "Ippudo", "NYC", "sure"), (3, "Lucali", "Carroll Gardens", "medium")]


# every part's name is asked for; two of three are answered, some twice
_ASKED = f"(SELECT p_partkey AS pos, CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE '' END || p_name || ' ' || p_partkey % 700 AS name FROM part UNION ALL SELECT -pos, name FROM {values(ASKED, 'pos', 'name')} x)"
_ANSWERS = f"(SELECT p_partkey AS pos, p_name || ' ' || p_partkey % 700 AS name, 'Region ' || p_partkey % 11 AS region, CASE p_partkey % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'sure' END AS confidence FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT pos, name, region, confidence FROM {values(ANSWERS, 'pos', 'name', 'region', 'confidence')} x)"


@query(f"""SELECT a.pos::BIGINT AS pos, a.name, b.region, CASE WHEN b.confidence IN ('high', 'medium', 'low') THEN b.confidence ELSE 'low' END AS confidence FROM {_ASKED} a
LEFT JOIN (SELECT trim(name) AS n, arg_max({{'r': region, 'c': confidence}}, pos).r AS region, arg_max({{'r': region, 'c': confidence}}, pos).c AS confidence FROM {_ANSWERS} GROUP BY 1) b ON b.n = trim(a.name)""")
def infer_regions_align(spark, sf_dir):
    k = F.col("p_partkey").cast("long")
    name, parts = F.concat_ws(" ", "p_name", k % 700), frame(spark, sf_dir, "part")
    asked = parts.select(k.alias("pos"), F.concat(F.when(k % 2 == 0, " ").otherwise(""), name).alias("name")).unionAll(rows(spark, "pos long, name string", [(-p, n) for p, n in ASKED]))
    answers = parts.filter(k % 3 != 0).select(k.alias("pos"), name.alias("name"), F.concat(F.lit("Region "), k % 11).alias("region"), F.when(k % 4 == 0, "high").when(k % 4 == 1, "medium").when(k % 4 == 2, "sure").alias("confidence"))
    return lookup.realigned(asked, answers.unionAll(rows(spark, "pos long, name string, region string, confidence string", ANSWERS)))


NAMED = [(1, 1, "Café Ôle", "NYC", "", "text"), (1, 2, "cafe ole!", "", "", "text"), (1, 3, "Bar", "", "x", "text"), (2, 1, "??", "", "", "text")]
SEEN = [(1, 1, "BAR", "Rome"), (1, 2, "Neu", "Bonn")]


@query()
def candidate_merge(spark, sf_dir):
    """The words of every title as names, and for every other post some of them again from its images. No oracle: names are compared without accents by Unicode decomposition; the tests hold known values against it."""
    k, words = F.col("post_id").cast("long"), F.split("title", " ")
    posts = frame(spark, sf_dir, "posts").select(k.alias("job_id"), F.posexplode(words).alias("pos", "name"), F.lit("").alias("city"), F.lit("").alias("address"), F.lit("text").alias("source")).withColumn("pos", F.col("pos").cast("long"))
    seen = frame(spark, sf_dir, "posts").filter(k % 2 == 0).select(k.alias("job_id"), F.posexplode(F.slice(words, 1, 3)).alias("pos", "name"), F.lit("Rome").alias("location")).withColumns({"pos": F.col("pos").cast("long"), "name": F.upper("name")})
    known = rows(spark, "job_id long, pos long, name string, city string, address string, source string", [(-r[0], *r[1:]) for r in NAMED])
    return E.candidates(posts.unionAll(known), seen.unionAll(rows(spark, "job_id long, pos long, name string, location string", [(-r[0], *r[1:]) for r in SEEN])))


KEYS = [(-1, "Ippudo"), (-2, "ab"), (-3, " Joe Pizza"), (-4, "")]
_KEYS = f"(SELECT substring(place_id, 3)::BIGINT AS id, place_name AS name FROM <places> UNION ALL SELECT id, name FROM {values(KEYS, 'id', 'name')})"


@query(f"""SELECT id::BIGINT AS id, trim(lower('places:search:' || name || CASE (id % 3 + 3) % 3 WHEN 0 THEN '#rect:40.50,-73.25-40.75,-73.00' WHEN 1 THEN '@1.5,-2.25' ELSE '' END)) AS search_key, 'places:details:v3:' || id AS details_key, CASE WHEN length(trim(name)) >= 3 THEN trim(name) END AS query,
  'ai:extract:' || left(name, 50) || ':' || repeat('x', 50) AS extract_key, 'ai:places:' || left(name, 50) || ':d::a,b' AS candidates_key, 'ai:vision:v3:' || CASE WHEN id % 2 = 0 THEN 'tiktok:' || id ELSE left('https://i.example/' || name || repeat('y', 60), 60) END AS vision_key FROM {_KEYS} k""")
def lookup_keys(spark, sf_dir):
    r = frame(spark, sf_dir, "places").select(F.substring("place_id", 3, 20).cast("long").alias("id"), F.col("place_name").alias("name")).unionAll(rows(spark, "id long, name string", KEYS))
    n, k = F.col("name"), F.pmod("id", F.lit(3))
    box = tuple(F.lit(x) for x in (40.5, -73.25, 40.75, -73.0))
    search = F.when(k == 0, S.search_key(n, box=box)).when(k == 1, S.search_key(n, F.lit(1.5), F.lit(-2.25))).otherwise(S.search_key(n))
    image = F.concat(F.lit("https://i.example/"), n, F.repeat(F.lit("y"), F.lit(60)))
    content = F.when(F.col("id") % 2 == 0, F.concat(F.lit("tiktok:"), "id"))
    return r.select("id", search.alias("search_key"), S.details_key(F.col("id").cast("string")).alias("details_key"), S.candidate_query(n, F.lit(""), F.lit(None).cast("string")).alias("query"), S.extract_key(n, F.repeat(F.lit("x"), F.lit(60))).alias("extract_key"),
                    S.candidates_key(n, F.lit("d"), F.lit(None).cast("string"), F.array(F.lit("a"), F.lit("b"))).alias("candidates_key"), S.vision_key(content, F.array(image)).alias("vision_key"))


@query("""SELECT post_id::BIGINT AS id, replace(trim(title, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(65279)), '```', '') AS text FROM <posts> UNION ALL SELECT -1, 'a'""")
def fenced_json(spark, sf_dir):
    """Every title inside fences of one kind or the other."""
    p = frame(spark, sf_dir, "posts").select(F.col("post_id").cast("long").alias("id"), F.concat(F.when(F.col("post_id") % 2 == 0, "```json\n").otherwise("```\n"), "title", F.lit("\n```")).alias("x"))
    return p.unionAll(rows(spark, "id long, x string", [(-1, "```json\na\n```")])).select("id", X.without_fences(F.col("x")).alias("text"))
