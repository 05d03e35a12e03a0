"""Queries over provider payloads, and the whole pin record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import places as P
from ..operators.enrich import FLAGS, _camel
from ..session import written
from ..sources.tables import frame, sql
from .places import _CATEGORY, _CUISINE
from .registry import query

_BOOLS = "".join(f""", CASE (k + {i}) % 3 WHEN 0 THEN ',"{_camel(b)}":true' WHEN 1 THEN ',"{_camel(b)}":false' ELSE '' END""" for i, b in enumerate(P.BOOLEANS))
_OPTIONS = "".join(
    f""", CASE WHEN k % {4 + i} = 0 THEN '' ELSE concat(',"{_camel(o)}":{{', {", ".join(f"CASE WHEN (k + {j}) % 2 = 0 THEN '"+ f'"{_camel(n)}":true,' + "' ELSE '' END" for j, n in enumerate(names))}, '"none":0}}') END"""
    for i, (o, names) in enumerate(P.OPTIONS.items())
)
#: A provider's answer for each place, as JSON text; every branch of a missing, empty or zero field occurs.
BODIES = f"""SELECT place_id, k, concat('{{"id":"', place_id, '"', CASE WHEN k % 11 = 0 THEN '' ELSE concat(',"displayName":{{"text":"', place_name, '"}}') END,
  CASE WHEN k % 7 = 0 THEN '' ELSE concat(',"formattedAddress":"', k % 90, ' Road, City ', k % 9, ', AB 12345, Land ', k % 4, '"') END, CASE k % 3 WHEN 0 THEN ',"shortFormattedAddress":""' WHEN 1 THEN ',"shortFormattedAddress":"Road"' ELSE '' END,
  CASE WHEN k % 5 = 0 THEN concat(',"addressComponents":[{{"longText":"Land","shortText":"LA","types":["country"]}},{{"longText":"Area","types":["administrative_area_level_1"]}},{{"shortText":"T","longText":"Town ', k % 6, '","types":["locality","political"]}}]') ELSE '' END,
  CASE WHEN k % 13 = 0 THEN '' ELSE concat(',"location":{{"latitude":', k % 80, '.5,"longitude":', k % 170, '.25}}') END, CASE WHEN types_csv IS NULL THEN '' ELSE concat(',"types":["', replace(types_csv, ',', '","'), '"]') END,
  CASE WHEN primary_type IS NULL THEN '' ELSE concat(',"primaryType":"', primary_type, '"') END, ',"rating":', k % 6, ',"userRatingCount":', k % 200, CASE WHEN k % 4 = 0 THEN '' ELSE ',"priceLevel":"PRICE_LEVEL_MODERATE"' END,
  CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN ',"priceRange":{{}}' WHEN 2 THEN concat(',"priceRange":{{"startPrice":{{"units":"', k % 50, '","nanos":500000000,"currencyCode":"EUR"}}}}') WHEN 3 THEN ',"priceRange":{{"startPrice":{{"units":"x"}},"endPrice":{{"units":40,"currencyCode":"USD"}}}}' ELSE ',"priceRange":{{"startPrice":{{"units":"5","currencyCode":"GBP"}},"endPrice":{{"units":"9","nanos":1,"currencyCode":"GBP"}}}}' END,
  CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN ',"websiteUri":""' ELSE concat(',"websiteUri":"https://p.example/', k, '"') END, CASE WHEN k % 2 = 0 THEN '' ELSE concat(',"nationalPhoneNumber":"555-', k, '"') END{_BOOLS}{_OPTIONS},
  CASE k % 4 WHEN 0 THEN ',"businessStatus":"OPERATIONAL"' WHEN 1 THEN ',"businessStatus":""' ELSE '' END, CASE k % 4 WHEN 0 THEN ',"editorialSummary":{{"text":"Fine","languageCode":"en"}}' WHEN 1 THEN ',"editorialSummary":{{"text":""}}' ELSE '' END,
  CASE k % 3 WHEN 0 THEN ',"viewport":{{"low":{{"latitude":1.5,"longitude":2.5}},"high":{{"latitude":3.5,"longitude":4.5}}}}' WHEN 1 THEN ',"viewport":{{"low":{{"latitude":1.5}}}}' ELSE '' END,
  CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN ',"regularOpeningHours":{{"weekdayDescriptions":["Mon","Tue"]}}' WHEN 2 THEN ',"regularOpeningHours":{{"periods":[{{"open":{{"day":1,"hour":9}},"close":{{"day":1,"hour":17,"minute":30}}}},{{"open":{{"day":2}}}}]}}' ELSE ',"regularOpeningHours":{{"periods":[],"weekdayDescriptions":[]}}' END,
  CASE k % 4 WHEN 0 THEN ',"currentOpeningHours":{{"periods":[{{"open":{{"day":3,"hour":8,"date":{{"year":2024,"month":1,"day":17}}}}}},{{"close":{{"day":4}}}}]}}' WHEN 1 THEN ',"currentOpeningHours":{{"weekdayDescriptions":["Wed"]}}' ELSE '' END,
  CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN ',"utcOffsetMinutes":-300' ELSE ',"utcOffsetMinutes":0' END, '}}') AS body FROM (SELECT *, CAST(substring(place_id, 3) AS BIGINT) AS k FROM <places>) p"""


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, BODIES)


def _get(path: str, kind: str = "") -> str:
    return f"(j ->> '$.{path}'){f'::{kind}' if kind else ''}"


def _each(path: str, f: str) -> str:
    """The items x of a JSON array, shown by f and joined; NULL where it is none."""
    return f"CASE WHEN json_type(j, '$.{path}') = 'ARRAY' THEN array_to_string(list_transform(json_extract(j, '$.{path}[*]'), lambda x: {f}), ';') END"


def _when_sent(path: str, *parts: str) -> str:
    return f"CASE WHEN json_type(j, '$.{path}') IS NOT NULL THEN " + " || '|' || ".join(f"coalesce({p}, '-')" for p in parts) + " END"


def _moment(x: str, date: bool = False) -> str:
    parts = [f"coalesce({x} ->> '$.{k}', '0')" for k in ("day", "hour", "minute")]
    dated = [f"coalesce(({x} ->> '$.date.year') || '-' || ({x} ->> '$.date.month') || '-' || ({x} ->> '$.date.day'), '')"] if date else []
    return " || ':' || ".join(parts + dated)


_OPEN, _CLOSE = "(x -> '$.open')", "(x -> '$.close')"
_SHOWN = {
    "name": f"coalesce({_get('displayName.text')}, '')", "formatted_address": f"coalesce({_get('formattedAddress')}, '')", "short_formatted_address": f"nullif({_get('shortFormattedAddress')}, '')",
    "address_components": _each("addressComponents", "coalesce(x ->> '$.longText', '') || ',' || coalesce(x ->> '$.shortText', '') || ',' || coalesce(array_to_string(CAST(x -> '$.types' AS VARCHAR[]), '+'), '')"),
    "lat": f"coalesce({_get('location.latitude', 'DOUBLE')}, 0)", "lng": f"coalesce({_get('location.longitude', 'DOUBLE')}, 0)", "types": "coalesce(array_to_string(CAST(j -> '$.types' AS VARCHAR[]), ','), '')", "primary_type": f"nullif({_get('primaryType')}, '')",
    "rating": f"nullif({_get('rating', 'DOUBLE')}, 0)", "user_ratings_total": f"nullif({_get('userRatingCount', 'BIGINT')}, 0)", "price_level": f"nullif({_get('priceLevel')}, '')",
    "price_range": _when_sent("priceRange", *[_get(f"priceRange.{s}.{u}") for s in ("startPrice", "endPrice") for u in ("units", "nanos", "currencyCode")]),
    "website": f"nullif({_get('websiteUri')}, '')", "formatted_phone_number": f"nullif({_get('nationalPhoneNumber')}, '')", "business_status": f"nullif({_get('businessStatus')}, '')",
    "editorial_summary": _when_sent("editorialSummary", f"nullif({_get('editorialSummary.text')}, '')", f"nullif({_get('editorialSummary.languageCode')}, '')"),
    "viewport": _when_sent("viewport", *[_get(f"viewport.{c}.{x}") for c in ("low", "high") for x in ("latitude", "longitude")]),
    "opening_periods": _each("regularOpeningHours.periods", f"{_moment(_OPEN)} || '-' || {_moment(_CLOSE)}"),
    "weekday_descriptions": _each("regularOpeningHours.weekdayDescriptions", "x ->> '$'"),
    "current_opening_periods": _each("currentOpeningHours.periods", " || '-' || ".join(f"CASE WHEN json_type(x, '$.{e}') IS NULL THEN '' ELSE {_moment(x, True)} END" for e, x in (("open", _OPEN), ("close", _CLOSE)))),
    "current_weekday_descriptions": _each("currentOpeningHours.weekdayDescriptions", "x ->> '$'"), "utc_offset_minutes": _get("utcOffsetMinutes", "BIGINT"),
} | {b: _get(_camel(b), "BOOLEAN") for b in P.BOOLEANS} | {o: _when_sent(_camel(o), *[_get(f"{_camel(o)}.{_camel(n)}") for n in names]) for o, names in P.OPTIONS.items()}


def shown(d: Column) -> dict[str, Column]:
    """A details struct's fields, the nested ones as text."""
    text = lambda *parts: F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts])
    given = lambda c, *parts: F.when(c.isNotNull(), text(*parts))
    moment = lambda t: F.concat_ws(":", t["day"], t["hour"], t["minute"])
    dated = lambda t: F.when(t.isNotNull(), F.concat_ws(":", moment(t), F.coalesce(F.concat_ws("-", t["date"]["year"], t["date"]["month"], t["date"]["day"]), F.lit("")))).otherwise("")
    price, view, says = d["price_range"], d["viewport"], d["editorial_summary"]
    out = {n: d[n] for n in ("name", "formatted_address", "short_formatted_address", "lat", "lng", "primary_type", "rating", "user_ratings_total", "price_level", "website", "formatted_phone_number", "business_status", *P.BOOLEANS)}
    out["address_components"] = F.array_join(F.transform(d["address_components"], lambda c: F.concat_ws(",", c["long_name"], c["short_name"], F.array_join(c["types"], "+"))), ";")
    out["types"] = F.array_join(d["types"], ",")
    out["price_range"] = given(price, *[price[s][u] for s in ("start_price", "end_price") for u in ("units", "nanos", "currency_code")])
    out["editorial_summary"] = given(says, says["text"], says["language_code"])
    out["viewport"] = given(view, *[view[c][x] for c in ("low", "high") for x in ("latitude", "longitude")])
    out["opening_periods"] = F.array_join(F.transform(d["opening_periods"], lambda p: F.concat_ws("-", moment(p["open"]), moment(p["close"]))), ";")
    out["current_opening_periods"] = F.array_join(F.transform(d["current_opening_periods"], lambda p: F.concat_ws("-", dated(p["open"]), dated(p["close"]))), ";")
    for n in ("weekday_descriptions", "current_weekday_descriptions"):
        out[n] = F.array_join(d[n], ";")
    out["utc_offset_minutes"] = d["utc_offset_minutes"].cast("long")
    return out | {o: given(d[o], *[d[o][n] for n in names]) for o, names in P.OPTIONS.items()}


@query(f"SELECT place_id, {', '.join(f'{v} AS {k}' for k, v in _SHOWN.items())} FROM (SELECT place_id, body::JSON AS j FROM ({BODIES}) b) t")
def details_payload(spark, sf_dir):
    d = bodies(spark, sf_dir).select("place_id", P.details_payload(F.col("body")).alias("d"))
    return d.select("place_id", *[c.alias(n) for n, c in shown(F.col("d")).items()])


_HIT = ("name", "formatted_address", "lat", "lng", "types")


@query(f"SELECT j ->> '$.id' AS place_id, {', '.join(f'{_SHOWN[n]} AS {n}' for n in _HIT)}, {_get('rating', 'DOUBLE')} AS rating, {_get('userRatingCount', 'BIGINT')} AS user_ratings_total FROM (SELECT body::JSON AS j FROM ({BODIES}) b) t")
def search_hits_mapped(spark, sf_dir):
    h = bodies(spark, sf_dir).select(P.search_hit(F.col("body")).alias("h"))
    return h.select("h.place_id", "h.name", "h.formatted_address", "h.lat", "h.lng", F.array_join("h.types", ",").alias("types"), "h.rating", "h.user_ratings_total")


_NULLABLE = ("short_formatted_address", "primary_type", "rating", "user_ratings_total", "price_level", "website", "business_status", "editorial_summary", "viewport", "opening_periods", "weekday_descriptions", "utc_offset_minutes", *P.BOOLEANS, *P.OPTIONS)
_UNITS = ", ".join(f"TRY_CAST({_get(f'priceRange.{s}Price.{u}')} AS DOUBLE) AS {s}_{u}" for s in ("start", "end") for u in ("units", "nanos"))
_CODE = f"coalesce({_get('priceRange.startPrice.currencyCode')}, {_get('priceRange.endPrice.currencyCode')})"


@query(f"""WITH d AS (SELECT place_id, k, body::JSON AS j FROM ({BODIES}) b),
n AS (SELECT place_id, k, {', '.join(f'{_SHOWN[c]} AS {c}' for c in (*_NULLABLE, 'name', 'formatted_address', 'lat', 'lng', 'types', 'formatted_phone_number'))}, {_UNITS}, {_CODE} AS price_currency, {_CATEGORY.replace('csv', "coalesce(array_to_string(CAST(j -> '$.types' AS VARCHAR[]), ','), '')").replace('coalesce(p,', "coalesce(j ->> '$.primaryType',")} AS category, {_CUISINE.replace('csv', "coalesce(array_to_string(CAST(j -> '$.types' AS VARCHAR[]), ','), '')").replace('coalesce(p,', "coalesce(j ->> '$.primaryType',")} AS cuisine,
  json_type(j, '$.addressComponents') IS NOT NULL AS parted FROM d WHERE k % 6 <> 5),
h AS (SELECT place_id, k, {', '.join(f'{_SHOWN[c]} AS {c}' for c in _HIT)}, {_CATEGORY.replace('csv', "coalesce(array_to_string(CAST(j -> '$.types' AS VARCHAR[]), ','), '')").replace('coalesce(p,', "coalesce(NULL::VARCHAR,")} AS category, {_CUISINE.replace('csv', "coalesce(array_to_string(CAST(j -> '$.types' AS VARCHAR[]), ','), '')").replace('coalesce(p,', "coalesce(NULL::VARCHAR,")} AS cuisine, nullif({_get('rating', 'DOUBLE')}, 0) AS rating, nullif({_get('userRatingCount', 'BIGINT')}, 0) AS user_ratings_total FROM d),
r AS (SELECT p.pin_id, p.user_id, h.place_id, coalesce(nullif(n.name, ''), nullif(h.name, ''), '') AS place_name, coalesce(nullif(n.formatted_address, ''), nullif(h.formatted_address, ''), '') AS addr, coalesce(n.lat, h.lat) AS latitude, coalesce(n.lng, h.lng) AS longitude,
  CASE WHEN n.k IS NULL THEN h.category ELSE n.category END AS category, CASE WHEN n.k IS NULL THEN h.cuisine ELSE n.cuisine END AS cuisine, nullif(coalesce(n.types, h.types), '') AS types, coalesce(n.parted, false) AS parted, h.k AS hk,
  coalesce(n.rating, h.rating) AS rating, coalesce(n.user_ratings_total, h.user_ratings_total) AS user_ratings_total, {', '.join(f'n.{c}' for c in (*_NULLABLE, 'start_units', 'start_nanos', 'end_units', 'end_nanos', 'price_currency') if c not in ('rating', 'user_ratings_total'))}, n.formatted_phone_number AS phone_number, u.home_lat, u.home_lng
  FROM <pins> p JOIN h ON h.place_id = p.place_id LEFT JOIN n ON n.place_id = p.place_id LEFT JOIN <users> u ON u.user_id = p.user_id),
w AS (SELECT *, CASE WHEN parted THEN 'Town ' || (hk % 6) WHEN addr <> '' THEN 'City ' || (hk % 9) END AS city, CASE WHEN parted THEN 'Area' WHEN addr <> '' THEN 'AB' END AS region, CASE WHEN parted THEN 'Land' WHEN addr <> '' THEN 'Land ' || (hk % 4) END AS country,
  pow(sin(radians(latitude - home_lat) / 2), 2) + cos(radians(home_lat)) * cos(radians(latitude)) * pow(sin(radians(longitude - home_lng) / 2), 2) AS a FROM r)
SELECT * EXCLUDE (user_id, addr, hk, parted, home_lat, home_lng, a, place_id), place_id, addr AS formatted_address, lower(user_id) || '_' || replace(lower(city), ' ', '_') || '_' || replace(lower(country), ' ', '_') AS trip_signal_id,
  CASE WHEN city IS NOT NULL THEN CASE WHEN city LIKE '%1%' THEN 'traveling' ELSE 'planning' END END AS trip_status, CASE WHEN home_lat BETWEEN -90 AND 90 AND home_lng BETWEEN -180 AND 180 THEN floor(2 * 6371 * atan2(sqrt(a), sqrt(1 - a)) * 10 + 0.5) / 10 END AS km, 'enrichment' AS save_origin, 90::BIGINT AS confidence FROM w""")
def whole_pin_record(spark, sf_dir):
    """The record that every pin would be written with, from its place's payloads; a sixth of the places have no details."""
    b = bodies(spark, sf_dir)
    pins = frame(spark, sf_dir, "pins").withColumnRenamed("place_id", "place_key")
    # payloads are read once, for the places that pins name
    b = b.select(F.col("place_id").alias("place_key"), "k", "body").join(pins.select("place_key").distinct(), "place_key", "left_semi")
    b = b.select("place_key", P.search_hit(F.col("body")).alias("hit"), F.when(F.col("k") % 6 != 5, P.details_payload(F.col("body"))).alias("details"))
    places = written(P.with_facts(b))
    og = F.struct(F.col("pin_id").alias("title"), F.lit("").alias("description"), F.lit("").alias("image"))
    pins = pins.select("user_id", "place_key", "url", og.alias("og"), F.lit(90).alias("confidence"), F.lit("enrichment").alias("reason"))
    signals = trip_statuses(pins.select("user_id", "place_key").distinct().join(places, "place_key"))
    r = P.whole_pins(pins, signals, frame(spark, sf_dir, "users"), places)
    view, says = F.col("viewport"), F.col("editorial_summary")
    given = lambda c, *parts: F.when(c.isNotNull(), F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    moment = lambda t: F.concat_ws(":", t["day"], t["hour"], t["minute"])
    out = {c: F.col(c) for c in ("place_id", "place_name", "formatted_address", "latitude", "longitude", "category", "cuisine", "rating", "user_ratings_total", "price_level", "short_formatted_address", "primary_type", "website", "phone_number", "business_status", "country", "region", "city", "save_origin", *P.SERVICES, *FLAGS.values())}
    out |= {"pin_id": F.col("og_title"), "types": F.array_join("types", ","), "editorial_summary": given(says, says["text"], says["languageCode"]), "viewport": given(view, *[view[c][x] for c in ("low", "high") for x in ("latitude", "longitude")])}
    out |= {o: given(F.col(_camel(o)), *[F.col(_camel(o))[_camel(n)] for n in names]) for o, names in P.OPTIONS.items()}
    out |= {f"{s}_{u}": F.col("price_range")[f"{s}{u.title()}"] for s in ("start", "end") for u in ("units", "nanos")} | {"price_currency": F.col("price_range")["currencyCode"]}
    out |= {"opening_periods": F.array_join(F.transform("opening_periods", lambda p: F.concat_ws("-", moment(p["open"]), moment(p["close"]))), ";"), "weekday_descriptions": F.array_join("weekday_descriptions", ";"), "utc_offset_minutes": F.col("utc_offset_minutes").cast("long")}
    out |= {"trip_signal_id": F.col("trip_signal_id_at_save"), "trip_status": F.col("saved_at_trip_status"), "km": F.col("distance_from_home_city_km"), "confidence": F.col("confidence_score").cast("long")}
    return r.select(*[c.alias(n) for n, c in out.items()])


def trip_statuses(pins: DataFrame) -> DataFrame:
    """Stored trip signals of the cities with a 1 in their name, of pins with their places' facts."""
    from ..functions import state as S

    there = pins.select("user_id", "_where.city", "_where.country").filter(F.col("city").contains("1")).distinct()
    return there.select(S.signal_id(F.col("user_id"), F.col("city"), F.col("country")).alias("signal_id"), F.lit("traveling").alias("status"))
