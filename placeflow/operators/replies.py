"""What models and services answered: replies read to candidates, and faulty payloads that fail their own job alone."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import state as S
from ..functions import text as X
from ..functions import variant as V

MOST = 500  # characters of a message that a job keeps
#: What each field of a details payload must be, where it is there.
DETAILS = {"types": "array", "address_components": "array", "geometry": "object", "regular_opening_hours": "object", "name": "string", "rating": "number"}


def reply_places(replies: DataFrame) -> DataFrame:
    """(job_id, pos, name, location, siblings) of the places that models named in their replies (job_id, reply).

    A reply may stand in fences or prose; its first JSON object with a list of places counts. A place is a string or an object with a
    name; others are dropped and keep their number. siblings are the different names of the job's other places, the reply's
    own first. A reply that can't be read names none, as does a null one.
    """
    read = replies.filter("reply is not null").select("job_id", V.first_json(X.without_fences(F.col("reply"))).alias("json"))
    v = V.parsed(F.col("json"))
    places = F.when(V.kind(v) == "object", V.items(F.try_variant_get(v, "$.places", "variant")))
    named = F.transform(places, lambda p, i: F.struct((i + 1).cast("long").alias("pos"), V.place_item(p).alias("p")))
    found = read.select("job_id", F.filter(named, lambda x: F.coalesce(x["p"]["name"], F.lit("")) != "").alias("all"))
    each = found.select("job_id", "all", F.explode("all").alias("x"))
    others = lambda x: F.transform(F.filter("all", lambda o: o["pos"] != x["pos"]), lambda o: o["p"]["name"])
    siblings = S.context_names(others(F.col("x")), F.array().cast("array<string>"))
    return each.select("job_id", "x.pos", F.col("x.p.name").alias("name"), F.col("x.p.location").alias("location"), siblings.alias("siblings"))


def _kinds(v: Column, fields: Iterable[str]) -> Column:
    """The kinds of a variant and of its fields, in that order: one array, so that the variant is read once for all of them."""
    return F.array(V.kind(v), *[V.kind(F.try_variant_get(v, f"$['{f}']", "variant")) for f in fields])


def _message(payload: Column, found: Column, kinds: dict[str, str], what: str) -> Column:
    """What is wrong with a payload of the kinds found."""
    is_ = found[0]
    bad = [F.when(~found[i].isin("absent", "null", k), F.concat(F.lit(f"{what}.{f} is "), found[i], F.lit(f", not {k}"))) for i, (f, k) in enumerate(kinds.items(), 1)]
    why = F.when(is_ == "absent", F.concat(F.lit(f"{what} is not JSON: "), payload)).when(is_ != "object", F.concat(F.lit(f"{what} is "), is_, F.lit(", not object"))).otherwise(F.coalesce(*bad))
    return F.when(payload.isNotNull(), F.substring(why, 1, MOST))


def fault(payload: Column, kinds: dict[str, str] | None = None, what: str = "details") -> Column:
    """Why a payload (JSON text) can't be used: it isn't JSON, no object, or a field is of the wrong kind; null if it can, and for no payload."""
    kinds = kinds or DETAILS
    return _message(payload, _kinds(V.parsed(payload), kinds), kinds, what)


def fail_faulty(verdicts: DataFrame, payloads: DataFrame) -> DataFrame:
    """Verdicts (job_id, status, place_id, ...) with `error`: a new pin's job whose place has a faulty payload (place_id, body) fails with its message, and has no place.

    Only those jobs fail. A place with several payloads fails if any is faulty, with the least message. Payloads of places
    that no new pin names are not looked into. Jobs that can't fail have a key of their own in the join, which spreads them.
    """
    new = (F.col("status") == "complete") & F.col("place_id").isNotNull()
    asked = verdicts.filter(new).select(F.col("place_id").alias("_place")).distinct()
    given = payloads.select(F.col("place_id").alias("_place"), F.col("body").alias("_body")).join(asked, "_place", "left_semi")
    # the kinds as a column: a message looks at them several times
    read = given.withColumn("_kinds", _kinds(V.parsed(F.col("_body")), DETAILS))
    why = _message(F.col("_body"), F.col("_kinds"), DETAILS, "details")
    # a test of the message itself would be made before the join, over every payload
    bad = read.groupBy("_place").agg(F.min(why).alias("_error")).filter("_error is not null")
    keyed = verdicts.withColumn("_at", F.when(new, F.col("place_id")).otherwise(F.concat(F.lit("\0"), F.col("job_id").cast("string"))))
    out = keyed.join(bad, (F.col("_at") == F.col("_place")) & new, "left")
    hit = F.col("_error").isNotNull()
    return out.withColumn("status", F.when(hit, "failed").otherwise(F.col("status"))).withColumn("place_id", F.when(~hit, F.col("place_id"))).withColumnRenamed("_error", "error").drop("_place", "_at")
