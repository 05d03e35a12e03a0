"""Fields without a fixed type: arrays, maps or scalars in one column, classified before use."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .text import display_name, hashtags

# fixed values: what an override may set, and the categories it may name
EDITABLE = ("category", "placeName", "formattedAddress")
CATEGORIES = ("food", "accommodation", "attraction", "nature", "shopping", "wellness", "entertainment", "other")


def parsed(text: Column) -> Column:
    return F.try_parse_json(text)


def kind(v: Column) -> Column:
    """array, object, string, number, boolean or null of a variant; 'absent' where it is missing."""
    # one look at the schema: branches would work it out again each
    names = F.create_map(*[F.lit(x) for pair in (("", "absent"), ("VOID", "null"), ("ARRAY", "array"), ("OBJECT", "object"), ("STRING", "string"), ("BOOLEAN", "boolean")) for x in pair])
    return F.coalesce(F.try_element_at(names, F.coalesce(F.substring_index(F.schema_of_variant(v), "<", 1), F.lit(""))), F.lit("number"))


def items(v: Column) -> Column:
    """A variant array's items, null where it is none."""
    return F.try_variant_get(v, "$", "array<variant>")


def text_of(v: Column) -> Column:
    """A variant's string, null where it is none."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def string_list(v: Column, most: int = 5000) -> Column:
    """The strings of an array that can be trusted: not too long, and every item a string with characters; else null."""
    # an array of strings and nulls, or without an item of any kind; contains is null where an item is
    given = F.try_variant_get(v, "$", "array<string>")
    return F.when(~F.array_contains(given, "") & F.schema_of_variant(v).isin("ARRAY<STRING>", "ARRAY<VOID>") & (F.size(given) <= most), given)


def string_array(v: Column, most: int = 5000) -> Column:
    """absent, malformed (no array, too long, or any item not a string with characters) or authoritative."""
    return F.when(v.isNull(), "absent").when(string_list(v, most).isNull(), "malformed").otherwise("authoritative")


def strings(v: Column) -> Column:
    """The strings of an authoritative array, else an empty one."""
    return F.coalesce(string_list(v), F.array().cast("array<string>"))


def list_id(v: Column) -> Column:
    """A variant's list id: a string of 1 to 1500 characters without a slash, else null."""
    t = text_of(v)
    return F.when(F.length(t).between(1, 1500) & ~t.contains("/"), t)


def user_id(v: Column) -> Column:
    t = text_of(v)
    return F.when(F.length(t).between(1, 128), t)


def doc_id(text: Column) -> Column:
    """Whether a text can name a row: 1 to 1500 characters, no slash or control, not ., .. or __x__."""
    return F.coalesce(F.length(text).between(1, 1500) & ~text.contains("/") & ~text.isin(".", "..") & ~text.rlike(r"[\x00-\x1F\x7F]") & ~text.rlike(r"^__.*__$"), F.lit(False))


def profiles(v: Column) -> Column:
    """map<uid, struct<firstName, photo>> of an array of objects with a uid; the last of a uid wins."""
    got = F.filter(F.transform(items(v), lambda x: F.when(kind(x) == "object", F.struct(F.try_variant_get(x, "$.uid", "string").alias("uid"), F.struct(F.coalesce(F.nullif(F.try_variant_get(x, "$.firstName", "string"), F.lit("")), F.lit("User")).alias("firstName"), F.try_variant_get(x, "$.photoURL", "string").alias("photo")).alias("p")))), lambda e: F.coalesce(e["uid"], F.lit("")) != "")
    last = F.filter(got, lambda e, i: ~F.exists(F.slice(got, i + 2, F.size(got)), lambda later: later["uid"] == e["uid"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["uid"], e["p"])))


def profile_outcome(v: Column) -> Column:
    return F.when(kind(v) == "array", "convertedFromArray").when(kind(v) == "object", "alreadyMap").otherwise("resetMalformed")


def fields(v: Column) -> Column:
    """A variant object's fields as map<string, variant>, null where it is none."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def override_value(key: str, v: Column) -> Column:
    """What an override of an editable key stores for a variant: one of the categories, or a name as it is shown; else null."""
    text = text_of(v)
    return F.when(text.isin(*CATEGORIES), text) if key == "category" else display_name(text)


def _others(given: Column) -> Column:
    """A map's keys that aren't editable."""
    return F.array_except(F.map_keys(given), F.array(*map(F.lit, EDITABLE)))


def chosen(*options: tuple[Column, Column]) -> Column:
    """Of (test, edit) the edits whose test holds, as an array; unlike array_compact its parts are compiled."""
    none = F.array().cast("array<struct<key:string,op:string,value:string>>")
    return F.concat(*[F.when(test, F.array(edit)).otherwise(none) for test, edit in options])


def edits(body: Column) -> Column:
    """array<struct<key, op, value>> of a body's overrides, in order of the editable keys, others after them: set, delete (null) or reject.

    A key that isn't editable, a value that can't be stored, and a body that is no object are rejected.
    """
    given = fields(body)
    edit = lambda key, op, value: F.struct(key.alias("key"), op.alias("op"), value.cast("string").alias("value"))

    # a column a key: functions in arrays would look at the same value again for each use
    def one(key: str) -> tuple[Column, Column]:
        v = F.try_element_at(given, F.lit(key))
        value, shape = override_value(key, v), F.schema_of_variant(v)
        # a JSON null may come out of a map as no variant at all
        op = F.when(shape.isNull() | (shape == "VOID"), "delete").when(value.isNotNull(), "set").otherwise("reject")
        return F.map_contains_key(given, F.lit(key)), edit(F.lit(key), op, value)

    rest = F.transform(F.sort_array(_others(given)), lambda k: edit(k, F.lit("reject"), F.lit(None)))
    none = F.array(edit(F.lit(""), F.lit("reject"), F.lit(None)))
    return F.when(given.isNull(), none).otherwise(F.concat(chosen(*map(one, EDITABLE)), rest))


def effective(ops: Column, stored: Column) -> Column:
    """Of edits of editable keys, those that change what is stored (variant): a set to another value, a delete of what is there."""
    given = F.coalesce(fields(stored), F.create_map().cast("map<string,variant>"))

    def one(key: str) -> tuple[Column, Column]:
        o, k = edit_of(ops, key), F.lit(key)
        return ((o["op"] == "set") & ~o["value"].eqNullSafe(text_of(F.try_element_at(given, k)))) | ((o["op"] == "delete") & F.map_contains_key(given, k)), o

    return chosen(*map(one, EDITABLE))


def edit_of(ops: Column, key: str) -> Column:
    """The edit of a key, null where there is none."""
    return F.try_element_at(ops, F.nullif(F.array_position(ops["key"], key), F.lit(0)).cast("int"))


def first_bad_key(stored: Column, ops: Column) -> Column:
    """The first stored key (variant) that no edit touches and that isn't editable or holds what an edit couldn't set; '' if it is there but no object; null if all is fine."""
    return F.when(stored.isNotNull(), F.when(fields(stored).isNull(), F.lit("")).otherwise(F.get(F.sort_array(F.array_except(bad_keys(stored), ops["key"])), F.lit(0))))


def bad_keys(stored: Column) -> Column:
    """All stored keys (variant) that aren't editable or hold what an edit couldn't set; none where nothing is stored, null where it is no object."""
    given = fields(stored)
    none = F.array().cast("array<string>")
    bad = [F.when(F.map_contains_key(given, F.lit(k)) & override_value(k, F.try_element_at(given, F.lit(k))).isNull(), F.array(F.lit(k))).otherwise(none) for k in EDITABLE]
    return F.when(stored.isNull(), none).when(given.isNotNull(), F.concat(*bad, _others(given)))


def place_item(v: Column) -> Column:
    """struct(name, location) of a place that a model names: a string is a name, an object has a name and its location, city or region; null for anything else."""
    t = lambda x: F.trim(F.coalesce(x, F.lit("")))
    get = lambda k: F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit(""))
    named = F.struct(t(text_of(v)).alias("name"), F.lit("").alias("location"))
    return F.when(kind(v) == "string", named).when(kind(v) == "object", F.struct(t(get("name")).alias("name"), t(F.coalesce(get("location"), get("city"), get("region"))).alias("location")))


@pandas_udf(StringType())
def first_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The first balanced object or array in a text, as compact JSON; null if none or if it doesn't parse."""

    def one(text: str) -> str | None:
        m = re.search(r"[{\[]", text)
        if not m:
            return None
        depth, quoted, escaped = 0, False, False
        for i in range(m.start(), len(text)):
            c = text[i]
            if escaped or (quoted and c == "\\"):
                escaped = not escaped
            elif c == '"':
                quoted = not quoted
            elif not quoted:
                depth += (c in "{[") - (c in "}]")
                if not depth:
                    try:
                        return json.dumps(json.loads(text[m.start() : i + 1]), separators=(",", ":"), ensure_ascii=False)
                    except ValueError:
                        return None
        return None

    for s in batches:
        yield s.map(one, na_action="ignore")


def post(payload: Column) -> Column:
    """The extracted-post record of an extractor's JSON output: missing fields from the first entry, description from the title."""
    v = parsed(payload)
    get = lambda p, t="string": F.try_variant_get(v, p, t)
    pick = lambda *names: F.coalesce(*[F.nullif(get(n), F.lit("")) for n in names], F.lit(""))
    both = lambda k: (f"$.{k}", f"$.entries[0].{k}")
    entries = F.coalesce(get("$.entries", "array<variant>"), F.array().cast("array<variant>"))
    thumb = lambda e: F.coalesce(F.try_variant_get(e, "$.thumbnail", "string"), F.try_variant_get(e, "$.thumbnails[0].url", "string"))
    description = pick(*both("description"), *both("title"))
    return F.struct(
        pick(*both("title")).alias("title"), description.alias("description"),
        pick("$.thumbnail", "$.thumbnails[0].url", "$.entries[0].thumbnail", "$.entries[0].thumbnails[0].url").alias("thumbnail_url"),
        pick("$.uploader", "$.channel", "$.creator", "$.entries[0].uploader", "$.entries[0].channel").alias("uploader"), hashtags(description).alias("hashtags"),
        pick("$.webpage_url").alias("webpage_url"), F.coalesce(get("$.location"), get("$.entries[0].location")).alias("location"),
        (F.size(entries) > 1).alias("is_carousel"), F.size(entries).alias("slide_count"),
        F.slice(F.array_compact(F.transform(entries, thumb)), 1, 20).alias("slide_thumbnails"),
    )


def photo_post(payload: Column) -> Column:
    """The record of an embedded photo-post payload, from either of its two places."""
    v = parsed(payload)
    roots = ('$["__DEFAULT_SCOPE__"]["webapp.reflow.video.detail"].itemInfo.itemStruct', '$["__DEFAULT_SCOPE__"]["webapp.video-detail"].itemInfo.itemStruct')
    pick = lambda k, t="string": F.coalesce(*[F.try_variant_get(v, f"{r}.{k}", t) for r in roots])
    images = pick("imagePost.images", "array<variant>")
    links = F.slice(F.filter(F.transform(images, lambda i: F.try_variant_get(i, "$.imageURL.urlList[0]", "string")), lambda u: u.isNotNull()), 1, 20)
    some = lambda *names: F.coalesce(*[F.nullif(pick(n), F.lit("")) for n in names], F.lit(""))
    slides = F.coalesce(links, F.array().cast("array<string>"))
    description = some("desc", "contents[0].desc")
    tags = F.filter(F.transform(F.coalesce(pick("challenges", "array<variant>"), F.array().cast("array<variant>")), lambda c: F.trim(F.lower(F.try_variant_get(c, "$.title", "string")))), lambda t: F.coalesce(t, F.lit("")) != "")
    return F.struct(
        F.coalesce(F.nullif(some("shareMeta.title", "shareInfo.shareTitle"), F.lit("")), F.substring(description, 1, 80)).alias("title"), description.alias("description"),
        F.coalesce(F.nullif(some("imagePost.cover.imageURL.urlList[0]"), F.lit("")), F.get(slides, F.lit(0)), F.lit("")).alias("thumbnail_url"),
        some("author.uniqueId", "author.nickname").alias("uploader"), F.array_distinct(F.concat(tags, hashtags(description))).alias("hashtags"), slides.alias("slide_thumbnails"),
    )
