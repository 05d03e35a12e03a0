"""List membership: migration, orphans, counts, and decisions on removals and overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import variant as V
from ..session import written


def member_entries(pins: DataFrame, lists: DataFrame) -> DataFrame:
    """One row per list reference of a pin, or per pin with a defect: pin_id, list_id, pin_owner_id, added_at, position, outcome.

    Pins: pin_id, owner (variant), list_ids (variant), created_at. Outcomes in order: invalidPinListIds,
    invalidPinOwners, invalidListRefs, staleListRefs, entry. A list that a pin names twice counts once. Pins
    without lists give no row.
    """
    bad = F.col("list_ids").isNotNull() & (V.kind(F.col("list_ids")) != "array")
    some = pins.select("pin_id", "created_at", bad.alias("_bad"), V.items(F.col("list_ids")).alias("_items"), V.user_id(F.col("owner")).alias("_owner")).filter(F.col("_bad") | (F.size("_items") > 0))
    whole = F.when(F.col("_bad"), "invalidPinListIds").when(F.col("_owner").isNull(), "invalidPinOwners")
    some = some.withColumn("_whole", whole).withColumn("_ids", F.when(whole.isNull(), F.transform("_items", V.list_id)))
    # the first place of each list, and every reference that isn't one; a defect stands for the whole pin
    first = F.filter(F.transform("_ids", lambda x, i: F.struct(i.alias("position"), x.alias("list_id"))), lambda x: x["list_id"].isNull() | (F.array_position("_ids", x["list_id"]) == x["position"] + 1))
    refs = some.select("pin_id", "_owner", "created_at", "_whole", F.explode_outer(first).alias("r")).select("pin_id", "_owner", "created_at", "_whole", "r.list_id", F.when(F.col("r.list_id").isNotNull(), F.col("r.position")).alias("position"))
    known = lists.select("list_id").distinct().withColumn("_known", F.lit(True))
    outcome = F.coalesce("_whole", F.when(F.col("list_id").isNull(), "invalidListRefs").when(F.col("_known"), "entry").otherwise("staleListRefs"))
    named = F.col("list_id").isNotNull()
    return refs.join(known, "list_id", "left").select("pin_id", "list_id", F.when(named, F.col("_owner")).alias("pin_owner_id"), F.when(named, F.col("created_at").cast("timestamp")).alias("added_at"), F.col("position").cast("int").alias("position"), outcome.alias("outcome"))


def member_changes(entries: DataFrame, members: DataFrame, values: list[str]) -> DataFrame:
    """Entries against members by (list_id, pin_id): unchanged if all values agree and none is missing, else written."""
    have = members.select("list_id", "pin_id", F.lit(True).alias("_m"), *[F.col(c).alias(f"_{c}") for c in values])
    same = F.coalesce(F.col("_m"), F.lit(False))
    for c in values:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    both = entries.join(have, ["list_id", "pin_id"], "left").withColumn("outcome", F.when(same, "membersUnchanged").otherwise("membersWritten"))
    return both.select(*entries.columns, *(["outcome"] if "outcome" not in entries.columns else []))


def orphans(members: DataFrame, pin_lists: DataFrame, pins: DataFrame, malformed: DataFrame | None = None) -> DataFrame:
    """(list_id, pin_id, orphan, vetoed): members whose pin is gone or doesn't name the list.

    A member whose pin is there with malformed lists (`malformed`: pin_id) vetoes all deletions of its list. One whose
    pin is gone is an orphan even if pin_lists still names it.
    """
    there = pins.select("pin_id").distinct().withColumn("_there", F.lit(True))
    named = pin_lists.select("list_id", "pin_id").distinct().withColumn("_named", F.lit(True))
    out = members.select("list_id", "pin_id").join(named, ["list_id", "pin_id"], "left").join(there, "pin_id", "left")
    bad = F.lit(False)
    if malformed is not None:
        out = out.join(malformed.select("pin_id").distinct().withColumn("_mal", F.lit(True)), "pin_id", "left")
        bad = F.coalesce(F.col("_mal") & F.col("_there"), F.lit(False))
    out = out.withColumn("_bad", bad)
    veto = out.groupBy("list_id").agg(F.bool_or("_bad").alias("vetoed"))
    out = out.join(veto, "list_id").withColumn("orphan", (F.col("_there").isNull() | F.col("_named").isNull()) & ~F.col("_bad"))
    return out.select("list_id", "pin_id", "orphan", "vetoed")


def deletions(found: DataFrame) -> DataFrame:
    return found.filter("orphan and not vetoed").select("list_id", "pin_id")


def reconciled(lists: DataFrame, members: DataFrame) -> DataFrame:
    """(list_id, stored, actual, outcome): a missing count differs from every number; a list without members has 0."""
    n = members.groupBy("list_id").agg(F.count("*").alias("actual"))
    out = lists.select("list_id", F.col("pin_count").cast("long").alias("stored")).join(n, "list_id", "left").withColumn("actual", F.coalesce("actual", F.lit(0)).cast("long"))
    return out.withColumn("outcome", F.when(F.col("stored").eqNullSafe(F.col("actual")), "alreadyCorrect").otherwise("updated"))


def role(caller: Column, owner: Column, collaborators: Column, viewers: Column, editors: Column | None = None, watchers: Column | None = None) -> Column:
    """owner, editor, none, or malformed (role lists that can't be trusted); editors collaborate and don't only view.

    editors and watchers: the strings of both lists (null: absent or malformed) where they are columns already.
    """
    c, v = (V.string_list(x) if read is None else read for x, read in ((collaborators, editors), (viewers, watchers)))
    bad = (collaborators.isNotNull() & c.isNull()) | (viewers.isNotNull() & v.isNull())
    editor = F.array_contains(c, caller) & ~F.coalesce(F.array_contains(v, caller), F.lit(False))
    return F.when(caller == owner, "owner").when(bad, "malformed").when(F.coalesce(editor, F.lit(False)), "editor").otherwise("none")


def ladder(*steps: tuple[Column, str], last: str = "ok") -> Column:
    """The reason of the first step whose test holds; a null test doesn't hold."""
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), reason) for test, reason in steps], F.lit(last))


#: What _looked adds.
_LOOKED = ("_editors", "_watchers", "_ids", "_role")


def _looked(requests: DataFrame) -> DataFrame:
    """Requests with the strings of their lists and the caller's role as columns: each test of a ladder would read the variants again."""
    c = F.col
    out = requests.withColumns({"_editors": V.string_list(c("collaborators")), "_watchers": V.string_list(c("viewers")), "_ids": V.string_list(c("pin_list_ids"))})
    return out.withColumn("_role", role(c("caller"), c("list_owner"), c("collaborators"), c("viewers"), c("_editors"), c("_watchers")))


def _common(member_gone: str) -> list[tuple[Column, str]]:
    """The tests of a request that _looked has been over."""
    c = F.col
    same = F.coalesce((F.coalesce(c("pin_owner"), F.lit("")) != "") & (c("pin_owner") == c("member_owner")), F.lit(False))
    return [
        (~V.doc_id(c("list_id")) | ~V.doc_id(c("pin_id")), "400:bad_id"),
        (c("freeze").isNull(), "409:no_flags"),
        (V.kind(c("freeze")) != "boolean", "409:bad_flag"),
        (F.try_variant_get(c("freeze"), "$", "boolean"), "409:frozen"),
        (c("list_owner").isNull(), "404:no_list"),
        (c("_role") == "malformed", "409:bad_roles"),
        (c("_role") == "none", "403:not_editor"),
        (c("member_pin").isNull(), member_gone),
        (~c("pin_exists"), "409:no_pin"),
        (c("_ids").isNull(), "409:bad_lists"),
        (~F.array_contains("_ids", c("list_id")), "409:not_listed"),
        (c("member_pin") != c("pin_id"), "409:wrong_pin"),
        ((F.coalesce(c("pin_owner"), F.lit("")) == "") | (F.coalesce(c("member_owner"), F.lit("")) == ""), "409:no_owner"),
        (~same, "409:owners_differ"),
    ]


def removals(requests: DataFrame) -> DataFrame:
    """Removal requests with their `decision` (first failing check) and, where ok, the new count and whether an event is due.

    Columns: list_id, pin_id, caller, freeze, list_owner, collaborators, viewers, pin_count, member_pin,
    member_owner, pin_exists, pin_owner, pin_list_ids (freeze, roles and lists as variants).
    """
    steps = [*_common("ok:already_gone"), (F.coalesce(F.col("pin_count"), F.lit(0)) < 1, "409:bad_count")]
    out = _looked(requests).withColumn("decision", ladder(*steps)).drop(*_LOOKED)
    done = F.col("decision") == "ok"
    return out.withColumn("new_count", F.when(done, F.col("pin_count") - 1)).withColumn("event", done & (F.col("pin_owner") != F.col("caller")))


def overrides(requests: DataFrame) -> DataFrame:
    """Override requests with `decision`, the effective `changes`, and whether an event is due.

    As removals, with body (the request's overrides, a variant) and stored (the member's, a variant; null: absent).
    """
    ops = V.edits(F.col("body"))
    out = _looked(requests).withColumn("ops", ops)
    before = (F.size("ops") == 0) | F.array_contains(F.col("ops.op"), "reject")
    bad_id, *rest = _common("404:no_member")
    steps = [bad_id, (before, "400:bad_body"), *rest, (V.first_bad_key(F.col("stored"), F.col("ops")).isNotNull(), "409:bad_stored")]
    out = out.withColumn("decision", ladder(*steps)).withColumn("changes", F.when(F.col("decision") == "ok", V.effective(F.col("ops"), F.col("stored"))))
    out = out.withColumn("decision", F.when((F.col("decision") == "ok") & (F.size("changes") == 0), "ok:unchanged").otherwise(F.col("decision")))
    return out.withColumn("event", (F.col("decision") == "ok") & (F.col("member_owner") != F.col("caller"))).drop("ops", *_LOOKED)


def patched(stored: Column, changes: Column) -> Column:
    """Stored overrides (variant) after changes, as map<string, string>: sets added or replaced, deletes dropped."""
    given = F.coalesce(V.fields(stored), F.create_map().cast("map<string,variant>"))
    kept = F.map_filter(F.transform_values(given, lambda _, v: V.text_of(v)), lambda k, _: ~F.exists(changes, lambda o: o["key"] == k))
    sets = F.map_from_entries(F.transform(F.filter(changes, lambda o: o["op"] == "set"), lambda o: F.struct(o["key"], o["value"])))
    return F.map_concat(kept, sets)


def _event(kind: str, at: Column) -> list[Column]:
    shown = lambda c: X.event_field(F.coalesce(F.col(c), F.lit("")))
    return [F.lit(kind).alias("type"), F.col("member_owner").alias("user_id"), F.col("caller").alias("actor"), "list_id", shown("list_name").alias("list_name"), "pin_id", shown("pin_name").alias("pin_name"), at.alias("created_at")]


def removal_outcomes(requests: DataFrame) -> DataFrame:
    """Removal requests, each a transaction in order of `pos`, with their `decision`, `event`, and `list_count` (null but on the one row that settles a list's count).

    Requests as for removals, with pos, list_name and pin_name. A second removal of a member finds it gone, and a
    list's count runs down by one a removal until none is left (409:bad_count from there on).
    """
    out = removals(requests)
    once = F.row_number().over(Window.partitionBy("list_id", "pin_id").orderBy(F.col("decision") != "ok", "pos"))
    out = out.withColumn("_n", once).withColumn("_d", F.when((F.col("decision") == "ok") & (F.col("_n") > 1), "ok:already_gone").otherwise(F.col("decision")))
    # a column, so that both windows know their rows to lie together
    out = out.withColumn("_ok", F.col("_d") == "ok")
    mine = Window.partitionBy("list_id", "_ok")
    out = out.withColumn("_n", F.row_number().over(mine.orderBy("pos"))).withColumn("_m", F.count("*").over(mine))
    done = (F.col("_d") == "ok") & (F.col("_n") <= F.col("pin_count"))
    settled = F.when(done & (F.col("_n") == F.least("_m", "pin_count")), F.col("pin_count") - F.col("_n"))
    decision = F.when((F.col("_d") == "ok") & ~done, "409:bad_count").otherwise(F.col("_d"))
    return out.withColumn("list_count", settled).withColumn("event", done & (F.col("pin_owner") != F.col("caller"))).withColumn("decision", decision).drop("_n", "_m", "_d", "_ok", "new_count")


def removal_deltas(requests: DataFrame, at: Column) -> dict[str, DataFrame]:
    """What removal requests change: the deltas of each table, and the decisions.

    The outcomes are written once. Deltas: members (keys to delete), lists (list_id, pin_count), pin_lists (keys to
    delete) and events, for those whose pin isn't the caller's own.
    """
    out = written(removal_outcomes(requests).drop("freeze", "collaborators", "viewers", "pin_list_ids"))
    done = out.filter("decision = 'ok'")
    return {
        "decisions": out.drop("event", "list_count"),
        "members": done.select("list_id", "pin_id"),
        "pin_lists": done.select("pin_id", "list_id"),
        "lists": done.filter("list_count is not null").select("list_id", F.col("list_count").alias("pin_count")),
        "events": done.filter("event").select(*_event("list_member_removed_by_editor", at)),
    }


def override_outcomes(requests: DataFrame) -> DataFrame:
    """Override requests, each a transaction in order of `pos`, with `decision`, `changes`, `event`, `overrides` after it and `last` (whether it is the last that changed its member).

    Requests as for overrides, with pos, different for a member's requests; all of them carry what the member stored before
    the first. Each sees what the ones before it stored: a set of a value that is there by then, and a delete of what is
    gone, change nothing. A stored key that can't be trusted refuses all requests until one touches every such key.
    A member's requests are a window in order, spilled and never gathered; each editable key's last edit runs along.
    """
    c = F.col
    out = _looked(requests).withColumn("ops", V.edits(c("body")))
    refused = (F.size("ops") == 0) | F.array_contains(F.col("ops.op"), "reject")
    bad_id, *rest = _common("404:no_member")
    out = out.withColumn("decision", ladder(bad_id, (refused, "400:bad_body"), *rest)).drop(*_LOOKED)
    member = Window.partitionBy("list_id", "pin_id")
    order = member.orderBy("pos")
    covers = F.coalesce(F.size(F.array_except(V.bad_keys(c("stored")), c("ops.key"))) == 0, F.lit(False))
    mended = F.max((c("decision") == "ok") & covers).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("_mended", mended).withColumn("decision", F.when((c("decision") == "ok") & ~c("_mended"), "409:bad_stored").otherwise(c("decision")))
    out = out.withColumns({f"_mine_{k}": F.when(c("decision") == "ok", V.edit_of(c("ops"), k)) for k in V.EDITABLE})
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumns({f"_was_{k}": F.last(f"_mine_{k}", ignorenulls=True).over(before) for k in V.EDITABLE})
    given = F.coalesce(V.fields(c("stored")), F.create_map().cast("map<string,variant>"))

    def change(k: str) -> tuple[Column, Column]:
        o, was = c(f"_mine_{k}"), c(f"_was_{k}")
        there = F.when(was.isNotNull(), was["op"] == "set").otherwise(F.map_contains_key(given, F.lit(k)))
        value = F.when(was.isNotNull(), was["value"]).otherwise(V.text_of(F.try_element_at(given, F.lit(k))))
        return ((o["op"] == "set") & ~o["value"].eqNullSafe(value)) | ((o["op"] == "delete") & there), o

    out = out.withColumn("changes", F.when(c("decision") == "ok", V.chosen(*map(change, V.EDITABLE))))
    out = out.withColumn("decision", F.when((c("decision") == "ok") & (F.size("changes") == 0), "ok:unchanged").otherwise(c("decision")))

    # what an ok request finds stored has editable keys alone: any other key is one that no edit touches
    def held(k: str) -> Column:
        now = F.coalesce(f"_mine_{k}", f"_was_{k}")
        there = F.when(now.isNotNull(), now["op"] == "set").otherwise(F.map_contains_key(given, F.lit(k)))
        value = F.when(now.isNotNull(), now["value"]).otherwise(V.text_of(F.try_element_at(given, F.lit(k))))
        return F.when(there, F.array(F.struct(F.lit(k).alias("key"), value.alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))

    out = out.withColumn("overrides", F.when(c("decision") == "ok", F.map_from_entries(F.concat(*map(held, V.EDITABLE)))))
    out = out.withColumn("last", (c("decision") == "ok") & (c("pos") == F.max(F.when(c("decision") == "ok", c("pos"))).over(member)))
    out = out.withColumn("event", (c("decision") == "ok") & (c("member_owner") != c("caller")))
    return out.drop("ops", "_mended", *[f"_{x}_{k}" for x in ("mine", "was") for k in V.EDITABLE])


def override_deltas(requests: DataFrame, at: Column) -> dict[str, DataFrame]:
    """What override requests change: members (list_id, pin_id, overrides after the last change) and events, with the decisions.

    Requests as for override_outcomes, with list_name and pin_name. The outcomes are written once.
    """
    out = written(override_outcomes(requests).withColumn("stored", F.to_json("stored")).drop("body", "freeze", "collaborators", "viewers", "pin_list_ids"))
    return {
        "decisions": out.drop("event", "overrides", "last"),
        "members": out.filter("last").select("list_id", "pin_id", "overrides"),
        "events": out.filter("event").select(*_event("list_member_overridden_by_editor", at), F.transform("changes", lambda o: o["key"]).alias("changed")),
    }


def outcome_counts(rows: DataFrame, column: str = "outcome") -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def samples(rows: DataFrame, order: str, most: int = 20, column: str = "outcome") -> DataFrame:
    """The first rows of each outcome in order: a report, not a filter."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(column).orderBy(order))).filter(F.col("_n") <= most).drop("_n")
