"""Queries over list membership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import variant as V
from ..operators import members as M
from ..sources import snapshots
from ..sources.tables import frame
from .registry import query, rows, spread, spread_sql, values


def typed_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pins with an array of their lists as a variant; every 97th key has a string, every 89th no owner."""
    refs = frame(spark, sf_dir, "pin_lists").groupBy("pin_id").agg(F.to_variant_object(F.array_sort(F.collect_list("list_id"))).alias("lists"))
    k = F.substring("pin_id", 2, 20).cast("long")
    pins = frame(spark, sf_dir, "pins").join(refs, "pin_id")
    ids = F.when(k % 97 == 0, F.parse_json(F.lit('"L1"'))).when(k % 83 == 0, F.parse_json(F.lit('["L1","","has/slash",null,42]'))).otherwise(F.col("lists"))
    return pins.select("pin_id", F.when(k % 89 != 0, F.to_variant_object(F.array("user_id"))).alias("o"), ids.alias("list_ids"), "created_at").withColumn("owner", F.try_variant_get(F.col("o"), "$[0]", "variant")).drop("o")


_TYPED = """(SELECT pin_id, substring(pin_id, 2)::BIGINT AS k, user_id FROM <pins> WHERE pin_id IN (SELECT pin_id FROM <pin_lists>))"""
_ENTRIES = f"""(SELECT t.pin_id, NULL::VARCHAR AS list_id, 'invalidPinListIds' AS outcome FROM {_TYPED} t WHERE k % 97 = 0
  UNION ALL SELECT pin_id, NULL, 'invalidPinOwners' FROM {_TYPED} t WHERE k % 97 <> 0 AND k % 89 = 0
  UNION ALL SELECT t.pin_id, x.list_id, CASE WHEN x.list_id = 'L1' AND EXISTS (SELECT 1 FROM <lists> l WHERE l.list_id = 'L1') THEN 'entry' WHEN x.list_id = 'L1' THEN 'staleListRefs' ELSE 'invalidListRefs' END FROM {_TYPED} t, (VALUES ('L1'), (NULL), (NULL), (NULL), (NULL)) x(list_id) WHERE k % 97 <> 0 AND k % 89 <> 0 AND k % 83 = 0
  UNION ALL SELECT t.pin_id, p.list_id, CASE WHEN l.list_id IS NULL THEN 'staleListRefs' ELSE 'entry' END FROM {_TYPED} t JOIN <pin_lists> p ON p.pin_id = t.pin_id LEFT JOIN <lists> l ON l.list_id = p.list_id WHERE k % 97 <> 0 AND k % 89 <> 0 AND k % 83 <> 0)"""


@query(f"SELECT * FROM {_ENTRIES}")
def members_explode(spark, sf_dir):
    return M.member_entries(typed_pins(spark, sf_dir), frame(spark, sf_dir, "lists")).select("pin_id", "list_id", "outcome")


@query(f"SELECT outcome, count(*)::BIGINT AS n, (SELECT count(*) = 0 FROM {_ENTRIES} WHERE outcome <> 'entry') AS ok FROM {_ENTRIES} GROUP BY outcome")
def members_report(spark, sf_dir):
    counts = M.outcome_counts(M.member_entries(typed_pins(spark, sf_dir), frame(spark, sf_dir, "lists")))
    ok = counts.agg((F.count_if(F.col("outcome") != "entry") == 0).alias("ok"))
    return counts.withColumn("_k", F.lit(0)).join(F.broadcast(ok.withColumn("_k", F.lit(0))), "_k").drop("_k")


@query("SELECT p.pin_id, p.list_id FROM <pin_lists> p WHERE p.list_id NOT IN (SELECT list_id FROM <lists>)")
def members_stale(spark, sf_dir):
    return frame(spark, sf_dir, "pin_lists").join(frame(spark, sf_dir, "lists"), "list_id", "left_anti").select("pin_id", "list_id")


@query("SELECT p.pin_id, p.list_id FROM <pin_lists> p WHERE p.list_id IN (SELECT list_id FROM <lists>)")
def members_live(spark, sf_dir):
    return frame(spark, sf_dir, "pin_lists").join(frame(spark, sf_dir, "lists"), "list_id", "left_semi").select("pin_id", "list_id")


@query("""SELECT e.list_id, e.pin_id, CASE WHEN m.pin_owner_id IS NOT DISTINCT FROM e.pin_owner_id AND m.pin_id IS NOT NULL THEN 'membersUnchanged' ELSE 'membersWritten' END AS outcome
FROM (SELECT p.list_id, p.pin_id, pins.user_id AS pin_owner_id FROM <pin_lists> p JOIN <pins> pins ON pins.pin_id = p.pin_id) e LEFT JOIN <members> m ON m.list_id = e.list_id AND m.pin_id = e.pin_id""")
def members_diff(spark, sf_dir):
    owners = frame(spark, sf_dir, "pins").select("pin_id", F.col("user_id").alias("pin_owner_id"))
    entries = frame(spark, sf_dir, "pin_lists").join(owners, "pin_id").select("list_id", "pin_id", "pin_owner_id")
    return M.member_changes(entries, frame(spark, sf_dir, "members"), ["pin_owner_id"]).select("list_id", "pin_id", "outcome")


# every 41st pin is taken out, though its lists still name it
_ORPHANS = """(SELECT m.list_id, m.pin_id, (p.pin_id IS NULL OR q.pin_id IS NULL) AND NOT b.bad AS orphan, bool_or(b.bad) OVER (PARTITION BY m.list_id) AS vetoed FROM <members> m LEFT JOIN <pin_lists> p ON p.list_id = m.list_id AND p.pin_id = m.pin_id
  LEFT JOIN (SELECT pin_id FROM <pins> WHERE substring(pin_id, 2)::BIGINT % 41 <> 5) q ON q.pin_id = m.pin_id
  JOIN (SELECT list_id, pin_id, coalesce(TRY_CAST(substring(pin_id, 2) AS BIGINT) % 997 = 0 AND TRY_CAST(substring(pin_id, 2) AS BIGINT) % 41 <> 5, false) AS bad FROM <members>) b ON b.list_id = m.list_id AND b.pin_id = m.pin_id)"""


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.substring("pin_id", 2, 20).cast("long")
    pins = frame(spark, sf_dir, "pins").withColumn("pin_id", F.when(k % 41 == 5, F.concat(F.lit("GONE"), "pin_id")).otherwise(F.col("pin_id")))
    bad = frame(spark, sf_dir, "pins").filter(k % 997 == 0).select("pin_id")
    return M.orphans(frame(spark, sf_dir, "members"), frame(spark, sf_dir, "pin_lists"), pins, bad)


@query(f"SELECT * FROM {_ORPHANS}")
def orphan_members(spark, sf_dir):
    return _orphans(spark, sf_dir)


@query(f"SELECT list_id, pin_id FROM {_ORPHANS} WHERE orphan AND NOT vetoed")
def orphan_veto(spark, sf_dir):
    return M.deletions(_orphans(spark, sf_dir))


@query("""SELECT l.list_id, l.pin_count::BIGINT AS stored, coalesce(m.n, 0)::BIGINT AS actual, CASE WHEN l.pin_count IS NOT DISTINCT FROM coalesce(m.n, 0) THEN 'alreadyCorrect' ELSE 'updated' END AS outcome
FROM <lists> l LEFT JOIN (SELECT list_id, count(*) AS n FROM <members> GROUP BY list_id) m ON m.list_id = l.list_id""")
def pincount_reconcile(spark, sf_dir):
    return M.reconciled(frame(spark, sf_dir, "lists"), frame(spark, sf_dir, "members"))


@query("""SELECT l.list_id, l.owner_id, l.name, coalesce(p.n, l.pin_count)::BIGINT AS pin_count FROM <lists> l LEFT JOIN (SELECT list_id, count(*) AS n FROM <members> GROUP BY list_id) p ON p.list_id = l.list_id""")
def merge_upsert(spark, sf_dir):
    patch = frame(spark, sf_dir, "members").groupBy("list_id").agg(F.count("*").alias("pin_count"))
    lists = frame(spark, sf_dir, "lists").withColumn("pin_count", F.col("pin_count").cast("long"))
    known = patch.join(lists.select("list_id"), "list_id", "left_semi")
    return snapshots.merge(lists, known, "list_id")


VARIANTS = [(1, None), (2, "null"), (3, '["a","b"]'), (4, "[]"), (5, '["a",null]'), (6, '["a",1]'), (7, '["a",""]'), (8, '"a"'), (9, '{"a":true}'), (10, "42"), (11, "true")]
_REFS = "(SELECT substring(pin_id, 2)::BIGINT AS k, to_json(list(list_id ORDER BY list_id))::VARCHAR AS x FROM <pin_lists> GROUP BY pin_id)"
_V = f"(SELECT k AS id, CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN replace(x, ']', ',null]') WHEN 2 THEN '{{\"a\":' || x || '}}' ELSE x END AS body FROM {_REFS} UNION ALL SELECT -id, body FROM {values(VARIANTS, 'id', 'body')})"
_STATE = """CASE WHEN body IS NULL THEN 'absent' WHEN json_type(body::JSON) <> 'ARRAY' THEN 'malformed' WHEN len(list_filter(json_extract(body::JSON, '$[*]'), lambda x: json_type(x) <> 'VARCHAR' OR x::VARCHAR = '""')) > 0 THEN 'malformed' ELSE 'authoritative' END"""


@query(f"SELECT id::BIGINT AS id, {_STATE} AS state FROM {_V}")
def string_array_state(spark, sf_dir):
    """The lists of every pin, some as they are, some with an item that is no string, inside an object, or missing."""
    k, x = F.substring("pin_id", 2, 20).cast("long"), F.to_json(F.array_sort(F.collect_list("list_id")))
    refs = frame(spark, sf_dir, "pin_lists").groupBy("pin_id").agg(x.alias("x")).select(k.alias("id"), "x")
    k = F.col("id")
    body = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, F.replace("x", F.lit("]"), F.lit(",null]"))).when(k % 5 == 2, F.concat(F.lit('{"a":'), "x", F.lit("}"))).otherwise(F.col("x"))
    more = rows(spark, "id long, body string", [(-i, v) for i, v in VARIANTS])
    return refs.select("id", body.alias("body")).unionAll(more).select("id", V.string_array(F.try_parse_json("body")).alias("state"))


IDS = [(1, "ok"), (2, ""), (3, "a/b"), (4, "."), (5, ".."), (6, "__x__"), (7, "a\tb"), (8, "x" * 1500), (9, "x" * 1501), (10, None)]


_IDS = f"(SELECT substring(pin_id, 2)::BIGINT AS id, CASE o_k % 6 WHEN 0 THEN pin_id || '/' WHEN 1 THEN '__' || pin_id || '__' WHEN 2 THEN pin_id || chr(127) WHEN 3 THEN repeat(pin_id, 300) ELSE pin_id END AS x FROM (SELECT pin_id, substring(pin_id, 2)::BIGINT AS o_k FROM <pins>) UNION ALL SELECT -id, x FROM {values(IDS, 'id', 'x')})"


@query(f"SELECT id::BIGINT AS id, coalesce(length(x) BETWEEN 1 AND 1500 AND NOT contains(x, '/') AND x NOT IN ('.', '..') AND NOT regexp_matches(x, '[\\x00-\\x1F\\x7F]') AND NOT regexp_full_match(x, '__.*__'), false) AS valid FROM {_IDS}")
def valid_ids(spark, sf_dir):
    """The id of every pin, some spoilt."""
    p, k = F.col("pin_id"), F.substring("pin_id", 2, 20).cast("long")
    x = F.when(k % 6 == 0, F.concat(p, F.lit("/"))).when(k % 6 == 1, F.concat(F.lit("__"), p, F.lit("__"))).when(k % 6 == 2, F.concat(p, F.lit("\x7f"))).when(k % 6 == 3, F.repeat(p, F.lit(300))).otherwise(p)
    more = rows(spark, "id long, x string", [(-i, v) for i, v in IDS])
    return frame(spark, sf_dir, "pins").select(k.alias("id"), x.alias("x")).unionAll(more).select("id", V.doc_id(F.col("x")).alias("valid"))


PROFILES = [(1, '[{"uid":"a","firstName":"Ann"},{"uid":"b"},{"firstName":"x"},7,{"uid":"a","firstName":"Zoe","photoURL":"p"}]'), (2, '{"a":{}}'), (3, '"x"'), (4, None)]


_PROFILES = f"(SELECT k AS id, CASE WHEN k < 0 THEN body ELSE replace(body, 'Ann', 'Ann ' || k % 90) END AS body FROM {spread_sql(PROFILES, 'id', 'body')} x)"


@query(f"""WITH p AS (SELECT id, body::JSON AS j FROM {_PROFILES} x),
e AS (SELECT id, unnest(json_extract(j, '$[*]')) AS x, generate_subscripts(json_extract(j, '$[*]'), 1) AS i FROM p WHERE json_type(j) = 'ARRAY'),
u AS (SELECT id, x ->> '$.uid' AS uid, coalesce(nullif(x ->> '$.firstName', ''), 'User') AS name, coalesce(x ->> '$.photoURL', '') AS photo, i FROM e WHERE json_type(x) = 'OBJECT' AND coalesce(x ->> '$.uid', '') <> ''),
l AS (SELECT id, uid, arg_max(name || ':' || photo, i) AS shown FROM u GROUP BY id, uid)
SELECT p.id::BIGINT AS id, CASE WHEN json_type(j) = 'ARRAY' THEN 'convertedFromArray' WHEN json_type(j) = 'OBJECT' THEN 'alreadyMap' ELSE 'resetMalformed' END AS outcome,
  CASE WHEN json_type(j) = 'ARRAY' THEN coalesce(string_agg(uid || '=' || shown, ',' ORDER BY uid), '') END AS converted FROM p LEFT JOIN l ON l.id = p.id GROUP BY p.id, j""")
def profiles_array_to_map(spark, sf_dir):
    from ..operators.backfill import convert_profiles

    k = F.col("k")
    body = F.when(k < 0, F.col("body")).otherwise(F.replace("body", F.lit("Ann"), F.concat(F.lit("Ann "), k % 90)))
    out = convert_profiles(spread(spark, sf_dir, "id long, body string", PROFILES).select(k.alias("id"), F.try_parse_json(body).alias("profiles")))
    shown = F.transform(F.array_sort(F.map_entries("converted")), lambda e: F.concat(e["key"], F.lit("="), e["value"]["firstName"], F.lit(":"), F.coalesce(e["value"]["photo"], F.lit(""))))
    return out.select("id", "outcome", F.array_join(shown, ",").alias("converted"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A removal of each member row by its list's owner or, for odd owners, by another user."""
    m = frame(spark, sf_dir, "members").select("list_id", "pin_id", F.col("pin_owner_id").alias("member_owner"))
    lists = frame(spark, sf_dir, "lists").select("list_id", F.col("owner_id").alias("list_owner"), F.col("pin_count").cast("long").alias("pin_count"), F.col("name").alias("list_name"))
    pins = frame(spark, sf_dir, "pins").select("pin_id", F.col("user_id").alias("pin_owner"), F.lit(True).alias("_p"))
    named = frame(spark, sf_dir, "pin_lists").groupBy("pin_id").agg(F.to_variant_object(F.collect_list("list_id")).alias("pin_list_ids"))
    out = m.join(lists, "list_id", "left").join(pins, "pin_id", "left").join(named, "pin_id", "left")
    caller = F.when(F.substring("list_id", 2, 9).cast("long") % 3 == 0, F.lit("U999")).otherwise(F.col("list_owner"))
    return out.select("list_id", "pin_id", caller.alias("caller"), F.try_parse_json(F.lit("false")).alias("freeze"), "list_owner", "list_name", F.try_parse_json(F.lit('["U999"]')).alias("collaborators"), F.try_parse_json(F.when(F.substring("list_id", 2, 9).cast("long") % 2 == 0, F.lit('["U999"]'))).alias("viewers"),
                      "pin_count", F.col("pin_id").alias("member_pin"), "member_owner", F.coalesce("_p", F.lit(False)).alias("pin_exists"), "pin_owner", "pin_list_ids")


_DECIDED = """(SELECT m.list_id, m.pin_id, CASE WHEN l.list_id IS NULL THEN '404:no_list' WHEN k % 3 = 0 AND l.owner_id <> 'U999' AND k % 2 = 0 THEN '403:not_editor' WHEN p.pin_id IS NULL THEN '409:no_pin' WHEN n.pin_id IS NULL THEN '409:bad_lists' WHEN x.pin_id IS NULL THEN '409:not_listed'
  WHEN p.user_id <> m.pin_owner_id THEN '409:owners_differ' {extra} ELSE 'ok' END AS decision, l.pin_count, p.user_id AS pin_owner, CASE WHEN k % 3 = 0 THEN 'U999' ELSE l.owner_id END AS caller
  FROM (SELECT *, TRY_CAST(substring(list_id, 2) AS BIGINT) AS k FROM <members>) m LEFT JOIN <lists> l ON l.list_id = m.list_id LEFT JOIN <pins> p ON p.pin_id = m.pin_id LEFT JOIN (SELECT DISTINCT pin_id FROM <pin_lists>) n ON n.pin_id = m.pin_id LEFT JOIN <pin_lists> x ON x.pin_id = m.pin_id AND x.list_id = m.list_id)"""


@query(f"SELECT list_id, pin_id, decision, CASE WHEN decision = 'ok' THEN pin_count - 1 END::BIGINT AS new_count, coalesce(decision = 'ok' AND pin_owner <> caller, false) AS event FROM {_DECIDED.replace('{extra}', chr(87) + 'HEN coalesce(l.pin_count, 0) < 1 THEN ' + chr(39) + '409:bad_count' + chr(39))}")
def member_remove_decision(spark, sf_dir):
    out = M.removals(requests(spark, sf_dir))
    return out.select("list_id", "pin_id", "decision", "new_count", F.coalesce("event", F.lit(False)).alias("event"))


# overrides asked for, and those stored, by key
BODIES = [
    (0, '{"category":"food"}', None), (1, '{"category":"food","placeName":" Joe  Bar\\t"}', '{"category":"food"}'), (2, '{"category":"bar"}', None), (3, '{"placeName":null,"category":null}', '{"placeName":"Joe"}'),
    (4, '{"other":1,"category":"food"}', None), (5, "{}", None), (6, "[1]", None), (7, '{"placeName":"a<b>"}', None), (8, '{"placeName":"ok\u202ename"}', None), (9, '{"formattedAddress":"1 Main St"}', '{"formattedAddress":"1 Main St"}'),
    (10, '{"category":"nature"}', '{"category":"nature","bogus":"x"}'), (11, '{"category":"nature"}', '{"category":"bar"}'), (12, '{"placeName":"New"}', '{"category":"bar"}'), (13, '{"placeName":5}', None), (14, '{"placeName":"New"}', '"text"'),
    (15, '{"category":"food"}', '{"placeName":null}'), (16, '{"placeName":"' + "x" * 300 + '"}', '{"placeName":"Old","category":"other"}'),
]
_KINDS = ", ".join(f"'{c}'" for c in V.CATEGORIES)
_TRIM = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160) || chr(65279)"


def _stored_value(v: str, key: str) -> str:
    """What an override stores for a key of the JSON v, or NULL."""
    text = f"CASE WHEN json_type({v}, '$.{key}') = 'VARCHAR' THEN {v} ->> '$.{key}' END"
    if key == "category":
        return f"CASE WHEN {text} IN ({_KINDS}) THEN {text} END"
    shown = f"trim({text}, {_TRIM})"
    return f"CASE WHEN {shown} <> '' AND NOT regexp_matches({shown}, '[\\x00-\\x08\\x0A-\\x1F\\x7F-\\x{{9F}}<>]|\\p{{Cf}}') THEN left({shown}, 256) END"


def _op(key: str) -> str:
    return f"CASE WHEN json_type(b, '$.{key}') IS NULL THEN NULL WHEN json_type(b, '$.{key}') = 'NULL' THEN 'delete' WHEN {_stored_value('b', key)} IS NOT NULL THEN 'set' ELSE 'reject' END"


_NAMES = ", ".join(f"'{k}'" for k in V.EDITABLE)
_CHANGE = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN op_{k} = 'set' AND {_stored_value('b', k)} IS DISTINCT FROM (st ->> '$.{k}') THEN '{k}=set:' || {_stored_value('b', k)} WHEN op_{k} = 'delete' AND json_type(st, '$.{k}') IS NOT NULL THEN '{k}=delete:' END" for k in V.EDITABLE) + "], lambda x: x IS NOT NULL), ',')"
_BAD_STORED = "st IS NOT NULL AND (json_type(st) <> 'OBJECT' OR len(list_filter(json_keys(st), lambda x: x NOT IN (" + _NAMES + "))) > 0 OR " + " OR ".join(f"(op_{k} IS NULL AND json_type(st, '$.{k}') IS NOT NULL AND {_stored_value('st', k)} IS NULL)" for k in V.EDITABLE) + ")"


@query(f"""WITH d AS (SELECT d.*, o.body::JSON AS b, o.stored::JSON AS st FROM {_DECIDED.replace('{extra}', '')} d JOIN {values(BODIES, 'm', 'body', 'stored')} o ON o.m = coalesce(TRY_CAST(substring(d.pin_id, 2) AS BIGINT) % {len(BODIES)}, 0)),
o AS (SELECT *, {', '.join(f'{_op(k)} AS op_{k}' for k in V.EDITABLE)} FROM d),
c AS (SELECT *, json_type(b) <> 'OBJECT' OR len(json_keys(b)) = 0 OR len(list_filter(json_keys(b), lambda x: x NOT IN ({_NAMES}))) > 0 OR {' OR '.join(f"coalesce(op_{k} = 'reject', false)" for k in V.EDITABLE)} AS bad, {_CHANGE} AS changed, {_BAD_STORED} AS spoilt FROM o)
SELECT list_id, pin_id, CASE WHEN bad THEN '400:bad_body' WHEN decision <> 'ok' THEN decision WHEN coalesce(spoilt, false) THEN '409:bad_stored' WHEN changed = '' THEN 'ok:unchanged' ELSE 'ok' END AS decision,
  CASE WHEN NOT bad AND decision = 'ok' AND NOT coalesce(spoilt, false) THEN changed END AS changes FROM c""")
def member_override_delta(spark, sf_dir):
    out = M.overrides(override_requests(spark, sf_dir))
    shown = F.transform("changes", lambda o: F.concat(o["key"], F.lit("="), o["op"], F.lit(":"), F.coalesce(o["value"], F.lit(""))))
    return out.select("list_id", "pin_id", "decision", F.array_join(shown, ",").alias("changes"))


def override_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = rows(spark, "m int, body string, stored string", BODIES).select("m", F.try_parse_json("body").alias("body"), F.try_parse_json("stored").alias("stored"))
    m = F.coalesce(F.substring("pin_id", 2, 20).try_cast("long") % len(BODIES), F.lit(0)).cast("int")
    return requests(spark, sf_dir).withColumn("m", m).join(F.broadcast(asked), "m").drop("m")  # a row per branch


_REMOVED = f"""WITH q AS (SELECT d.*, coalesce(TRY_CAST(substring(pin_id, 2) AS BIGINT), 0) AS k FROM {_DECIDED.replace('{extra}', chr(87) + 'HEN coalesce(l.pin_count, 0) < 1 THEN ' + chr(39) + '409:bad_count' + chr(39))} d),
r AS (SELECT *, k AS pos FROM q UNION ALL SELECT *, k + 1000000000000 FROM q WHERE k % 7 = 0),
s AS (SELECT *, row_number() OVER (PARTITION BY list_id, pin_id ORDER BY pos) AS n FROM r WHERE decision = 'ok'),
t AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY pos) AS turn FROM s WHERE n = 1),
done AS (SELECT t.*, l.name AS list_name FROM t JOIN <lists> l ON l.list_id = t.list_id WHERE turn <= t.pin_count)
SELECT 'members' AS part, list_id, pin_id, '' AS value FROM done UNION ALL SELECT 'pin_lists', list_id, pin_id, '' FROM done
UNION ALL SELECT 'lists', list_id, NULL, (min(pin_count) - count(*))::BIGINT::VARCHAR FROM done GROUP BY list_id
UNION ALL SELECT 'events', list_id, pin_id, 'list_member_removed_by_editor|' || pin_owner || '|' || caller || '|' || list_name || '|' || CASE WHEN k % 5 = 0 THEN '' ELSE 'Place ' || pin_id END FROM done WHERE pin_owner <> caller"""


@query(_REMOVED)
def member_removal_deltas(spark, sf_dir):
    """Every member's removal asked for, some twice: the rows that change, by table."""
    k = F.coalesce(F.substring("pin_id", 2, 20).try_cast("long"), F.lit(0))
    asked = requests(spark, sf_dir).withColumn("pin_name", F.when(k % 5 == 0, F.concat(F.lit("<"), "pin_id")).otherwise(F.concat(F.lit("Place "), "pin_id")))
    again = F.explode(F.when(k % 7 == 0, F.array(k, k + 10**12)).otherwise(F.array(k)))
    out = M.removal_outcomes(asked.withColumn("pos", again)).filter("decision = 'ok'")
    shown = F.concat_ws("|", F.lit("list_member_removed_by_editor"), "pin_owner", "caller", X.event_field(F.coalesce("list_name", F.lit(""))), X.event_field(F.coalesce("pin_name", F.lit(""))))
    row = lambda part, value, pin="pin_id": F.struct(F.lit(part).alias("part"), F.col("list_id").alias("list_id"), (F.col(pin) if pin else F.lit(None)).cast("string").alias("pin_id"), value.alias("value"))
    parts = F.array(row("members", F.lit("")), row("pin_lists", F.lit("")), F.when(F.col("list_count").isNotNull(), row("lists", F.col("list_count").cast("string"), None)), F.when(F.col("event"), row("events", shown)))
    return out.select(F.explode(parts).alias("r")).filter("r is not null").select("r.*")


# four requests of a member in order: what they set, the same again, a delete and a set of other values
TURNS = 4
_ASKED = f"""(SELECT d.*, coalesce(TRY_CAST(substring(d.pin_id, 2) AS BIGINT), 0) AS k, r.turn, CASE r.turn WHEN 0 THEN o.body WHEN 1 THEN o.body WHEN 2 THEN '{{"placeName":null,"category":null}}' ELSE '{{"category":"food","formattedAddress":"Street ' || (coalesce(TRY_CAST(substring(d.pin_id, 2) AS BIGINT), 0) % 3) || '"}}' END::JSON AS b, o.stored::JSON AS st
  FROM {_DECIDED.replace('{extra}', '')} d JOIN {values(BODIES, 'm', 'body', 'stored')} o ON o.m = coalesce(TRY_CAST(substring(d.pin_id, 2) AS BIGINT) % {len(BODIES)}, 0), (SELECT unnest(range({TURNS})) AS turn) r)"""


def _ran(turn: int) -> str:
    """What a request does, given what is stored before it (st): its decision, changes, and what is stored after it."""
    sets = "'{' || array_to_string(list_filter([" + ", ".join(f"CASE WHEN op_{k} = 'set' THEN '\"{k}\":' || to_json({_stored_value('b', k)})::VARCHAR WHEN op_{k} = 'delete' THEN '\"{k}\":null' END" for k in V.EDITABLE) + "], lambda x: x IS NOT NULL), ',') || '}'"
    before = f"(SELECT * FROM {_ASKED} a WHERE turn = {turn})" if turn == 0 else f"(SELECT a.* EXCLUDE (st), p.after AS st FROM {_ASKED} a JOIN r{turn - 1} p ON p.list_id = a.list_id AND p.pin_id = a.pin_id WHERE a.turn = {turn})"
    return f"""o{turn} AS (SELECT *, {', '.join(f'{_op(k)} AS op_{k}' for k in V.EDITABLE)} FROM {before} x),
c{turn} AS (SELECT *, json_type(b) <> 'OBJECT' OR len(json_keys(b)) = 0 OR len(list_filter(json_keys(b), lambda x: x NOT IN ({_NAMES}))) > 0 OR {' OR '.join(f"coalesce(op_{k} = 'reject', false)" for k in V.EDITABLE)} AS bad, {_CHANGE} AS changed, {_BAD_STORED} AS spoilt FROM o{turn}),
r{turn} AS (SELECT *, CASE WHEN done = 'ok' THEN json_merge_patch(coalesce(st, '{{}}'), ({sets})::JSON) ELSE st END AS after FROM (SELECT *, CASE WHEN bad THEN '400:bad_body' WHEN decision <> 'ok' THEN decision WHEN coalesce(spoilt, false) THEN '409:bad_stored' WHEN changed = '' THEN 'ok:unchanged' ELSE 'ok' END AS done FROM c{turn}) y)"""


_SHOWN = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN json_type(after, '$.{k}') IS NOT NULL THEN '{k}=' || (after ->> '$.{k}') END" for k in V.EDITABLE) + "], lambda x: x IS NOT NULL), ',')"
_NAMED = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(',' || changed, ',{k}=') THEN '{k}' END" for k in V.EDITABLE) + "], lambda x: x IS NOT NULL), ',')"


@query(f"""WITH {', '.join(_ran(t) for t in range(TURNS))},
a AS ({' UNION ALL '.join(f'SELECT list_id, pin_id, turn, done, CASE WHEN done = $$ok$$ THEN changed WHEN done = $$ok:unchanged$$ THEN $$$$ END AS changed, after, pin_owner, caller FROM r{t}' for t in range(TURNS))})
SELECT 'decision' AS part, list_id, pin_id, turn::BIGINT AS turn, done || ' ' || coalesce(changed, '-') AS value FROM a
UNION ALL SELECT 'member', list_id, pin_id, NULL, {_SHOWN} FROM (SELECT *, max(turn) OVER (PARTITION BY list_id, pin_id) AS newest FROM a WHERE done = 'ok') n WHERE turn = newest
UNION ALL SELECT 'event', list_id, pin_id, turn, pin_owner || '|' || caller || '|' || {_NAMED} FROM a WHERE done = 'ok' AND pin_owner <> caller""")
def override_transactions(spark, sf_dir):
    """Four override requests for every member, in order: each one's decision and effective changes, what members hold in the end, and the events."""
    asked = override_requests(spark, sf_dir)
    k = F.coalesce(F.substring("pin_id", 2, 20).try_cast("long"), F.lit(0))
    asked = asked.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(TURNS - 1)))).withColumn("pos", F.col("turn").cast("long") * 10 + 1)
    third, fourth = F.lit('{"placeName":null,"category":null}'), F.concat(F.lit('{"category":"food","formattedAddress":"Street '), k % 3, F.lit('"}'))
    body = F.when(F.col("turn") < 2, F.col("body")).otherwise(F.try_parse_json(F.when(F.col("turn") == 2, third).otherwise(fourth)))
    out = M.override_outcomes(asked.withColumn("body", body))
    shown = F.array_join(F.transform("changes", lambda o: F.concat(o["key"], F.lit("="), o["op"], F.lit(":"), F.coalesce(o["value"], F.lit("")))), ",")
    held = F.array_join(F.transform(F.filter(F.array(*map(F.lit, V.EDITABLE)), lambda x: F.map_contains_key("overrides", x)), lambda x: F.concat(x, F.lit("="), F.element_at("overrides", x))), ",")
    row = lambda part, value, turn=True: F.struct(F.lit(part).alias("part"), F.col("list_id").alias("list_id"), F.col("pin_id").alias("pin_id"), (F.col("turn") if turn else F.lit(None)).cast("long").alias("turn"), value.alias("value"))
    keys = F.array_join(F.transform("changes", lambda o: o["key"]), ",")
    parts = F.array(row("decision", F.concat_ws(" ", "decision", F.coalesce(shown, F.lit("-")))), F.when(F.col("last"), row("member", held, False)), F.when(F.col("event"), row("event", F.concat_ws("|", "pin_owner", "caller", keys))))
    return out.select(F.explode(parts).alias("r")).filter("r is not null").select("r.*")


FLAGS = [(1, "true"), (2, "false"), (3, '"x"'), (4, None)]


@query(f"""SELECT id, CASE id % 5 WHEN 0 THEN 'created' WHEN 4 THEN 'field_added' WHEN 3 THEN 'left_malformed' ELSE 'no_op' END AS action FROM (SELECT event_id::BIGINT AS id FROM events)
UNION ALL SELECT -id::BIGINT, CASE WHEN v IS NULL THEN 'field_added' WHEN v IN ('true', 'false') THEN 'no_op' ELSE 'left_malformed' END FROM {values(FLAGS, 'id', 'v')}""")
def seed_flags(spark, sf_dir):
    """A flag for every event: four of five have a control row, of each kind."""
    k = F.col("event_id").cast("long")
    flags = frame(spark, sf_dir, "events").select(k.alias("flag"))
    known = rows(spark, "flag long, value string", [(-i, v) for i, v in FLAGS])
    value = F.when(k % 5 < 3, F.when(k % 5 == 1, "true").otherwise("false")).when(k % 5 == 3, '"x"')
    stored = frame(spark, sf_dir, "events").filter(k % 5 != 0).select(k.alias("flag"), value.alias("value"))
    return snapshots.seed_flags(flags.unionAll(known.select("flag")), stored.unionAll(known)).select(F.col("flag").alias("id"), "action")
