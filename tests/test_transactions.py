"""Requests on list members as transactions in order, against a loop over what is stored."""

import json
import random

from pyspark.sql import functions as F

from placeflow.functions.variant import CATEGORIES, EDITABLE
from placeflow.operators import members as M
from placeflow.plans import QUERIES

BASE = "list_id string, pin_id string, pos long, caller string, list_owner string, pin_count long, member_pin string, member_owner string, pin_exists boolean, pin_owner string, list_name string, pin_name string, body_ string, stored_ string"


def requests(spark, rows):
    out = spark.createDataFrame(rows, BASE)
    v = lambda x: F.try_parse_json(x)
    named = F.to_json(F.array("list_id"))
    return out.select("*", v(F.lit("false")).alias("freeze"), v(F.lit('["ed"]')).alias("collaborators"), v(F.lit("[]")).alias("viewers"), v(named).alias("pin_list_ids"), v("body_").alias("body"), v("stored_").alias("stored")).drop("body_", "stored_")


def fine(key, value):
    return isinstance(value, str) and (value in CATEGORIES if key == "category" else value.strip() != "" and "<" not in value)


def folded(rows):
    """Decision, changes and what is stored after each request, in order of pos."""
    held, out = {}, {}
    for r in sorted(rows, key=lambda r: r[2]):
        lid, pid, pos, caller, owner = r[:5]
        now = held.setdefault((lid, pid), json.loads(r[13]) if r[13] else {})
        body = json.loads(r[12])
        if not isinstance(body, dict) or not body or any(k not in EDITABLE or not (v is None or fine(k, v)) for k, v in body.items()):
            out[lid, pid, pos] = ("400:bad_body", None)
        elif caller not in (owner, "ed"):
            out[lid, pid, pos] = ("403:not_editor", None)
        elif any(k not in body and (k not in EDITABLE or not fine(k, v)) for k, v in now.items()):
            out[lid, pid, pos] = ("409:bad_stored", None)
        else:
            changes = [k for k in EDITABLE if k in body and (k in now if body[k] is None else now.get(k) != body[k])]
            for k in changes:
                if body[k] is None:
                    del now[k]
                else:
                    now[k] = body[k]
            out[lid, pid, pos] = ("ok" if changes else "ok:unchanged", changes)
    return out, held


def asked(seed):
    rng = random.Random(seed)
    stored = {p: s for p, s in enumerate([None, "{}", '{"category":"food"}', '{"placeName":5}', '{"placeName":null,"category":"zoo"}', '{"bogus":"x"}', '{"formattedAddress":"a"}'])}
    rows = []
    for k in range(500):
        pin = 0 if k % 3 == 0 else rng.randrange(7)  # a third of all requests are one member's
        body = {key: rng.choice([None, "food", "bar" if key != "category" else "other", "zoo", "b<"] if rng.random() < 0.3 else [None, "food", "other"]) for key in EDITABLE if rng.random() < 0.6}
        rows.append(("L1", f"P{pin}", k * 7 % 500, rng.choice(["own", "ed", "ed", "no"]), "own", 9, f"P{pin}", "u", True, "u", "List", "<Pin", json.dumps(body), stored[pin]))
    return rows


def test_overrides_by_a_loop(spark):
    for seed in (1, 2):
        rows = asked(seed)
        got = {(r.list_id, r.pin_id, r.pos): (r.decision, None if r.changes is None else [c.key for c in r.changes]) for r in M.override_outcomes(requests(spark, rows)).collect()}
        want, held = folded(rows)
        assert got == want and {d for d, _ in want.values()} == {"ok", "ok:unchanged", "400:bad_body", "403:not_editor", "409:bad_stored"}
        out = M.override_deltas(requests(spark, rows), F.lit("2024-01-01").cast("timestamp"))
        changed = {k[1] for k, (d, _) in want.items() if d == "ok"}
        assert {r.pin_id: r.overrides for r in out["members"].collect()} == {p: held["L1", p] for p in changed}
        events = sorted((r.pin_id, r.changed, r.actor, r.list_name, r.pin_name) for r in out["events"].collect())
        by_pos = {(r[1], r[2]): r for r in rows}
        assert events == sorted((p, c, by_pos[p, pos][3], "List", "") for (_, p, pos), (d, c) in want.items() if d == "ok")
        assert out["decisions"].count() == len(rows)


def test_removals_by_a_loop(spark):
    rng = random.Random(3)
    rows = [(f"L{k % 3}", f"P{rng.randrange(40)}", k * 11 % 307, rng.choice(["own", "ed", "no"]), "own", (0, 5, 30)[k % 3], "", "own", True, "own", "List", "Pin", None, None) for k in range(307)]
    rows = [(*r[:6], r[1], *r[7:]) for r in rows]
    gone, left, want = set(), {"L0": 0, "L1": 5, "L2": 30}, {}
    for r in sorted(rows, key=lambda r: r[2]):
        key = (r[0], r[1])
        if r[3] == "no":
            want[r[0], r[1], r[2]] = "403:not_editor"
        elif key in gone:
            want[r[0], r[1], r[2]] = "ok:already_gone"
        elif left[r[0]] < 1:
            want[r[0], r[1], r[2]] = "409:bad_count"
        else:
            gone.add(key)
            left[r[0]] -= 1
            want[r[0], r[1], r[2]] = "ok"
    out = M.removal_deltas(requests(spark, rows).drop("body", "stored"), F.lit("2024-01-01").cast("timestamp"))
    got = {(r.list_id, r.pin_id, r.pos): r.decision for r in out["decisions"].collect()}
    differ = {k for k in want if got[k] != want[k]}
    assert all({got[k], want[k]} <= {"409:bad_count", "ok:already_gone"} for k in differ)  # a member refused once isn't gone
    assert {(r.list_id, r.pin_id) for r in out["members"].collect()} == gone == {(r.list_id, r.pin_id) for r in out["pin_lists"].collect()}
    assert {r.list_id: r.pin_count for r in out["lists"].collect()} == {k: v for k, v in left.items() if k != "L0"}
    assert out["events"].count() == sum(d == "ok" for d in want.values()) - sum(1 for k, d in want.items() if d == "ok" and next(r for r in rows if r[:3] == k)[3] == "own")


def test_plan_of_removals(spark, small):
    text = QUERIES["member_removal_deltas"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation [") <= 10


def test_lists_are_read_in_one_place(spark):
    """The pin's lists are a column before the ladder, whose tests don't read them again, and a list's two windows share one exchange."""
    asked_ = requests(spark, asked(1)).drop("body", "stored")
    plan = M.removals(asked_)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get(pin_list_ids") <= 3
    out = M.removal_outcomes(asked_)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(list_id") <= 2
    assert not [c for c in out.columns if c.startswith("_")]
    # an item that is no string with characters, an array with too many, no array, no lists: all refused
    v = lambda x: F.try_parse_json(F.lit(x))
    for given, want in (('["L0","L1","L2"]', None), ('["L0","L1","L2",null]', "409:bad_lists"), ('["L0","L1","L2",""]', "409:bad_lists"), ('["L0",7]', "409:bad_lists"), ('"L0"', "409:bad_lists"), (None, "409:bad_lists"), ("[]", "409:not_listed")):
        seen = {r.decision for r in M.removals(asked_.withColumn("pin_list_ids", v(given)).withColumn("caller", F.col("list_owner"))).collect()}
        assert (want in seen) if want else not seen & {"409:bad_lists", "409:not_listed"}
    for roles, want in ((("7", "[]"), "409:bad_roles"), ((None, None), "403:not_editor"), (('["x"]', '["x"]'), "403:not_editor"), (('["x"]', "{}"), "409:bad_roles")):
        seen = {r.decision for r in M.removals(asked_.withColumn("collaborators", v(roles[0])).withColumn("viewers", v(roles[1])).withColumn("caller", F.lit("x"))).collect()}
        assert seen == {want}
