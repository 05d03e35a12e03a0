"""Search by cells against every pair compared, at the poles and around 180 degrees too."""

import math
import random

import pytest

from placeflow.operators import near as N
from placeflow.plans import near as plans

PLACE, POINT = "place_id string, name string, lat double, lng double, key string, cell string, metres int", "query_id long, text string, lat double, lng double, key int, metres string"


def metres(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return math.floor(2 * 6371 * math.atan2(math.sqrt(h), math.sqrt(1 - h)) * 1000 + 0.5)


def scattered(seed, n, spread):
    """Points around the poles, around 180 degrees, on the equator and elsewhere."""
    rng = random.Random(seed)
    centres = [(90, 0), (-90, 10), (89.99, 179), (0, 180), (0.01, -180), (60, 179.99), (-45, 0), (89.9, -90), (51.5, 0)]
    out = []
    for _ in range(n):
        lat, lng = rng.choice(centres)
        lat = max(-90.0, min(90.0, lat + rng.uniform(-spread, spread)))
        lng = lng + rng.uniform(-spread, spread) / max(0.001, math.cos(math.radians(lat)))
        out.append((lat, (lng + 180) % 360 - 180))
    return out


@pytest.mark.parametrize("seed, radius, spread", [(1, 2000, 0.03), (2, 50, 0.001), (3, 100_000, 1.5)])
def test_near(spark, seed, radius, spread):
    places = [(f"p{k:03}", "A  b" if k % 3 else "c", *p, "x", "y", 1) for k, p in enumerate(scattered(seed, 300, spread))]
    places += [(f"q{k}", "a b", *places[0][2:4], "x", "y", 1) for k in range(30)] + [(None, "a b", 0.0, 0.0, "", "", 1), ("z", None, 0.0, 180.0, "", "", 1), ("far", "a b", None, 5.0, "", "", 1)]
    asked = [(k, ["a B", "c", "nowhere"][k % 3], *p, 1, "m") for k, p in enumerate(scattered(seed + 9, 150, spread))]
    asked += [(900, "a b", None, 1.0, 1, ""), (901, None, 0.0, 0.0, 1, ""), (None, "c", 0.0, 0.0, 1, ""), (902, "c", 91.0, 0.0, 1, ""), (903, "a b", *places[0][2:4], 1, "")]
    got = sorted(tuple(r) for r in N.search_near(spark.createDataFrame(asked, POINT), spark.createDataFrame(places, PLACE), radius, 4).collect())
    want, form = [], lambda t: " ".join((t or "").lower().split())
    for i, text, lat, lng, *_ in asked:
        if i is None or text is None:
            continue
        same = [p for p in places if p[0] is not None and form(p[1]) == form(text)]
        point = lat is not None and -90 <= lat <= 90
        close = sorted((m, p[0]) for p in same if point and p[2] is not None and (m := metres(lat, lng, p[2], p[3])) <= radius)[:4]
        want += [(i, r, p, m, True) for r, (m, p) in enumerate(close, 1)]
        if not close and same:
            want.append((i, 1, min(p[0] for p in same), None, False))
    assert got == sorted(want) and sum(r[4] for r in want) > 50


def test_inside(spark):
    rng = random.Random(4)
    places = [(f"p{k:03}", "a", rng.uniform(-90, 90), rng.uniform(-180, 180), "", "", 1) for k in range(400)]
    places += [("pole", "a", 90.0, 0.0, "", "", 1), ("date", "a", 0.0, 180.0, "", "", 1), ("edge", "a", 10.0, 20.0, "", "", 1)]
    boxes = []
    for k in range(120):
        lat, lng, high, wide = rng.uniform(-90, 80), rng.uniform(-180, 180), rng.choice([0.5, 8, 60]), rng.choice([0.5, 15, 100, 300])
        boxes.append((k, "A", lat, lng, min(90.0, lat + high), (lng + wide + 180) % 360 - 180))
    boxes += [(200, "a", -90.0, -180.0, 90.0, 180.0), (201, "a", 10.0, 20.0, 10.0, 20.0), (202, "a", 5.0, 0.0, 1.0, 9.0), (203, None, 0.0, 0.0, 1.0, 1.0), (204, "a", None, 0.0, 1.0, 1.0), (201, "a", 10.0, 20.0, 10.0, 20.0)]
    found = N.search_inside(spark.createDataFrame(boxes, "query_id long, text string, low_lat double, low_lng double, high_lat double, high_lng double"), spark.createDataFrame(places, PLACE), 1000)
    got = sorted((r.query_id, r.place_id) for r in found.collect())
    want = set()
    for i, text, a, b, c, d in boxes:
        if text and a is not None:
            want |= {(i, p[0]) for p in places if a <= p[2] <= c and (b <= p[3] <= d if b <= d else p[3] >= b or p[3] <= d)}
    assert got == sorted(want) and len(want) > 1000
    ranks = {}
    for r in found.collect():
        ranks.setdefault(r.query_id, []).append((r.rank, r.metres))
    assert all([m for _, m in sorted(v)] == sorted(m for _, m in v) for v in ranks.values())


def test_plans_join_by_equality(spark, small):
    for f in (plans.search_near_pins, plans.search_inside_boxes):
        text = f(spark, small)._jdf.queryExecution().toString()
        assert "Cartesian" not in text and "NestedLoop" not in text
    none = spark.createDataFrame([], PLACE)
    assert N.search_near(spark.createDataFrame([(1, "a", 0.0, 0.0, 1, "")], POINT), none).count() == 0


def test_a_rectangle_is_searched_once_however_many_ask(spark):
    boxes = spark.createDataFrame([(k, "a", 0.0, 0.0, 9.0, 9.0) for k in range(50)] + [(0, "A", 0.0, 0.0, 2.0, 2.0)], "query_id long, text string, low_lat double, low_lng double, high_lat double, high_lng double")
    found = N.search_inside(boxes, spark.createDataFrame([(f"p{k}", "a", 0.5 * k, 0.5 * k) for k in range(12)], "place_id string, name string, lat double, lng double"), 3)
    below = found._jdf.queryExecution().optimizedPlan().toString().split("explode(ids")[1].splitlines()
    assert "query_id" not in below[1] and "Aggregate" in "".join(below)
    rows = found.collect()
    assert len(rows) == 150 and {r.place_id for r in rows if r.query_id == 49} == {"p8", "p9", "p10"}
    assert {("p2", 0), ("p9", 0)} < {(r.place_id, r.metres) for r in rows if r.query_id == 0}
