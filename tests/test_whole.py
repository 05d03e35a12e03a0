"""Queries over all of their input: nothing filtered away, against plain loops or their SQL."""

import os
import re
from collections import Counter

import duckdb
import pytest

from placeflow import plans


def db(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{folder}/{f}'")
    return con


def caption(text):
    for pattern in ("[\U0001f600-\U0001f9ff☀-➿\U0001f300-\U0001f5ff]", "#[A-Za-z0-9_]+", "@[A-Za-z0-9_]+", r"https?://[^ \t\n\x0b\f\r]+"):
        text = re.sub(pattern, "", text)
    text = re.sub("[|•·—–]", " ", text)
    for pattern in (r"(?i)(?<!\w)on Instagram(?!\w)", r"(?i)(?<!\w)on TikTok(?!\w)", r"(?i)(?<!\w)Reels?(?!\w)", r"(?i)(?<!\w)likes?,?\s*\d+\s*comments?(?!\w)", r"(?i)\d+\s*likes?(?!\w)"):
        text = re.sub(pattern, "", text, flags=re.ASCII)
    return " ".join(text.split()).lower()


def test_confidence_of_every_document(spark, small):
    con = db(small)
    names = dict(con.execute("SELECT p_partkey, p_name FROM part").fetchall())
    rows = con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()
    results = Counter((i % 7, i % 200) for i, _ in rows if i % 200 in names)
    want = {}
    for i, text in rows:
        name, n, body = names.get(i % 200), results[i % 7, i % 200], caption(text)
        words = [w for w in re.split(r"[,\s]+", f"main street, {name.lower()}") if len(w) > 3] if name else []
        want[i] = (40 * bool(name and name.lower() in body) + 20 * any(w in body for w in words) + 20 * (i % 4 == 0) + 10 * (i % 200 > 100) + 10 * (n == 1)) if n else 0
    got = [tuple(r) for r in plans.QUERIES["confidence_score"](spark, small).select("id", "score").collect()]
    assert len(got) == len(rows)
    assert dict(got) == want


@pytest.mark.parametrize("name", ["dedup_precedence", "pin_by_url_and_content", "source_append"])
def test_every_order_is_a_share(spark, small, name):
    con = db(small)
    want = {r[0]: r for r in con.execute(plans.ORACLE[name]).fetchall()}
    columns = [d[0] for d in con.description]
    keys = {k for (k,) in con.execute("SELECT o_orderkey FROM orders").fetchall()}
    got = [tuple(r) for r in plans.QUERIES[name](spark, small).select(columns).collect()]
    assert sorted(r[0] for r in got) == sorted(keys)
    assert {r[0]: r for r in got} == want
    if name == "dedup_precedence":
        assert {r[columns.index("via")] for r in got} == {"place", "url", "normal_url", "new"}


def test_every_order_is_written(spark, small):
    n = db(small).execute("SELECT count(*) FROM orders").fetchone()[0]
    rows = plans.QUERIES["write_batch"](spark, small).collect()
    found = {r.pos: r.existing_pin for r in plans.QUERIES["dedup_precedence"](spark, small).collect()}
    assert len(rows) == n and {r.inserted for r in rows} == {True, False}
    assert all(r.pin_id == found[r.pos] for r in rows if found[r.pos])


def test_candidates_take_every_hit(spark, small, monkeypatch):
    from placeflow.operators import enrich

    seen, resolve = [], enrich.resolve
    monkeypatch.setattr(enrich, "resolve", lambda c, hits, *more: seen.append(hits.count()) or resolve(c, hits, *more))
    states = {r.state for r in plans.QUERIES["candidate_resolution"](spark, small).collect()}
    assert seen == [db(small).execute("SELECT count(*) FROM part").fetchone()[0]] and states == {"unresolved", "existing", "new"}


def test_every_step_of_enrichment(small):
    found = db(small.replace("0.001", "0.01")).execute(f"SELECT DISTINCT step, status FROM ({plans.ORACLE['enrichment_run']})").fetchall()
    assert {s for s, _ in found} == {"url", "maps", "content", "matches", "candidate", "candidates", "fallback", "none"}
    assert {s for _, s in found} == {"duplicate", "complete", "needs_selection", "failed"}


def test_garbage_and_fallback_queries(spark):
    from pyspark.sql import functions as F

    from placeflow.operators import flow

    rows = [("TikTok", None, "", ""), ("abc", None, "", ""), ("Lucali Pizza", None, "", ""), (None, None, "", "📍 Ippudo Ramen, 65 4th Ave #nyc"), (None, None, "", ""), (None, "we had 'The Long Name' in Soho", "", ""), ("x", None, "plain words", "only some very small words here again")]
    got = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, guess string, caption string, title string, description string").select("k", flow.fallback_query(F.col("guess"), F.col("caption"), F.col("title"), F.col("description")).alias("q")).orderBy("k").collect()
    assert [r.q for r in got] == [None, None, "Lucali Pizza", "Ippudo Ramen", None, "The Long Name Soho", "plain words only some very small words"]
