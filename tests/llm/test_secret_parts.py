"""Texts with very many matches: what is worked on in parts is what is worked on at once."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from placeflow.llm import secrets
from placeflow.session import ship

SPAN = "array<struct<s:int,e:int>>"


@pytest.mark.parametrize("part", [1, 3, 256])
def test_spans_and_clear_tokens_in_parts(spark, monkeypatch, part):
    monkeypatch.setattr(secrets, "PART", part)
    rng = random.Random(part)
    texts = ["", "x", "é" + "ab1 " * 40, *["".join(rng.choice("a1é \n") for _ in range(rng.randrange(200))) for _ in range(25)]]
    got = ship(spark).createDataFrame([(t,) for t in texts], "t string").select("t", secrets._spans(F.col("t"), "[a1]+").alias("x")).collect()
    for r in got:
        assert [(x.s, x.e, x.value) for x in r.x] == [(m.start(), m.end(), m[0]) for m in re.finditer("[a1]+", r.t)]
    rows = []
    for k in range(40):
        tokens, base, at = [], [], 0
        for _ in range(rng.randrange(30)):
            at += rng.randrange(1, 9)
            tokens.append((at, at := at + rng.randrange(1, 6)))
        for _ in range(rng.randrange(12)):
            s = rng.randrange(200)
            base.append((s, s + rng.randrange(1, 30)))
        rows.append((k, tokens, sorted(base)))
    out = spark.createDataFrame(rows, f"k int, a {SPAN}, b {SPAN}").select("k", secrets._clear(F.col("a"), F.col("b")).alias("x")).collect()
    assert {r.k: [tuple(x) for x in r.x] for r in out} == {k: [t for t in a if not any(s < t[1] and t[0] < e for s, e in b)] for k, a, b in rows}


@pytest.mark.parametrize("part", [1, 4, 256])
def test_redacted_in_parts(spark, monkeypatch, part):
    monkeypatch.setattr(secrets, "PART", part)
    rng, rows = random.Random(part), []
    for k in range(60):
        text = "".join(rng.choice("abcé😀") for _ in range(rng.randrange(1, 120)))
        spans = [(s, min(len(text), s + rng.randrange(1, 9))) for s in (rng.randrange(len(text)) for _ in range(rng.randrange(25)))]
        rows.append((k, text, spans))
    rows.append((99, None, []))
    got = {r.k: r.x for r in spark.createDataFrame(rows, f"k int, t string, a {SPAN}").select("k", secrets.redacted(F.col("t"), F.col("a"), "#").alias("x")).collect()}
    for k, text, spans in rows:
        covered = {i for s, e in spans for i in range(s, e)}
        want = None if text is None else re.sub("\x00+", "#", "".join("\x00" if i in covered else c for i, c in enumerate(text)))
        assert got[k] == want


def test_a_text_of_many_keys(spark):
    text = "\n".join(hashlib.md5(str(k).encode()).hexdigest() for k in range(60_000))
    docs = ship(spark).createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    found = secrets.scan(docs, keep=("text",)).withColumn("spans", F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    row = found.select(F.size("base").alias("n"), F.size("random").alias("m"), secrets.redacted(F.col("text"), F.col("spans")).alias("x")).first()
    assert row.n == 60_000 and row.m == 0 and row.x == "\n".join(["[SECRET]"] * 60_000) and time.time() - began < 60
