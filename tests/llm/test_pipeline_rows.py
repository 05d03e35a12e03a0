"""Each stage of the pipeline, row by row, against brute force; ids that are null or shared."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from placeflow.llm import mixing, neardup, secrets, toxicity

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """Documents of (id, text)."""
    return spark.createDataFrame([(i, t, "en", "web", None if t is None else len(t)) for i, t in rows], DOC)


def words(seed, n=120):
    return [f"w{k}" for k in np.random.default_rng(seed).integers(0, 100000, n)]


def edited(text, n, mark):
    out = list(text)
    for k in range(n):
        out[10 + 20 * k] = f"{mark}{k}"
    return " ".join(out)


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def groups(rows, percent=80):
    """Sets of (id, text) linked by near copies."""
    out = []
    for r in rows:
        a = shingles(r[1])
        near = [g for g in out if any(100 * len(a & shingles(x[1])) >= percent * len(a | shingles(x[1])) for x in g)]
        out = [g for g in out if g not in near] + [{r}.union(*near)]
    return out


def test_bands_rarely_miss():
    assert neardup.banding(85) == (32, 6)
    for percent in (50, 80, 85, 95):
        bands, rows = neardup.banding(percent)
        assert bands * rows <= neardup.N and (1 - (percent / 100) ** rows) ** bands <= 3e-7


def test_near_copies_between_80_and_85(spark):
    rows = []
    for k in range(40):
        base = words(k)
        rows += [(3 * k, " ".join(base)), (3 * k + 1, edited(base, 2, "x")), (3 * k + 2, edited(base, 4, "y"))]
    close = [len(shingles(rows[3 * k][1]) & shingles(rows[3 * k + 1][1])) / len(shingles(rows[3 * k][1]) | shingles(rows[3 * k + 1][1])) for k in range(40)]
    assert all(0.8 <= c < 0.85 for c in close)
    got = {r.doc_id for r in P.drop_near_duplicates(spark, frame(spark, rows), SF).collect()}
    assert got == {min(i for i, _ in g) for g in groups(rows)}


def test_near_copies_with_shared_ids(spark):
    a, b, c = words(100), words(101), words(102)
    rows = [(1, " ".join(a)), (2, " ".join(b)), (2, edited(a, 1, "x")), (3, " ".join(c)), (3, " ".join(words(103))), (4, " ".join(c)), (5, " ".join(b)), (5, " ".join(b)), (None, " ".join(a))]
    got = sorted(((r.doc_id, r.text) for r in P.drop_near_duplicates(spark, frame(spark, rows), SF).collect()), key=str)
    want = [min(g) for g in groups([r for r in rows if r[0] is not None])] + [rows[-1]]
    assert got == sorted(want, key=str)


def test_toxic_by_text(spark):
    """Rows that training doesn't see (null ids, and one of the held-out fold) are judged by their own text, too."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select(P.COLUMNS), spark.read.parquet(f"{SF}/labels.parquet")
    bad = {r.text for r in toxicity.toxicity(docs, labels, keep=("text",)).collect() if r.predicted}
    rows = docs.collect()
    held = next(r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.text not in bad)
    more = [*rows, *[(None, r.text, *r[2:]) for r in rows if r.text in bad], *[(held.doc_id, r.text, *r[2:]) for r in rows if r.text in bad]]
    got = [(r.doc_id, r.text) for r in P.drop_toxic(spark, spark.createDataFrame(more, docs.schema), SF).collect()]
    assert bad and sorted(got, key=str) == sorted(((r[0], r[1]) for r in more if r[1] not in bad), key=str)


def test_secrets_of_every_row(spark):
    key = ["AKIA" + c * 16 for c in "ABC"]
    rows = [(1, f"one {key[0]} x"), (1, f"a longer start {key[1]}"), (1, "nothing here"), (None, key[2]), (2, None), (3, "")]
    got = P.mask_secrets(spark, frame(spark, rows), SF).collect()
    want = [(i, None if t is None else re.sub("AKIA[A-Z]{16}", "[SECRET]", t)) for i, t in rows]
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    assert secrets.scan(frame(spark, rows)).columns == ["doc_id", "base", "random"]


@pytest.mark.parametrize("seed", [1, 2])
def test_mix_takes_its_target(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(None if k % 9 == 0 else int(rng.integers(0, 20)), " ".join(words(k, int(rng.integers(0, 30)))) if k % 11 else None, "en", None if k % 5 == 0 else f"s{k % 3}", k) for k in range(150)]
    docs = spark.createDataFrame(rows, DOC)
    target = {r.source: int(r.target) for r in mixing.mix_sources(docs).collect()}
    got, texts = dict.fromkeys(target, 0), {(r[0], r[3], r[1]) for r in rows}
    for r in P.mix(spark, docs, SF).collect():
        n = len(r.text.split())
        got[r.source] += n
        assert (r.doc_id, r.source, r.text) in texts or any(i == r.doc_id and s == r.source and t and t.startswith(r.text) for i, s, t in texts)
    assert got == target
    assert {r.doc_id for r in P.mix(spark, docs, SF).collect()} >= {None}


def test_stages_on_empty_tables_and_other_columns(spark):
    """Each stage of an empty table is empty; columns that clash with those inside change nothing."""
    none = frame(spark, [(1, "x")]).limit(0)
    more = frame(spark, [(1, " ".join(words(1))), (2, edited(words(1), 1, "x")), (None, None), (3, "")])
    for c, v in (("id", 7), ("row", 7), ("key", "k"), ("size", 1), ("taken", 9), ("spans", "s"), ("words", 3), ("node", 5), ("n", 4), ("own", "o")):
        more = more.withColumn(c, F.lit(v))
    plain = more.select(P.COLUMNS)
    for _, stage in P.STAGES:
        assert stage(spark, none, SF).count() == 0
    for name, stage in P.STAGES[:-1]:
        got, want = (sorted(map(tuple, stage(spark, d, SF).collect()), key=str) for d in (more, plain))
        assert got == want, name
    assert len(P.drop_near_duplicates(spark, more, SF).collect()) == 3


def test_packing_places_every_row(spark):
    """Null and repeated ids, empty and very long texts: every row's pieces stand gapless in sequences of at most 2048."""
    rows = [(None, "a b"), (None, None), (1, "x y z"), (1, "x y z"), (2, ""), (3, " ".join(words(5, 4000)))]
    got = P.pack_sequences(spark, frame(spark, rows), SF).collect()
    assert sorted((r.doc_id for r in got if r.piece == 0), key=str) == sorted((i for i, _ in rows), key=str)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in places.values():
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))] and sum(n for _, n in s) <= 2048
