"""What the classifiers learn, against plain loops, and what copies, null ids and clashing columns change: nothing."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from placeflow.llm import labelled, toxicity
from placeflow.session import ship

SF = "/root/testdata/sf0.001"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def verdicts(spark, rows, labels, schema):
    found = toxicity.toxicity(spark.createDataFrame(rows, schema), labels, keep=("text",))
    return {(r.doc_id, r.text): r.predicted for r in found.collect()}


def test_copies_of_toxic_texts_change_nothing(spark):
    """Each toxic text twice, three and four times, under fresh ids that training sees: as many held-out ones are caught, and how many copies there are changes no verdict."""
    docs, labels = (ship(spark).read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows, schema = [tuple(r) for r in docs.collect()], docs.schema
    toxic = {r.doc_id for r in labels.collect() if r.toxic}
    before = verdicts(spark, rows, labels, schema)
    out = [(r[0], r[1]) for r in rows if held(r[0]) and r[0] in toxic]
    assert out and any(before[k] for k in out)
    by_copies = []
    for copies in (1, 2, 3):
        fresh = [k for k in range(10_000, 30_000) if not held(k)]
        again = [(fresh.pop(), *r[1:]) for r in rows if r[0] in toxic or before[r[0], r[1]] for _ in range(copies)]
        after = verdicts(spark, rows + again, labels, schema)
        by_text = {t: v for (_, t), v in after.items()}
        assert all(by_text[t] == v for (_, t), v in after.items())
        assert [after[k] for k in out] == [before[k] for k in out]
        assert [after[r[0], r[1]] for r in rows if r[0] in toxic] == [before[r[0], r[1]] for r in rows if r[0] in toxic]
        by_copies.append({k: v for k, v in after.items() if k in before})
    assert by_copies[0] == by_copies[1] == by_copies[2]


def test_columns_that_clash(spark):
    docs, labels = (ship(spark).read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    more = docs.withColumns({c: F.lit(7) for c in ("id", "y", "k1", "k2", "x", "score", "term", "toxic")})
    shown = lambda d: sorted((r.doc_id, r.score) for r in toxicity.toxicity(d, labels.withColumns({"id": F.lit(1), "k1": F.lit(2)})).collect())
    assert shown(more) == shown(docs)


def test_one_row_of_an_id_and_of_a_text(spark):
    docs = ship(spark).createDataFrame([(1, "a")] * 300 + [(1, "b"), (2, "a"), (3, None), (4, ""), (None, "z")], "doc_id long, text string")
    chosen = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (3, 0), (4, 0), (3, 0)], "id long, y int")
    got = sorted((r.y, r.text or "", r.id) for r in labelled.sampled_rows(docs, chosen, "doc_id", "text").collect())
    assert [g for g in got if g[0] == 0] == [(0, "", 3), (0, "a", 2)]
    ones = [g for g in got if g[0] == 1]
    assert ones in ([(1, "a", 1)], [(1, "a", 2), (1, "b", 1)])


def test_terms_told_by_a_plain_loop():
    rng = np.random.default_rng(3)
    n_p, n_u, prior = 40, 900, 0.06
    positive = np.stack([rng.integers(3, 40, 200), rng.random(200) * 20]).astype(float)
    other = np.stack([rng.integers(0, 900, 200), rng.random(200) * 60]).astype(float)
    want = []
    for k in range(200):
        a, b = positive[0, k] / n_p, other[0, k] / n_u
        both = (positive[0, k] + other[0, k]) / (n_p + n_u)
        error = max(both * (1 - both), 1e-12) ** 0.5 * (1 / n_p + 1 / n_u) ** 0.5
        want.append(a - b >= 4 * error and prior * positive[1, k] / n_p >= (1 - prior) * other[1, k] / n_u)
    assert toxicity.told(positive, other, n_p, n_u, prior, 4.0).tolist() == want and 0 < sum(want) < 200


def test_sums_count_each_text_once(spark):
    texts = ["Bad words here", "bad words", "fine words here today", "bad words", "bad words", "", None, "fine words here today"]
    rows = ship(spark).createDataFrame([(t,) for t in texts], "text string").select(*labelled.text_key(), "text")
    want: dict[int, list[float]] = {}
    for t in {t or "" for t in texts}:
        data = np.frombuffer(t.encode(), np.uint8)
        term, count, _, words = toxicity._terms(data, np.array([0, len(data)]))
        for x, c in zip(term.tolist(), count.tolist(), strict=True):
            seen = want.setdefault(x, [0.0, 0.0])
            seen[0] += 1
            seen[1] += min(1.0, toxicity.FULL * c / max(words[0], 1))
    got = toxicity._sums(rows)
    assert got.pop(-1)[0] == 4
    assert {k: (round(a, 9), round(b, 9)) for k, (a, b) in got.items()} == {k: (round(a, 9), round(b, 9)) for k, (a, b) in want.items()}


def test_risk_by_a_plain_loop():
    """The first Adam steps of the non-negative risk, term by term, give the same weights and bias."""
    rng = np.random.default_rng(5)
    text = lambda terms: np.array([50, *terms, *rng.integers(1, 4, len(terms))], np.int32)
    positive = [text(sorted(rng.choice(12, 5, replace=False))) for _ in range(6)]
    unlabelled = [text(sorted(rng.choice(20, 4, replace=False))) for _ in range(15)]
    prior, rate, decay, rounds = 0.3, 0.05, 1e-4, 25
    weights, bias = toxicity.fit(positive, unlabelled, prior, rounds=rounds)
    rows = [({int(t): min(1.0, toxicity.FULL * int(c) / x[0]) for t, c in zip(x[1 : 1 + len(x) // 2], x[1 + len(x) // 2 :], strict=True)}, k < len(positive)) for k, x in enumerate(positive + unlabelled)]
    w = {(f, t): 0.0 for r, _ in rows for t in r for f in (0, 1)}
    m, v, b, mb, vb = dict.fromkeys(w, 0.0), dict.fromkeys(w, 0.0), float(np.log(prior / (1 - prior))), 0.0, 0.0
    n_p, n_u = len(positive), len(unlabelled)
    for step in range(1, rounds + 1):
        g = [b + sum(w[0, t] + w[1, t] * d for t, d in r.items()) for r, _ in rows]
        s = [1 / (1 + np.exp(-x)) for x in g]
        bracket = sum(np.log1p(np.exp(x)) for x, (_, y) in zip(g, rows, strict=True) if not y) / n_u - prior * sum(np.log1p(np.exp(x)) for x, (_, y) in zip(g, rows, strict=True) if y) / n_p
        slope = [(prior * (p - 1) / n_p if y else 0.0) + (-prior * p / n_p if y else p / n_u) if bracket >= 0 else (prior * p / n_p if y else -p / n_u) for p, (_, y) in zip(s, rows, strict=True)]
        for key in w:
            up = sum(e * (r[key[1]] if key[0] else 1.0) for e, (r, _) in zip(slope, rows, strict=True) if key[1] in r) + decay * w[key]
            m[key], v[key] = 0.9 * m[key] + 0.1 * up, 0.999 * v[key] + 0.001 * up * up
            w[key] = max(0.0, w[key] - rate * m[key] / (1 - 0.9**step) / ((v[key] / (1 - 0.999**step)) ** 0.5 + 1e-8))
        up = sum(slope)
        mb, vb = 0.9 * mb + 0.1 * up, 0.999 * vb + 0.001 * up * up
        b -= rate * mb / (1 - 0.9**step) / ((vb / (1 - 0.999**step)) ** 0.5 + 1e-8)
    assert abs(bias - b) < 1e-9
    assert all(abs(weights[f, t] - x) < 1e-9 for (f, t), x in w.items())
