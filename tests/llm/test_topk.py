"""The dual-tree search against whole comparison, with many groups, ties, copies, and awkward vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeflow.llm import topk
from placeflow.session import ship

SCHEMA = "vec_id long, embedding array<double>, label int, row long, id long, e string, part int, x int, score int, rank int"


def expected(rows, asks, k=10):
    """By whole numbers of any size."""
    fine = [(i, [int(np.floor(1024 * x)) if abs(x) < 2**40 else int(x) * 1024 for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, v in fine:
        if asks(i):
            best = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), j) for j, w in fine if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def found(spark, rows, step=1, k=10, **parts):
    vectors = ship(spark).createDataFrame([(i, v, 1, 2, 3, "e", 4, 5, 6, 7) for i, v in rows], SCHEMA)
    return sorted(map(tuple, topk.top_k(vectors, F.col("vec_id") % step == 0, k=k).collect()))


def clustered(seed, n, d=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, d))
    return [(int(i), (centres[i % 7] + rng.normal(size=d) * 0.05).tolist()) for i in rng.permutation(n)]


@pytest.mark.parametrize("sizes", [(16384, 4096), (60, 20)])
def test_clusters_ties_and_copies(spark, monkeypatch, sizes):
    monkeypatch.setattr(topk, "ROWS", sizes[0])
    monkeypatch.setattr(topk, "QUERIES", sizes[1])
    rows = clustered(1, 500)
    rows += [(1000 + k, rows[0][1]) for k in range(150)]  # a hot group of equal vectors
    rows += [(5000 + k, [float(round(x)) for x in v]) for k, (_, v) in enumerate(rows[:60])]
    assert found(spark, rows, 5) == expected(rows, lambda i: i % 5 == 0)


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (1, []), (2, [nan, 1.0]), (3, [inf]), (4, [None, 1.0]), (None, [1.0, 2.0]), (5, [0.0, 0.0, 0.0]), (6, [1.0]), (7, [-1.5, 2.25]), (8, [0.0004, -0.0004, 3.0]), (9, [1.0]), (9, [1.0]), (9, [2.0, 2.0])]
    assert found(spark, rows) == expected(rows, lambda i: True)
    assert found(spark, rows, k=2) == expected(rows, lambda i: True, 2)
    assert found(spark, [(1, [1.0])]) == [] and found(spark, rows[:1]) == []


def test_very_large_components(spark):
    rows = [(1, [1e9, 1.0]), (2, [-1e9, 3.0]), (3, [1e15, 1e15]), (4, [1e-9, 1e200]), (5, [0.5, 0.25]), (6, [2.0**52 + 1, 1.0])]
    assert found(spark, rows) == expected(rows, lambda i: True)
    assert found(spark, rows[:2] + rows[4:5]) == expected(rows[:2] + rows[4:5], lambda i: True)


def test_search_prunes_and_equals_brute_force():
    rows = clustered(3, 30000)
    x, ids = topk.whole(np.array([v for _, v in rows])), np.array([i for i, _ in rows])
    q = np.flatnonzero(ids % 50 == 0)
    seen = []
    best_take = topk.Best.take
    topk.Best.take = lambda self, r, s, i, o: (seen.append(s.size), best_take(self, r, s, i, o))[1]
    try:
        best = topk.search(x[q], ids[q], x, ids, 10)
    finally:
        topk.Best.take = best_take
    scores = x[q] @ x.T
    scores[ids[q][:, None] == ids] = -np.inf
    for r in range(len(q)):
        o = np.lexsort((ids, -scores[r]))[:10]
        assert best.id[r].tolist() == ids[o].tolist() and best.score[r].tolist() == scores[r][o].tolist()
    assert sum(seen) < 0.5 * len(q) * len(x)


def test_tree_covers():
    x = topk.whole(np.random.default_rng(4).normal(size=(3000, 5)))
    t = topk.CoverTree(x)
    assert sorted(t.order.tolist()) == list(range(3000))
    for node in range(len(t.radius)):
        a, b = t.span[node]
        assert np.sqrt(((x[t.order[a:b]] - t.centre[node]) ** 2).sum(1)).max() <= t.radius[node]
        kids = range(*t.kids[node])
        assert not kids or [t.span[kids[0]][0], t.span[kids[-1]][1]] == [a, b]
