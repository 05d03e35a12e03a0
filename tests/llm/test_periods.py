"""Periodic runs against every period and start tried, on random sequences over few symbols and on awkward texts."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from placeflow.llm import periods
from placeflow.session import ship


def plain_runs(x, least=2):
    """All runs with their smallest period: for each period in order, maximal stretches of equal words that period apart."""
    n, seen, out = len(x), set(), []
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and x[j] == x[j + p]:
                j += 1
            if j - i >= p and (i, j + p) not in seen:
                seen.add((i, j + p))
                if j + p - i >= max(least, 2 * p):
                    out.append((i, j + p - i, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def found(sequences):
    bounds = np.cumsum([0, *map(len, sequences)])
    symbols = np.array([s for x in sequences for s in x], np.int64)
    out = [[] for _ in sequences]
    for d, *r in zip(*(a.tolist() for a in periods.runs(symbols, bounds)), strict=True):
        out[d].append(tuple(r))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=5))
def test_small_alphabets(sequences):
    assert found(sequences) == [plain_runs(s) for s in sequences]


@pytest.mark.parametrize("seed", range(6))
def test_powers_and_words_of_fibonacci(seed):
    rng = random.Random(seed)
    a, b = [0], [0, 1]
    while len(b) < 200:
        a, b = b, b + a
    some = [[rng.randrange(4) for _ in range(rng.randrange(1, 30))] * rng.randrange(1, 9) + [rng.randrange(2) for _ in range(20)] for _ in range(12)]
    sequences = [b, [7] * 150, [], [1], *some, list(range(100)) * 3]
    assert found(sequences) == [plain_runs(s) for s in sequences]


def test_large_positions():
    """Above the size up to which three numbers share one key, the same runs come out."""
    word = [1, 2, 3, 1, 2]
    sequences = [list(range(10, 10 + (1 << 21))), word * 9, [5] * 40]
    assert found(sequences)[1:] == [plain_runs(s) for s in sequences[1:]]
    assert found(sequences)[0] == []


def expected(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    rs = plain_runs(words, 12)
    drop = {i for s, length, p in rs for i in range(s + p, s + length)}
    best = min(rs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    top = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(rs), *top, sha("".join(f"{s},{length},{p}\n" for s, length, p in rs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_query_by_brute_force(spark):
    docs = ship(spark).read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r[0]: tuple(r[1:]) for r in periods.digests(periods.periodic_runs(docs, planted=10)).collect()}
    want = {r.doc_id: expected(r.doc_id, r.text) for r in docs.collect() if len((r.text or "").split()) <= 1500}
    assert len(want) > 150 and {k: got[k] for k in want} == want and len(got) == docs.count()


def test_awkward_texts(spark):
    texts = [None, "", " \t\n", "a", "a " * 11, "a " * 12, "é x \x0b" * 30, "x y " * 40 + "z", "no run here at all", "x y " * 40 + "z"]
    rows = [(k if k % 4 else None, t, 1, 2, 3, "r") for k, t in enumerate(texts)]
    docs = ship(spark).createDataFrame(rows, "doc_id long, text string, n long, _id long, start long, runs string")
    out = periods.digests(periods.periodic_runs(docs, planted=10))
    assert sorted(map(repr, (tuple(r) for r in out.collect()))) == sorted(repr((i, *expected(i, t))) for i, t, *_ in rows)
    assert periods.periodic_runs(docs.limit(0)).count() == 0
    one = periods.periodic_runs(docs.filter("n = 1")).filter("size(runs) > 0").collect()
    assert [(r.runs[0].start, r.runs[0].length, r.runs[0].period) for r in one if r.collapsed == "x y z"] == [(0, 80, 2)] * 2
