"""Fill-in-the-middle against units by their own grammar in re, and exact round trips."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from placeflow.llm import middle
from placeflow.session import ship

SPACE = r"[\x20\x09-\x0D]"
UNITS = {"lines": r"[^\n]*\n|[^\n]+", "words": rf"{SPACE}*[^\x20\x09-\x0D]*{SPACE}+(?=[^\x20\x09-\x0D])|[\s\S]+", "paragraphs": r"[\s\S]*?\n(?=[^\n])|[\s\S]+", "sentences": r"[\s\S]*?(?:[.!?。！？](?=[\x20\x09-\x0D])|\n(?=[\s\S]))|[\s\S]+", "characters": r"[\s\S]"}
TEXTS = [None, "", "\n", "\n\n\n", "one line", "a\nb\nc", "a\r\nb c\x0b\x85d\n", "  x  y. z! w? ", "é😀\n😀é", "<P> is a mark\nhere", "<\nS>M>\nP>", "ends <", "a\n" * 5000, "x" * 50_000, "a.b. c\n\nd. e?\n"]


def expected(doc_id, text, seed=7, share=100, spm=50):
    text, h = text or "", hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    u = re.findall(UNITS["lines"], text)
    n = len(u)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= share:
        return (doc_id, n, "plain", None, None, text)
    a, b = sorted(h[k] % (n + 1) for k in (0, 1))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return (doc_id, n, form, p, m, f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}")


def table(spark):
    rows = [(None if k % 9 == 8 else k, TEXTS[k % len(TEXTS)], 1, "u", "p", 2, "f") for k in range(90)]
    return rows, ship(spark).createDataFrame(rows, "doc_id long, text string, n long, _u string, prefix string, _h0 int, form string")


@pytest.mark.parametrize("share, spm", [(100, 50), (60, 0), (0, 100)])
def test_forms(spark, share, spm):
    rows, docs = table(spark)
    out = middle.fill_in_middle(docs, share=share, spm=spm)
    got = out.select("doc_id", "n", "form", "prefix", "middle", "output").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(expected(i, t, share=share, spm=spm)) for i, t, *_ in rows)
    back = out.select("doc_id", middle.restored(F.col("output"), F.col("form")).alias("t"), F.col("prefix").isNull() == (F.col("form") == "plain"))
    assert sorted((repr(r[0]), r[1]) for r in back.collect()) == sorted((repr(i), t or "") for i, t, *_ in rows)
    assert all(r[2] for r in back.collect()) and middle.fill_in_middle(docs.limit(0)).count() == 0


@pytest.mark.parametrize("grammar", sorted(middle.GRAMMARS))
def test_grammars(spark, grammar):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab .\n!?é\t") for _ in range(rng.randrange(60))) for _ in range(200)]
    docs = ship(spark).createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in docs.select("t", middle.units(F.col("t"), grammar)).collect()]
    assert all("".join(u) == (t or "") for t, u in got)
    if grammar == "words":
        want = lambda t: [x for x in re.split(rf"(?<={SPACE})(?=[^\x20\x09-\x0D])", t)]
    else:
        want = lambda t: re.findall(UNITS[grammar], t)
    assert all(u == (want(t) if t else []) for t, u in got)


def test_marks():
    with pytest.raises(ValueError):
        middle.Marks("<P>", "<P>", "<M>")
    with pytest.raises(ValueError):
        middle.Marks("<P>", "<S<", "<M>")
    assert middle.Marks("|p", "|s", "|m").any() == r"\|p|\|s|\|m"
