"""Secret spans: fixed patterns, and a battery of randomness tests on long tokens. DataFrame functions only."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BINS = 8  # of each unit of the logarithm of a p-value
PART = 256  # items of a text that are worked on together

# fixed values: the base patterns, and the least length of what each must hold
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

# fixed values: alphabets of encodings that a token may be in, narrowest first
ALPHABETS = {
    "letters": "abcdefghijklmnopqrstuvwxyz",
    "LETTERS": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
# a run of base64 letters that touches no - or _, else a run of base64url letters (so / ends it)
TOKEN = r"(?:(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/]{20,}+(?![_-])|(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+)"

# fixed values: per cent of each letter in written English
LETTERS = {
    "a": 8.2, "b": 1.5, "c": 2.8, "d": 4.3, "e": 12.7, "f": 2.2, "g": 2.0, "h": 6.1, "i": 7.0, "j": 0.15, "k": 0.77, "l": 4.0, "m": 2.4,
    "n": 6.7, "o": 7.5, "p": 1.9, "q": 0.095, "r": 6.0, "s": 6.3, "t": 9.1, "u": 2.8, "v": 0.98, "w": 2.4, "x": 0.15, "y": 2.0, "z": 0.074,
}
#: What the words and numbers that fit an encoding look like: shares of small letters, capitals, digits and marks, the chance that
#: a character begins another class, and the lag-one correlation of vowels (they alternate with consonants).
WRITTEN = {
    "letters": (1.0, 0.0, 0.0, 0.0, 1 / 20, -0.35), "LETTERS": (0.0, 1.0, 0.0, 0.0, 1 / 20, -0.35),
    "hex": (0.1, 0.0, 0.9, 0.0, 1 / 12, 0.0), "HEX": (0.0, 0.1, 0.9, 0.0, 1 / 12, 0.0),
    "base32": (0.0, 0.9, 0.1, 0.0, 1 / 20, -0.35), "BASE36": (0.0, 0.9, 0.1, 0.0, 1 / 20, -0.35), "base36": (0.9, 0.0, 0.1, 0.0, 1 / 20, -0.35),
    "base64": (0.8, 0.1, 0.1, 0.0, 1 / 6, -0.35), "base64url": (0.75, 0.08, 0.07, 0.1, 1 / 6, -0.35),
}
#: A character of another class than the one before it. A capital and the small letters after it, and a mark and what it joins, are one.
CHANGE = r"(?<=[a-z])[A-Z0-9+/_-]|(?<=[A-Z])[0-9+/_-]|(?<=[0-9])[A-Za-z+/_-]"


def character_class(c: str) -> int:
    """0 small letter, 1 capital, 2 digit, 3 mark."""
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def model(encoding: str) -> dict[str, float]:
    """Numbers of an encoding: its size k, sums of squares and cubes of characters' shares in writing, chances of a change of class in writing and under uniformity, and written vowels' correlation."""
    alphabet, (*shares, change, serial) = ALPHABETS[encoding], WRITTEN[encoding]
    kinds = [character_class(c) for c in alphabet]
    weight = [LETTERS[c.lower()] if c.isalpha() else 1.0 for c in alphabet]
    q = [shares[t] * w / sum(v for v, u in zip(weight, kinds, strict=True) if u == t) for t, w in zip(kinds, weight, strict=True)]
    q = [x / sum(q) for x in q]
    each = [kinds.count(t) / len(kinds) for t in range(4)]
    turns = sum(each[s] * each[t] for s in range(3) for t in range(4) if s != t and (s, t) != (1, 0))
    return {"k": float(len(alphabet)), "squares": sum(x**2 for x in q), "cubes": sum(x**3 for x in q), "change": change, "turns": turns, "serial": serial}


def _once(value: Column, f) -> Column:
    """f of a value that is worked out once for all its uses."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _parts(items: Column, f) -> Column:
    """f of each PART items of an array in order, as an array: work that grows with the square of an array's length stays within a part."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(items) - 1) / PART).cast("int"))), lambda k: _once(F.slice(items, k * PART + 1, F.lit(PART)), f))


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<s, e, value>> of a pattern's leftmost non-overlapping matches, in code points.

    A split at the matches leaves what lies between them, so running sums of lengths give the places; of many matches, the
    sums of parts come first.
    """
    none = F.expr("cast(array() as array<struct<s:int,e:int,value:string>>)")

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.length(x["value"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["value"].alias("value")))).alias("out"))

    def from_(at: Column, pairs: Column) -> Column:
        return F.aggregate(pairs, F.struct(at.cast("int").alias("at"), none.alias("out")), step, lambda acc: acc["out"])

    def long(pairs: Column) -> Column:
        sums = _parts(pairs, lambda p: F.aggregate(p, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.length(x["value"])))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        parts = _parts(pairs, lambda p: p)
        return _once(F.struct(starts.alias("at"), parts.alias("p")), lambda x: F.flatten(F.transform(x["p"], lambda p, k: from_(F.get(x["at"], k), p))))

    found = F.struct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("value"), F.split(text, pattern, -1).alias("gap"))
    pairs = _once(found, lambda x: F.arrays_zip(F.slice(x["gap"], 1, F.size(x["value"])).alias("gap"), x["value"].alias("value")))
    return _once(pairs, lambda p: F.when(F.size(p) <= PART, from_(F.lit(0), p)).otherwise(long(p)))


def _clear(tokens: Column, base: Column) -> Column:
    """The tokens that touch no base span; both are in order of their starts, so the tokens of a part meet the spans near them alone."""
    touches = lambda t, spans: F.exists(spans, lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"]))

    def part(p: Column, spans: Column) -> Column:
        ends = F.struct(F.element_at(p, 1)["s"].alias("s"), F.element_at(p, -1)["e"].alias("e"))
        near = _once(ends, lambda x: F.filter(spans, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
        return _once(near, lambda n: F.filter(p, lambda t: ~touches(t, n)))

    def long(x: Column) -> Column:
        return F.flatten(_parts(x["t"], lambda p: part(p, x["b"])))

    few = F.filter(tokens, lambda t: ~touches(t, base))
    return F.when((F.size(tokens) <= PART) | (F.size(base) == 0), few).otherwise(_once(F.struct(tokens.alias("t"), base.alias("b")), long))


def _found(text: Column, pattern: str, seen: str | None = None) -> Column:
    """_spans where a cheaper look finds anything, else an empty array."""
    return F.when(text.rlike(seen or pattern), _spans(text, pattern)).otherwise(F.expr("cast(array() as array<struct<s:int,e:int,value:string>>)"))


def base_spans(text: Column) -> dict[str, Column]:
    """Matches by kind that are long enough, the others dropped after matching."""
    assign = F.filter(_found(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["value"], ASSIGN, 1)) >= LEAST["assign"])
    access = F.filter(_found(text, ACCESS, r"AKIA[A-Z0-9]{16}"), lambda x: F.length(x["value"]) >= LEAST["access"])
    # runs of a class are maximal, so asking for the length in the pattern drops the same ones
    long_hex = _found(text, r"(?<![0-9a-f])[0-9a-f]{24,}+")
    return {"assign": assign, "access": access, "hex": long_hex}


def _upper_tail(z: Column) -> Column:
    """P(normal > z), by the logistic approximation with a cubic term (error below 0.0002)."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(1.5976) * z + F.lit(0.07056) * F.pow(z, F.lit(3.0))))


def battery(token: Column) -> Column:
    """struct<encoding, n, uniform, runs, serial, p_random, p_text> of a token, null where no alphabet holds all of it.

    Three statistics per inferred encoding: chi-squared over the alphabet, the number of runs of a class of
    characters, and the lag-one correlation of vowels. uniform, runs and serial are their two-sided p-values were
    the token drawn uniformly from the encoding; p_random is thrice the least. p_text is the p-value of all three
    against the alternative, that the token is writing (`WRITTEN`): the lower tail of chi-squared with the mean and
    variance that letters' shares give it, the upper binomial tail of the runs (by its large-deviation form), and
    the upper tail of the correlation, combined by Fisher's method. Length enters through the tests: the longer a
    random token, the further all three lie from writing.
    """
    fits = F.coalesce(*[F.when(token.rlike(f"^[{a.replace('-', '')}{'-' * ('-' in a)}]+$"), F.lit(k)) for k, a in ALPHABETS.items()])
    models = F.create_map(*[x for k in ALPHABETS for x in (F.lit(k), F.struct(*[F.lit(float(v)).alias(n) for n, v in model(k).items()]))])

    def tests(x: Column) -> Column:
        t, n, m = x["token"], x["n"].cast("double"), x["m"]
        k, s2, s3 = m["k"], m["squares"], m["cubes"]
        each = F.transform(F.array_distinct(F.split(t, "(?!^)")), lambda c: (F.length(t) - F.length(F.replace(t, c, F.lit("")))).cast("double"))
        chi = F.aggregate(each, F.lit(0.0), lambda s, c: s + c * c) * k / n - n
        # for few characters a cell the statistic is far from its limit law, but its moments are exact
        uniform = 2 * _upper_tail(F.abs((chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)))
        mean = k * (1 - s2) + n * (k * s2 - 1)
        var = k * k / n / n * 2 * n * (n - 1) * (s2 + 2 * (n - 2) * s3 - (2 * n - 3) * s2 * s2)
        chi_text = _upper_tail((mean - chi) / F.sqrt(var))
        gaps = n - 1
        turns, rate = F.regexp_count(t, F.lit(CHANGE)).cast("double"), m["turns"]
        runs = F.when(rate > 0, 2 * _upper_tail(F.abs(turns - gaps * rate) / F.sqrt(gaps * rate * (1 - rate)))).otherwise(F.lit(1.0))
        f, r = turns / gaps, m["change"]
        deviation = F.exp(-gaps * (f * F.log(f / r) + F.when(f < 1, (1 - f) * F.log((1 - f) / (1 - r))).otherwise(0.0)))
        sharp = F.when(f < 1, F.least(F.lit(1.0), 1 / ((1 - r * (1 - f) / (f * (1 - r))) * F.sqrt(6.283185307179586 * gaps * f * (1 - f))))).otherwise(1.0)
        runs_text = F.when(f > r, deviation * sharp).otherwise(F.lit(1.0))
        vowels = F.regexp_count(t, F.lit("[aeiouAEIOU]")).cast("double")
        pairs = F.regexp_count(t, F.lit("[aeiouAEIOU](?=[aeiouAEIOU])")).cast("double")
        ends = F.when(t.rlike("^[aeiouAEIOU]"), 1.0).otherwise(0.0) + F.when(t.rlike("[aeiouAEIOU]$"), 1.0).otherwise(0.0)
        share = vowels / n
        spread = vowels * (1 - share)
        by = F.when(spread > 0, (pairs - share * (2 * vowels - ends) + gaps * share * share) / spread).otherwise(F.lit(0.0))
        serial = 2 * _upper_tail(F.abs(by + 1 / n) * F.sqrt(n))
        serial_text = _upper_tail((by - m["serial"]) * F.sqrt(n))
        logs = -(F.log(F.greatest(chi_text, F.lit(1e-300))) + F.log(F.greatest(runs_text, F.lit(1e-300))) + F.log(F.greatest(serial_text, F.lit(1e-300))))
        p_text = F.exp(-logs) * (1 + logs + logs * logs / 2)
        return F.struct(x["encoding"].alias("encoding"), x["n"].alias("n"), uniform.alias("uniform"), runs.alias("runs"), serial.alias("serial"), F.least(F.lit(1.0), 3 * F.least(uniform, runs, serial)).alias("p_random"), p_text.alias("p_text"))

    x = F.struct(token.alias("token"), fits.alias("encoding"), F.length(token).alias("n"), F.element_at(models, fits).alias("m"))
    return F.when(fits.isNotNull(), F.element_at(F.transform(F.array(x), tests), 1))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.05, least_p: float = 0.001, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, base (array of kind, s, e by start and kind), random (array of s, e, p, encoding), then its own columns `keep`.

    Base spans come from the patterns. The method adds tokens of 20 characters or more that touch no base
    span, fit an inferred encoding, aren't refuted as drawn from it (p_random is at least `least_p`) and aren't
    writing at a false-discovery rate of `alpha` over the whole corpus: the battery's p-values against writing,
    to which length adds weight, fall into 1024 bins of their logarithm, and a count of the bins gives the
    Benjamini-Hochberg cut, rounded down to a bin. A token that no encoding holds (a path, say) counts as p = 1.

    Null or empty text: no spans. Rows are judged one by one, repeated ones alike. An empty table gives an
    empty result. Columns besides these are not read.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.expr("cast(array() as array<struct<s:int,e:int,value:string>>)")
    # a cheap look first: most texts hold nothing long or assigned
    own = [F.struct(*keep).alias("own")] if keep else []
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), *own)
    own = ["own"] if keep else []
    kinds = base_spans(F.col("text"))
    named = lambda k, o: lambda x: F.struct(x["s"].alias("s"), F.lit(o).alias("o"), x["e"].alias("e"), F.lit(k).alias("kind"))
    base = F.concat(*[F.transform(v, named(k, o)) for o, (k, v) in enumerate(kinds.items())])
    tokens = F.when(F.col("text").rlike(TOKEN), _spans(F.col("text"), TOKEN)).otherwise(none)
    rows = rows.select("id", F.array_sort(base).alias("base"), tokens.alias("tokens"), *own)
    rows = rows.select("id", "base", F.transform(_clear(F.col("tokens"), F.col("base")), lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"), battery(t["value"]).alias("b"))).alias("tokens"), *own)
    rows = scratch.save(rows)
    bin_ = lambda p: F.least(F.lit(1023), F.floor(-F.log(F.greatest(F.coalesce(p, F.lit(1.0)), F.lit(1e-300))) * BINS)).cast("int")
    counts = dict(rows.select(F.explode("tokens").alias("t")).groupBy(bin_(F.col("t.b.p_text")).alias("bin")).count().collect())  # at most 1024 rows
    total, seen, cut = sum(counts.values()), 0, 1024
    for b in sorted(counts, reverse=True):
        seen += counts[b]
        if exp(-b / BINS) <= alpha * seen / total:
            cut = b
    taken = F.filter("tokens", lambda t: F.coalesce((bin_(t["b"]["p_text"]) >= cut) & (t["b"]["p_random"] >= least_p), F.lit(False)))
    return rows.select(F.col("id").alias(id_col), "base", F.transform(taken, lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"), t["b"]["p_text"].alias("p"), t["b"]["encoding"].alias("encoding"))).alias("random"), *(f"own.{c}" for c in keep))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of the base spans and all spans as text."""
    show = lambda kind, x: F.concat_ws(":", kind, x["s"].cast("string"), x["e"].cast("string"))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.array_sort(F.concat(F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["o"].alias("o"), x["e"].alias("e"), x["kind"].alias("kind"))), F.transform("random", lambda x: F.struct(x["s"].alias("s"), F.lit(3).alias("o"), x["e"].alias("e"), F.lit("random").alias("kind")))))
    return found.select(
        id_col, count("assign"), count("access"), count("hex"),
        F.sha2(F.array_join(F.transform("base", lambda x: show(x["kind"], x)), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform(every, lambda x: show(x["kind"], x)), ",").alias("spans"),
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch covered by spans (s, e; any order, overlaps and touching ones count once) replaced by the mark.

    Of many spans, each part is cut from its own piece of the text.
    """

    def cut(t: Column, first: Column, at: Column, some: Column) -> Column:
        """The text t, which begins at place `first`, up to the end of its last span; what lies before `at` is gone already."""

        def step(acc: Column, x: Column) -> Column:
            begin = F.greatest(acc["at"], first)
            between = t.substr(begin - first + 1, F.greatest(x["s"] - begin, F.lit(0)))
            more = F.when(x["s"] > acc["at"], F.concat(acc["out"], between, F.lit(mark))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), more.alias("out"))

        return F.aggregate(some, F.struct(at.cast("int").alias("at"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    last = lambda some: F.aggregate(some, F.lit(-1), lambda n, x: F.greatest(n, x["e"]))
    rest = lambda at: text.substr(F.greatest(at, F.lit(0)) + 1, F.length(text))

    def long(some: Column) -> Column:
        ends = F.aggregate(_parts(some, last), F.array(F.lit(-1)), lambda acc, n: F.concat(acc, F.array(F.greatest(F.element_at(acc, -1), n))))

        def joined(x: Column) -> Column:
            def piece(p: Column, k: Column) -> Column:
                y = F.struct(F.get(x["ends"], k).alias("at"), F.greatest(F.get(x["ends"], k), F.lit(0)).alias("first"), F.get(x["ends"], k + 1).alias("end"))
                y = _once(y, lambda y: F.struct(y["at"].alias("at"), y["first"].alias("first"), text.substr(y["first"] + 1, y["end"] - y["first"]).alias("t")))
                return _once(y, lambda y: cut(y["t"], y["first"], y["at"], p))

            return F.concat(F.array_join(F.transform(x["p"], piece), ""), rest(F.element_at(x["ends"], -1)))

        return _once(F.struct(ends.alias("ends"), _parts(some, lambda p: p).alias("p")), joined)

    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))))
    short = lambda o: F.concat(cut(text, F.lit(0), F.lit(-1), o), rest(last(o)))
    return F.when(F.size(spans) > 0, _once(ordered, lambda o: F.when(F.size(o) <= PART, short(o)).otherwise(long(o)))).otherwise(text)
