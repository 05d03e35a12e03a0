"""Fill-in-the-middle: texts cut between units of a grammar, and re-ordered so that a middle follows both its sides."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
#: A grammar says between which neighbours a unit ends: pairs of a class to the left and a class to the right, as insides of [...].
GRAMMARS = {
    "lines": ((r"\n", r"\s\S"),),
    "words": ((SPACE, rf"^{SPACE}"),),
    "paragraphs": ((r"\n", r"^\n"),),
    "sentences": ((r".!?。！？", rf"{SPACE}"), (r"\n", r"\s\S")),
    "characters": ((r"\s\S", r"\s\S"),),
}


def boundary(grammar: str) -> str:
    """A grammar as a regular expression without width: a look behind and a look ahead for each pair of neighbours."""
    return "|".join(f"(?<=[{left}])(?=[{right}])" for left, right in GRAMMARS[grammar])


def units(text: Column, grammar: str = "lines") -> Column:
    """The units of a text in order; joined they are the text. Null and empty text have none."""
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


@dataclass(frozen=True)
class Marks:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def any(self) -> str:
        return "|".join(re.escape(m) for m in (self.prefix, self.suffix, self.middle))

    def __post_init__(self) -> None:
        """A mark can't be found across the seam of a text and a mark: each starts with a character that none holds again."""
        first = self.prefix[:1]
        if len({self.prefix, self.suffix, self.middle}) < 3 or not first or any(not m.startswith(first) or first in m[1:] for m in (self.prefix, self.suffix, self.middle)):
            raise ValueError("marks must differ, start alike and hold their first character once")


def rearranged(form: Column, prefix: Column, middle: Column, suffix: Column, text: Column, marks: Marks) -> Column:
    p, s, m = (F.lit(x) for x in (marks.prefix, marks.suffix, marks.middle))
    return F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(form == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:  # noqa: B008
    """The text that an output was made of."""
    # what stands before the first mark is empty; an array of one cut makes it once
    text = lambda part: F.when(form == "psm", F.concat(part[1], part[3], part[2])).otherwise(F.concat(part[2], part[3], part[1]))
    return F.when(form == "plain", output).otherwise(F.transform(F.array(F.split(output, marks.any(), -1)), text)[0])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grammar: str = "lines", seed: int = 7, share: int = 100, spm: int = 50, marks: Marks = Marks()) -> DataFrame:  # noqa: B008
    """One row per input row: id, n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain), output.

    The cuts, whether a text is re-ordered at all (`share` of 100) and its form (`spm` of 100) come from the sha256 of
    `seed:id`, so every run gives the same rows. All expressions are Spark's own; nothing is shuffled.

    Null or empty text: no units, plain, output empty. A text that holds a mark stays plain. Null id: as an empty id.
    Repeated rows give equal rows. One unit: prefix or suffix may be empty, as may the middle. An empty table gives an
    empty result. Other columns are not read.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    h = [F.conv(F.substring("_h", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("_t"), digest.alias("_h"))
    rows = rows.select("_id", "_t", units(F.col("_t"), grammar).alias("_u"), *[x.alias(f"_h{k}") for k, x in enumerate(h)]).withColumn("_n", F.size("_u").cast("long"))
    cut = [F.col(f"_h{k}") % (F.col("_n") + 1) for k in (0, 1)]
    plain = (F.col("_t") == "") | F.col("_t").rlike(marks.any()) | (F.col("_h2") % 100 >= share)
    form = F.when(plain, "plain").when(F.col("_h3") % 100 < spm, "spm").otherwise("psm")
    rows = rows.select("_id", "_t", "_n", "_u", form.alias("_f"), F.least(*cut).cast("int").alias("_a"), F.greatest(*cut).cast("int").alias("_b"))
    part = lambda start, length: F.when(F.col("_f") != "plain", F.array_join(F.slice("_u", start, length), ""))
    one = F.lit(1)
    rows = rows.select("_id", "_t", "_n", "_f", part(one, F.col("_a")).alias("_p"), part(F.col("_a") + 1, F.col("_b") - F.col("_a")).alias("_m"), part(F.col("_b") + 1, F.greatest(F.size("_u") - F.col("_b"), F.lit(0))).alias("_s"))
    c = F.col
    return rows.select(c("_id").alias(id_col), c("_n").alias("n"), c("_f").alias("form"), c("_p").alias("prefix"), c("_m").alias("middle"), c("_s").alias("suffix"), rearranged(c("_f"), c("_p"), c("_m"), c("_s"), c("_t"), marks).alias("output"))


def digests(rows: DataFrame, id_col: str = "doc_id", marks: Marks = Marks()) -> DataFrame:  # noqa: B008
    chars = lambda c: F.length(c).cast("long").alias(f"{c}_chars")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(id_col, "n", "form", chars("prefix"), chars("middle"), sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"), marks)).alias("restored_sha256"))


ORACLE = r"""WITH h AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
c AS (SELECT *, len(u) AS n, ('0x' || d[1:8])::UBIGINT::BIGINT AS h1, ('0x' || d[9:16])::UBIGINT::BIGINT AS h2, ('0x' || d[25:32])::UBIGINT::BIGINT AS h4 FROM h),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
