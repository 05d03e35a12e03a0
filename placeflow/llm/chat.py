"""Preference formatting of conversation pairs. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _render(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit("<|end|>\n"))


def _completion(turns: Column, trained: str) -> tuple[Column, Column]:
    """The text of turns, and its trained spans: start:end in code points over what that role says."""
    text = F.array_join(F.transform(turns, _render), "")

    def step(acc: Column, turn: Column) -> Column:
        start = acc["at"] + F.length(turn["role"]) + 5
        end = start + F.length(turn["text"]) + F.length(F.lit("<|end|>"))
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(turn["role"] == trained, F.concat(acc["mask"], F.array(span))).otherwise(acc["mask"]).alias("mask"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("mask"))
    return text, F.array_join(F.aggregate(turns, start, step, lambda acc: acc["mask"]), ",")


def preference_pairs(turns: DataFrame, pair: Column, side: Column, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per pair: pair_id, chosen_id, rejected_id, n_chosen, n_rejected, n_common, prompt, and text and mask of both completions.

    `pair` names a turn's pair and `side` is 'chosen' or 'rejected'. The prompt is the longest common prefix
    of whole turns (role and text equal), rendered once; what follows on each side is a completion, whose
    mask lists the spans start:end (code points, end exclusive) that a loss should see: what `trained` says,
    with the closing mark. Turns take one shuffle; a row holds a conversation and nothing larger.

    Null role or text: empty. Null turn: before the others. Equal turn numbers: by role, then text. A turn
    with null pair or side belongs to no pair and is left out. A missing side has null id, no turns and an
    empty completion, and then nothing is common. Equal sides: all is prompt, both completions empty.
    """
    item = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = turns.select(pair.alias("pair_id"), side.alias("side"), F.col(id_col).alias("id"), item.alias("item")).filter("pair_id is not null and side is not null")
    of = lambda x: F.array_sort(F.collect_list(F.when(F.col("side") == x, F.col("item"))))
    ids = lambda x: F.min(F.when(F.col("side") == x, F.col("id")))
    both = rows.groupBy("pair_id").agg(ids("chosen").alias("chosen_id"), ids("rejected").alias("rejected_id"), of("chosen").alias("c"), of("rejected").alias("r"))
    same = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    n = F.array_position(F.concat(same, F.array(F.lit(False))), False).cast("int") - 1
    both = both.withColumn("n_common", n)
    tail = lambda x: F.slice(F.col(x), F.col("n_common") + 1, F.greatest(F.size(x) - F.col("n_common"), F.lit(0)))
    (chosen, chosen_mask), (rejected, rejected_mask) = _completion(tail("c"), trained), _completion(tail("r"), trained)
    prompt = F.array_join(F.transform(F.slice("c", 1, F.col("n_common")), _render), "")
    return both.select(
        "pair_id", "chosen_id", "rejected_id", F.size("c").alias("n_chosen"), F.size("r").alias("n_rejected"), "n_common",
        prompt.alias("prompt"), chosen.alias("chosen"), chosen_mask.alias("chosen_mask"), rejected.alias("rejected"), rejected_mask.alias("rejected_mask"),
    )


def consecutive(id_col: str = "conv_id") -> tuple[Column, Column]:
    """Pairs conversation 2k (chosen) with 2k + 1 (rejected)."""
    c = F.col(id_col)
    return F.shiftright(c.cast("long"), 1), F.when(c % 2 == 0, F.lit("chosen")).when(c.isNotNull(), F.lit("rejected"))


ORACLE = r"""
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT * FROM t WHERE side = 0), r AS (SELECT * FROM t WHERE side = 1),
p AS (SELECT pair_id, min(CASE WHEN side = 0 THEN conv_id END) AS chosen_id, min(CASE WHEN side = 1 THEN conv_id END) AS rejected_id,
    count(*) FILTER (side = 0)::INT AS n_chosen, count(*) FILTER (side = 1)::INT AS n_rejected FROM t GROUP BY pair_id),
m AS (SELECT p.pair_id, least(p.n_chosen, p.n_rejected, coalesce(min(CASE WHEN NOT (c.role = r.role AND c.text = r.text) THEN c.n - 1 END), 1000000000))::INT AS n_common
    FROM p LEFT JOIN c ON c.pair_id = p.pair_id LEFT JOIN r ON r.pair_id = p.pair_id AND r.n = c.n GROUP BY p.pair_id, p.n_chosen, p.n_rejected),
f AS (SELECT t.*, n_common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS turn_text FROM t JOIN m USING (pair_id)),
o AS (SELECT *, coalesce(sum(length(turn_text)) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM f WHERE n > n_common),
g AS (SELECT pair_id,
    coalesce(string_agg(turn_text, '' ORDER BY n) FILTER (side = 0), '') AS chosen, coalesce(string_agg(turn_text, '' ORDER BY n) FILTER (side = 1), '') AS rejected,
    coalesce(string_agg((start + length(role) + 5) || ':' || (start + length(turn_text) - 1), ',' ORDER BY n) FILTER (side = 0 AND role = 'assistant'), '') AS chosen_mask,
    coalesce(string_agg((start + length(role) + 5) || ':' || (start + length(turn_text) - 1), ',' ORDER BY n) FILTER (side = 1 AND role = 'assistant'), '') AS rejected_mask
    FROM o GROUP BY pair_id),
h AS (SELECT pair_id, string_agg(turn_text, '' ORDER BY n) AS prompt FROM f WHERE side = 0 AND n <= n_common GROUP BY pair_id)
SELECT p.pair_id, chosen_id, rejected_id, n_chosen, n_rejected, n_common, coalesce(prompt, '') AS prompt, coalesce(chosen, '') AS chosen,
  coalesce(chosen_mask, '') AS chosen_mask, coalesce(rejected, '') AS rejected, coalesce(rejected_mask, '') AS rejected_mask
FROM p JOIN m USING (pair_id) LEFT JOIN g USING (pair_id) LEFT JOIN h USING (pair_id)
"""
