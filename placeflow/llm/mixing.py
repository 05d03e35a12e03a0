"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size), null source last.

    Sources in code point order weigh `weights`, repeating. They share `share` times all words by weight; a
    target stops at `most` times its source, and the excess goes to the others until none is above. That is a
    water level: with sources in order of cap/weight, the level is (total - caps below) / weights not below,
    at the first source whose cap it doesn't exceed; up to there that quotient rises and then falls, so it is
    the greatest one. The table has a row per source, so one task orders it.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    k = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (k % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    total = Window.partitionBy(F.lit(0))
    w = w.withColumn("below", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    w = w.withColumn("level", (F.sum("source_size").over(total) * F.lit(share) - F.col("below")) / F.col("rest"))
    w = w.withColumn("level", F.max("level").over(total))
    return w.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, part: int = 20_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, size, source_size, target, taken (words the mix takes of it, repeats counted), source, then its own
    columns `keep`.

    A row's key is the md5 of its id and of its text's md5, so reruns agree and rows under one id, or none, are spread.
    Keys are range-partitioned into ranges of about `part` rows; sums of ranges, then sums within the range where a
    source's budget ends, give the words before each key, and no task holds a source. A source repeats whole epochs
    while its target covers them, then the words of one more up to its exact budget (the target rounded down); the row
    at the cut gives its first words. A cut is one key per source, so rows and their texts aren't shuffled: each
    compares its key with its source's cut. Sizes are counted once, or twice with `keep`.

    Null or empty text, or one without words: size 0, taken 0. Null source: a source, last. Null id: hashed as
    the text ''. Equal rows (id and text) that the cut meets share what is left evenly, rounded down. A source without
    words has target 0. Columns besides these are not read. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession)
    key = F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))).cast("binary"))
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"), *([F.struct(*keep).alias("own")] if keep else []))
    rows = scratch.save(sized.drop("own"))
    buckets = rows.count() // part + 1
    rows = rows.withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / 2**32).cast("int"))
    ranges = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size")).cast("long")).otherwise(F.lit(0))
    targets = scratch.save(targets.withColumn("whole", whole).withColumn("left", budget - whole * F.col("source_size")).withColumnRenamed("source", "s"))
    same = F.col("source").eqNullSafe(F.col("s"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0))).join(targets, same)
    ends = ranges.filter("before <= left and left < before + words").select("s", F.col("bucket").alias("b"), F.col("left") - F.col("before")).toDF("s", "b", "left")
    near = rows.filter("size > 0").join(ends, same & (F.col("bucket") == F.col("b"))).groupBy("s", "left", "key").agg(F.sum("size").alias("words"), F.count("*").alias("n"))
    within = Window.partitionBy("s").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("before", F.coalesce(F.sum("words").over(within), F.lit(0))).filter("before <= left and left < before + words")
    cuts = near.select("s", F.col("key").alias("cut"), F.floor((F.col("left") - F.col("before")) / F.col("n")).cast("long").alias("rest")).withColumnRenamed("s", "t")
    cuts = scratch.save(targets.join(cuts, F.col("s").eqNullSafe(F.col("t")), "left").drop("t", "left"))  # a row per source
    out = (sized if keep else rows).join(cuts, same)
    # without a cut, nothing of one more epoch is taken
    once = F.when(F.col("key") < F.col("cut"), F.col("size")).when(F.col("key") == F.col("cut"), F.least("rest", "size")).otherwise(F.lit(0))
    taken = F.col("whole") * F.col("size") + once
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", taken.cast("long").alias("taken"), F.col("source").alias(source_col), *(f"own.{c}" for c in keep))


#: DuckDB: one row per document with the columns of mix_sources, for the table {docs}.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS k FROM {docs}),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source),
r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM s),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * weight) AS target FROM l),
p AS (SELECT doc_id, size, d.source, source_size, target, floor(target)::BIGINT AS budget, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
   + least(greatest(budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before, 0), size))::BIGINT AS taken
FROM p
"""
