"""From documents to packed training sequences: toxicity, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as Parquet
before the next one reads it. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeflow.llm.common import WORD, Scratch, temporary
from placeflow.llm.mixing import mix_sources
from placeflow.llm.neardup import near_duplicates
from placeflow.llm.packing import pack
from placeflow.llm.queries import tokenizer_path
from placeflow.llm.secrets import redacted, scan
from placeflow.llm.toxicity import toxicity
from placeflow.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
OWN = ("text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, each row by its own text, whatever its doc_id (null, or shared). Null text has no words."""
    return toxicity(docs, ship(spark).read.parquet(f"{sf_dir}/labels.parquet"), keep=OWN).filter("predicted = 0").select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (a similarity of 0.8 or more), the one with the least doc_id.

    Rows that share a doc_id are judged each by itself, under two hashes of the whole row; of equal rows one stays.
    Rows without a doc_id all stay. Texts without words are near nothing. Texts are shuffled once, by row.
    """
    scratch = Scratch(ship(spark))
    parts = [*COLUMNS, *[F.col(c).isNull() for c in COLUMNS]]
    rows = docs.select(*COLUMNS).filter("doc_id is not null").withColumn("row", F.xxhash64(*parts)).withColumn("row2", F.xxhash64(F.lit(1), *parts))
    found = scratch.save(near_duplicates(rows, "row", percent=80).select("row", "component_id").distinct())
    several = found.filter("row <> component_id").select("component_id").distinct()
    linked = found.join(several, "component_id", "left_semi").join(rows.select("row", "doc_id").distinct(), "row")
    linked = scratch.save(linked)
    first = linked.groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("first.row")
    gone = linked.select("row").join(first, "row", "left_anti")
    once = rows.join(gone, "row", "left_anti").dropDuplicates(["row", "row2"])
    return once.select(COLUMNS).unionByName(docs.select(COLUMNS).filter("doc_id is null"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its secrets replaced by a mark, whatever its doc_id (null, or shared); n_chars counts the new text's characters where it changed. Null text stays null."""
    pair = lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))
    spans = F.concat(F.transform("base", pair), F.transform("random", pair))
    found = scan(docs, keep=OWN).withColumn("spans", spans)
    clean = found.withColumn("text", F.when(F.size("spans") > 0, redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text")))
    return clean.withColumn("n_chars", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one at a source's cut gives the words that still fit.

    Each row is taken by its own place, whatever its doc_id (null, or shared). Rows without words are taken never.
    """
    rows = mix_sources(docs, keep=("text", "lang", "n_chars")).filter("taken > 0")
    left = F.col("taken") % F.col("size")
    copies = F.explode(F.concat(F.array_repeat(F.lit(0).cast("long"), F.floor(F.col("taken") / F.col("size")).cast("int")), F.filter(F.array(left), lambda x: x > 0)))
    rows = rows.withColumn("words", copies)
    part = F.when(F.col("words") == 0, F.col("text")).otherwise(F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD}[\\x20\\x09-\\x0D]*)"), F.lit(1)), 1, F.greatest(F.col("words"), F.lit(1)).cast("int")), ""))
    return rows.withColumn("text", part).withColumn("n_chars", F.when(F.col("words") == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows in sequences of at most 2048 tokens: doc_id (null stays, shared ones each have their pieces), piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", mask_secrets), ("mixing", mix), ("packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each written to the shared folder and read again."""
    scratch = Scratch(ship(spark))
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        with temporary():
            docs = scratch.save(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs


#: No SQL: the toxicity stage trains a model, and near duplicates need transitive groups; tests/llm holds each stage against brute force.
ORACLE_SQL = None
