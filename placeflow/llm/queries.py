"""The queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import chat, media, middle, mixing, neardup, packing, periods, quality, repeats, secrets, topk, toxicity
from . import embed as embedding


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_interleaved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a stored image, referred to by a page; the page is parsed and its reference resolved by digest."""
    stored = media.document_media(table(spark, sf_dir, "documents"))
    items = media.interleave(stored, stored, "doc_id", "html").filter("digest is not null")
    n_bytes = F.regexp_extract("caption", r"^(\d+) bytes$", 1).cast("long")
    return items.select("doc_id", n_bytes.alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.col("digest").alias("media_sha256"), "feature")


def op2_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op3_prefix_free_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("source")


def op8_indexed_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_pairs(table(spark, sf_dir, "conversations"), *chat.consecutive())


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.periodic_runs(table(spark, sf_dir, "documents"), planted=10))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digests(middle.fill_in_middle(table(spark, sf_dir, "documents")))


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_interleaved_media, op2_minhash_near_dup, op3_prefix_free_dedup, op4_best_fit_packing, op5_pu_toxicity, op6_secret_scan, op7_source_mixing, op8_indexed_quality, op9_cross_polytope, op10_preference_format, op11_periodic_runs, op12_fill_in_middle, op13_exact_top_k)}

ORACLE = {"op7_source_mixing": mixing.ORACLE.format(docs="documents"), "op10_preference_format": chat.ORACLE, "op12_fill_in_middle": middle.ORACLE, "op13_exact_top_k": topk.ORACLE}
