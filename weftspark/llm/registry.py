"""The queries of this subpackage, with their SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from weftspark.llm import fill_middle, importance, jaccard_join, line_dedup, media_store, mixing, page_text, quality, secret_scan, simhash, token_counts, vector_search
from weftspark.llm.digests import piece_digests, vocabulary
from weftspark.llm.sql import ORACLE


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_text(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op2_vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_k(_table(spark, sf_dir, "embeddings"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", *[F.round(c, 6).alias(c) for c in ("evidence", "site_prior", "posterior")], "keep")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.scan_secrets(_table(spark, sf_dir, "documents"))
    n = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return out.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(secret_scan.listed(F.col("base")), 256).alias("base_sha256"),
        secret_scan.listed(F.col("found")).alias("spans"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_multi_50k.tiktoken"), 50256)
    return out.select("doc_id", "n_tokens", "ordinal")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(_table(spark, sf_dir, "documents"))
    return plan.orderBy("position", "doc_id").select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "position"
    )


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(_table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op10_media_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_store.store_and_describe(_table(spark, sf_dir, "documents"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n", "form", F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_page_text": op1_page_text,
        "op2_vector_top_k": op2_vector_top_k,
        "op3_quality": op3_quality,
        "op4_secret_scan": op4_secret_scan,
        "op5_token_counts": op5_token_counts,
        "op6_line_dedup": op6_line_dedup,
        "op7_source_mix": op7_source_mix,
        "op8_sentence_pieces": op8_sentence_pieces,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_media_store": op10_media_store,
        "op11_simhash": op11_simhash,
        "op12_importance": op12_importance,
        "op13_fill_middle": op13_fill_middle,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
