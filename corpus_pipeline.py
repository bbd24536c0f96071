"""From raw documents to token ids: reject, dedup lines, dedup documents, mix, encode.

Every stage works on all rows that the one before kept. Stages hand on the columns of
``documents``; the last returns the digests of the encoded texts.

In all stages a null text counts as an empty one, very long texts are handled whole, further
columns go through, and an empty table gives an empty table. A null id is a document of its own
to the classifier, to near copies and to the mix; to line dedup all rows without an id are one
document, after all others. Rows that repeat an id are judged one by one, are one document to
line dedup and one group to near copies, so a single one of them stays; ties go to the least id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.llm import jaccard_join, line_dedup, mixing, quality
from weftspark.llm.digests import piece_digests
from weftspark.llm.shared import written


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior says low quality go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classify(docs, labels).where("keep").select(*docs.columns)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; ``n_chars`` follows the text."""
    kept = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one of least id stays; of rows that repeat an id, the one of least hash."""
    found = jaccard_join.jaccard_components(docs)
    gone = written(found.where("component_id <> doc_id").select("doc_id").distinct(), "pipeline-copies")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    again = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_rows")).where("_rows > 1")
    again = written(again.select("doc_id"), "pipeline-repeated")
    if not again.limit(1).count():
        return kept
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    least = kept.join(again, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*hashed)).alias("_row"))
    return kept.join(again, "doc_id", "left_anti").unionByName(least.select("_row.*"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return mixing.training_order(docs, mixing.plan_mix(docs))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the decoded text of every row."""
    return piece_digests(docs)


STAGES = [
    ("quality_classifier", reject_low_quality),
    ("line_dedup", drop_shared_lines),
    ("jaccard_join", drop_near_copies),
    ("source_mix", mix_sources),
    ("sentence_pieces", encode_pieces),
]

#: The classifier's fit, the order of the mix by its hash and the encoding are not SQL; the
#: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; between stages, tables in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
