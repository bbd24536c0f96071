"""Digest columns that the queries derive from the operators' outputs, and vocabulary files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm import sentence_pieces


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def piece_digests(docs: DataFrame) -> DataFrame:
    coded = sentence_pieces.encode_texts(docs, vocabulary("piece_bpe_32k.model"), keep=["doc_id"])
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
