"""Cosine similarity of texts by term weights, as a self-join over an inverted index.

Texts of equal terms are one class, held by the least id. A class enters the index with its rarest
terms only: as many as it takes that what is left of its vector cannot reach the threshold with
any other one. Two texts above the threshold then share an indexed term, so candidates come from
an equi-join on these, and only they are compared term by term.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A term: two or more letters, digits or low lines. (Fixed value.)
TERM = r"[\p{L}\p{N}_]{2,}"
#: Weight of a term that one of two texts holds, against 1 of one that both do: smoothed inverse
#: document frequency within the pair.
OWN = math.log(3 / 2) + 1


def term_counts(df: DataFrame, id_col: str, text_col: str, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(doc, term, tf): lower-cased terms of every text with their numbers."""
    terms = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(TERM), F.lit(0))
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.explode(terms).alias("term"))
    if stop_words:
        rows = rows.where(~F.col("term").isin(*stop_words))
    return rows.groupBy("doc", "term").agg(F.count("*").alias("tf"))


def _classes(counts: DataFrame) -> DataFrame:
    """(doc, rep): texts of equal terms and numbers have one ``rep``, the least of their ids.

    Equal by three sums over a text's terms, of two 64-bit hashes and of the numbers.
    """
    one, two = (F.xxhash64(F.lit(i), "term", "tf").cast("decimal(38,0)") for i in (1, 2))
    key = counts.groupBy("doc").agg(F.sum(one).alias("h1"), F.sum(two).alias("h2"), F.sum("tf").alias("n"))
    least = key.groupBy("h1", "h2", "n").agg(F.min("doc").alias("rep"))
    return key.join(least, ["h1", "h2", "n"]).select("doc", "rep")


def _reach(share: Column, weighting: str) -> Column:
    """Greatest squared cosine of a vector with one that shares no more than a part of it.

    ``share`` is the part of the squared length. With weights by pair what is not shared counts
    OWN times, so a part of the plain length is a smaller one of the weighted.
    """
    return share if weighting == "corpus" else share / (share + OWN * OWN * (1 - share))


def similar_texts(
    df: DataFrame, id_col: str = "id", text_col: str = "text", threshold: float = 0.4, weighting: str = "pair", stop_words: tuple[str, ...] = ()
) -> DataFrame:
    """(a, b, similarity): pairs of texts, a < b, whose cosine is above ``threshold`` (0 to below 1).

    ``weighting``: inverse document frequencies within each pair, as when two texts alone are
    compared, or within the whole corpus. Texts of equal terms are listed once, each with the
    least id of them (similarity 1), and only that one is compared with others. Null ids, null
    texts and texts without terms are like nothing. Rows that repeat an id are one text.
    """
    if weighting not in ("pair", "corpus") or not 0 <= threshold < 1:
        raise ValueError("weighting is pair or corpus, and threshold lies in [0, 1)")
    counts = term_counts(df, id_col, text_col, stop_words)
    classes = _classes(counts)
    copies = classes.where("doc <> rep").select(F.col("rep").alias("a"), F.col("doc").alias("b"), F.lit(1.0).alias("similarity"))
    own = counts.join(classes.where("doc = rep").select("doc"), "doc")
    frequency = own.groupBy("term").agg(F.count("*").alias("df"))
    vectors = own.join(frequency, "term")
    if weighting == "corpus":
        n = counts.agg(F.count_distinct("doc").alias("n"))
        # The frequencies of the corpus count all texts, copies too.
        frequency = counts.groupBy("term").agg(F.count("*").alias("all"))
        vectors = vectors.join(frequency, "term").join(F.broadcast(n))
        weight = F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("all"))) + 1)
    else:
        weight = F.col("tf").cast("double")
    vectors = vectors.select("doc", "term", "df", weight.alias("w"))

    rarest = W.partitionBy("doc").orderBy("df", "term")
    left = F.sum(F.col("w") * F.col("w")).over(rarest.rowsBetween(0, W.unboundedFollowing))
    whole = F.sum(F.col("w") * F.col("w")).over(W.partitionBy("doc"))
    indexed = vectors.where("df > 1").select("doc", "term")
    reaching = vectors.select("doc", "term", (left / whole).alias("share")).where(_reach(F.col("share"), weighting) > threshold * threshold - 1e-12)
    indexed = reaching.join(indexed, ["doc", "term"], "left_semi").select("doc", "term")
    pairs = indexed.withColumnRenamed("doc", "a").join(indexed.withColumnRenamed("doc", "b"), "term").where("a < b").select("a", "b").distinct()

    sums = vectors.groupBy("doc").agg(F.sum(F.col("w") * F.col("w")).alias("all"))
    side = lambda name: vectors.select(F.col("doc").alias(name), "term", F.col("w").alias(f"w{name}"))
    met = pairs.join(side("a"), "a").join(side("b"), ["b", "term"]).groupBy("a", "b").agg(
        F.sum(F.col("wa") * F.col("wb")).alias("dot"), F.sum(F.col("wa") * F.col("wa")).alias("ina"), F.sum(F.col("wb") * F.col("wb")).alias("inb")
    )
    met = met.join(sums.select(F.col("doc").alias("a"), F.col("all").alias("alla")), "a").join(sums.select(F.col("doc").alias("b"), F.col("all").alias("allb")), "b")
    length = lambda s: F.col(f"in{s}") + (1.0 if weighting == "corpus" else OWN * OWN) * (F.col(f"all{s}") - F.col(f"in{s}"))
    found = met.select("a", "b", F.least(F.lit(1.0), F.col("dot") / F.sqrt(length("a") * length("b"))).alias("similarity"))
    return found.where(F.col("similarity") > threshold).union(copies)


def is_diverse(df: DataFrame, id_col: str = "id", text_col: str = "text", threshold: float = 0.4, stop_words: tuple[str, ...] = ()) -> bool:
    """Whether no two texts are more alike than ``threshold``."""
    return not similar_texts(df, id_col, text_col, threshold, "pair", stop_words).limit(1).count()
