"""Line dedup: explode normalised lines, hash them, count documents per hash, drop, reassemble.

Only hashes, ids and positions are shuffled for the counting; a text is moved once, when it
meets the positions of its own dropped lines. A line that a third of all documents share is
one row per task after partial aggregation. The shared hashes are written before the join that
finds their places: both of its sides are then plain exchanges, so adaptive execution splits
the partition of such a line (it can't where one side is what an aggregation left).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.llm.shared import SPACE, ascii_lower, join_null_safe, written


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 10,
    min_docs: int = 2,
) -> DataFrame:
    """All columns of ``docs`` with the kept text, and ``n_lines`` and ``n_dropped``.

    A key of at least ``min_chars`` code points that occurs in at least ``min_docs``
    documents loses all its lines but those of the smallest id that holds it.

    * A null or empty text is one empty line and stays as "".
    * A null id counts as one more document, after all others.
    * Rows that repeat an id count as one document; each row keeps its own lines.
    * Keys are equal where two 64-bit hashes of them are: exact but for collisions of both.
    * Very long texts are handled whole: lines are rows, and a text's dropped ones a byte each.
    * Names that clash with the helper columns are no problem: these begin with ``_ld_``.
    * An empty table gives an empty table.
    """
    base = docs.withColumns({
        "_ld_text": F.coalesce(F.col(text_col), F.lit("")),
        "_ld_doc": F.col(id_col).cast("long"),
    }).withColumn("_ld_row", F.xxhash64("_ld_text"))

    lines = (
        base.select("_ld_doc", "_ld_row", F.posexplode(F.split("_ld_text", "\n", -1)).alias("_ld_pos", "_ld_line"))
        .withColumn("_ld_key", line_key(F.col("_ld_line")))
        .where(F.char_length("_ld_key") >= min_chars)
        .select(
            F.xxhash64("_ld_key").alias("_ld_h1"),
            F.xxhash64(F.lit(7), "_ld_key").alias("_ld_h2"),
            "_ld_doc", "_ld_row", "_ld_pos",
        )
    )
    by = ["_ld_h1", "_ld_h2"]
    least, anonymous = F.min("_ld_doc").alias("_ld_first"), F.max(F.col("_ld_doc").isNull()).alias("_ld_none")
    if min_docs <= 2:  # two distinct documents: the least is not the greatest, or one has no id
        seen = lines.groupBy(*by).agg(least, F.max("_ld_doc").alias("_ld_last"), anonymous)
        two = (F.col("_ld_first") < F.col("_ld_last")) | (F.col("_ld_first").isNotNull() & F.col("_ld_none"))
        shared = seen.where(two if min_docs == 2 else F.lit(True))
    else:
        seen = lines.select(*by, "_ld_doc").distinct().groupBy(*by)
        shared = seen.agg(least, F.count("*").alias("_ld_n")).where(F.col("_ld_n") >= min_docs)
    shared = written(shared.where(F.col("_ld_first").isNotNull()).select(*by, "_ld_first"), "shared-lines")
    dropped = (
        lines.join(shared, by)
        .where(F.col("_ld_doc").isNull() | (F.col("_ld_doc") > F.col("_ld_first")))
        .groupBy("_ld_doc", "_ld_row")
        .agg(F.array_sort(F.collect_set("_ld_pos")).alias("_ld_gone"))
    )
    # One byte per line up to the last dropped one: a look-up by position costs the same anywhere.
    before = lambda i: F.when(i > 0, F.get(F.col("_ld_gone"), i - 1)).otherwise(F.lit(-1))
    gap = F.transform("_ld_gone", lambda p, i: F.concat(F.repeat(F.lit("0"), p - before(i) - 1), F.lit("1")))
    masks = dropped.select("_ld_doc", "_ld_row", F.size("_ld_gone").alias("_ld_n_gone"),
                           F.array_join(gap, "").cast("binary").alias("_ld_mask"))

    kept = F.array_join(
        F.filter(
            F.split("_ld_text", "\n", -1),
            lambda _, i: F.coalesce(F.substring(F.col("_ld_mask"), i + 1, F.lit(1)), F.lit(b"")) != F.lit(b"1"),
        ),
        "\n",
    )
    n_lines = F.char_length("_ld_text") - F.char_length(F.replace(F.col("_ld_text"), F.lit("\n"), F.lit(""))) + 1
    out = [F.col(c) for c in docs.columns if c not in (text_col, "n_lines", "n_dropped")]
    return join_null_safe(base, masks, ["_ld_doc", "_ld_row"], "left").select(
        *out,
        F.when(F.col("_ld_mask").isNull(), F.col("_ld_text")).otherwise(kept).alias(text_col),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce("_ld_n_gone", F.lit(0)).cast("long").alias("n_dropped"),
    )
