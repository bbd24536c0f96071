"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time; its integral is the source's share.
The cumulative demand of a source, inverted, says when its n-th word is due, so a document's
place in its source's stream gives its training position, and documents are range-sorted
by position. All of it is DataFrame work.

A source may hold a third of all rows, so the stream of a source is cut into buckets by the
leading digits of the order hash: sums per bucket, a prefix over at most 16**bucket_digits
buckets of a source, and a running sum inside each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftspark.llm.shared import WORD, join_null_safe, written

#: Slope of the schedule for weights 1, 2, 3: weight(t) = weight * (1 + slope * (2t - 1)).
SLOPES = (-0.5, 0.0, 0.5)
MOST_PASSES = 3


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """One row per source: its size, weight, schedule slope and target.

    ``sized`` has _mx_source and _mx_size. Targets fill up by weight and stop at
    MOST_PASSES times a source's size; what is over is shared again by weight. The level at
    which that ends is found from the sources in order of (limit / weight). Windows run over
    one row per source.
    """
    per = sized.groupBy("_mx_source").agg(F.sum("_mx_size").alias("_mx_s"))
    by_name = W.orderBy(F.col("_mx_source").asc_nulls_last())
    rank = F.row_number().over(by_name) - 1
    per = per.select("*", (rank % 3 + 1).cast("long").alias("_mx_w"), (F.col("_mx_s") * MOST_PASSES).alias("_mx_cap"))
    per = per.withColumn("_mx_at", F.col("_mx_cap") / F.col("_mx_w"))
    by_level = W.orderBy("_mx_at", F.col("_mx_source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    over_all = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumns({
        "_mx_full": F.coalesce(F.sum("_mx_cap").over(by_level), F.lit(0)),
        "_mx_below": F.coalesce(F.sum("_mx_w").over(by_level), F.lit(0)),
        "_mx_total": F.sum("_mx_s").over(over_all),
        "_mx_weights": F.sum("_mx_w").over(over_all),
    })
    per = per.withColumn(
        "_mx_level", (F.col("_mx_total") - F.col("_mx_full")).cast("double") / (F.col("_mx_weights") - F.col("_mx_below"))
    )
    reached = F.max(F.when(F.col("_mx_level") <= F.col("_mx_at"), F.col("_mx_level"))).over(over_all)
    slope = F.element_at(F.array(*map(F.lit, SLOPES)), F.col("_mx_w").cast("int"))
    return per.select(
        "_mx_source", "_mx_s", "_mx_w", "_mx_total", slope.alias("_mx_slope"),
        F.least(F.col("_mx_cap").cast("double"), F.col("_mx_w") * F.coalesce(reached, F.lit(0.0))).alias("_mx_target"),
    )


def due(done: Column, slope: Column) -> Column:
    """The time at which the share ``done`` of a source's words has been asked for.

    The integral of 1 + slope * (2t - 1) from 0 to t is (1 - slope) t + slope t^2.
    """
    at = 1 - slope
    root = (F.sqrt(at * at + 4 * slope * done) - at) / (2 * slope)
    return F.when(slope == 0, done).otherwise(root)


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    bucket_digits: int = 3,
) -> DataFrame:
    """One row per row of ``docs``: its id, ``row_key``, size, source_size, target, copies, taken, position.

    Every document is taken floor(target / source size) times; one more time, in the order of
    the hash of its id, while the words fit into what is left; and the last gap goes to the
    document whose size is nearest to it, if that brings the sum nearer. ``position`` is the
    training time of the first copy in words of the whole mix (null where nothing is taken).

    * A null text has size 0; size 0 is taken 0 words. A null source is a source, the last one.
    * Null ids order by the hash of "". Equal ids order by size, then by the text's hash.
    * All texts empty: all targets are 0. An empty table gives an empty table.
    * Rows repeated whole are rows of their own. Very long texts are counted whole.
    * Columns of ``docs`` other than the three named are not looked at.
    """
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    sized = written(
        docs.select(
            F.col(id_col).alias("doc_id"), F.col(source_col).alias("_mx_source"),
            word_count(F.col(text_col)).alias("_mx_size"), key.alias("_mx_key"), F.xxhash64(text_col).alias("row_key"),
        ),
        "mix-sizes",
    ).withColumn("_mx_bucket", F.substring("_mx_key", 1, bucket_digits))
    sources = written(source_targets(sized), "mix-sources")

    # Distance of each bucket from the start of its source's stream.
    sums = sized.groupBy("_mx_source", "_mx_bucket").agg(F.sum("_mx_size").alias("_mx_sum"))
    ahead = W.partitionBy("_mx_source").orderBy("_mx_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("_mx_source", "_mx_bucket", F.coalesce(F.sum("_mx_sum").over(ahead), F.lit(0)).alias("_mx_off"))
    inside = (
        W.partitionBy("_mx_source", "_mx_bucket")
        .orderBy("_mx_key", "doc_id", "_mx_size", "row_key")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    run = sized.withColumn("_mx_in", F.coalesce(F.sum("_mx_size").over(inside), F.lit(0)))
    run = join_null_safe(run, starts, ["_mx_source", "_mx_bucket"])
    run = run.withColumn("_mx_start", F.col("_mx_off") + F.col("_mx_in"))
    run = join_null_safe(run, sources, ["_mx_source"])
    passes = F.when(F.col("_mx_s") > 0, F.floor(F.col("_mx_target") / F.col("_mx_s"))).otherwise(0).cast("long")
    run = run.withColumn("_mx_passes", passes)
    run = run.withColumn("_mx_rest", F.col("_mx_target") - F.col("_mx_passes") * F.col("_mx_s"))
    more = (F.col("_mx_size") > 0) & (F.col("_mx_start") + F.col("_mx_size") <= F.col("_mx_rest"))
    run = written(run.withColumn("_mx_more", more.cast("long")).drop("_mx_bucket", "_mx_in", "_mx_off"), "mix-runs")

    # The gap that whole documents leave, and the document that fills it best.
    gaps = run.groupBy("_mx_source").agg(
        (F.max("_mx_rest") - F.sum(F.col("_mx_more") * F.col("_mx_size"))).alias("_mx_gap")
    )
    off = F.abs(F.col("_mx_size") - F.col("_mx_gap"))
    last = (
        join_null_safe(run, gaps, ["_mx_source"])
        .where((F.col("_mx_more") == 0) & (F.col("_mx_size") > 0) & (off < F.col("_mx_gap")))
        .groupBy("_mx_source")
        .agg(F.min(F.struct(off.alias("off"), "_mx_start", "doc_id", "row_key")).alias("_mx_fill"))
    )
    words = (F.col("_mx_passes") + F.col("_mx_more")) * F.col("_mx_size")
    taken = run.groupBy("_mx_source").agg(F.sum(words).alias("_mx_taken"))
    ends = written(join_null_safe(taken, last, ["_mx_source"], "left"), "mix-ends")
    fills = (
        (F.col("_mx_start") == F.col("_mx_fill._mx_start"))
        & F.col("doc_id").eqNullSafe(F.col("_mx_fill.doc_id"))
        & (F.col("row_key") == F.col("_mx_fill.row_key"))
        & (F.col("_mx_size") > 0)
    )
    out = join_null_safe(run, ends, ["_mx_source"])
    out = out.withColumn("_mx_filler", F.coalesce(fills, F.lit(False)).cast("long"))
    out = out.withColumn("copies", F.col("_mx_passes") + F.col("_mx_more") + F.col("_mx_filler"))
    done = F.when(F.col("_mx_passes") + F.col("_mx_more") > 0, F.col("_mx_start")).otherwise(F.col("_mx_rest"))
    time = due(F.least(done / F.greatest("_mx_taken", F.lit(1)), F.lit(1.0)), F.col("_mx_slope"))
    live = (F.col("copies") > 0) & (F.col("_mx_size") > 0)
    return out.select(
        "doc_id", "row_key", F.col("_mx_source").alias("source"),
        F.col("_mx_size").alias("size"), F.col("_mx_s").alias("source_size"), F.col("_mx_target").alias("target"),
        F.when(live, F.col("copies")).otherwise(0).cast("long").alias("copies"),
        F.when(live, F.col("copies") * F.col("_mx_size")).otherwise(0).cast("long").alias("taken"),
        F.when(live, F.round(time * F.col("_mx_total"), 3)).alias("position"),
        F.col("_mx_s").alias("_mx_s"), F.col("_mx_taken").alias("_mx_taken"), F.col("_mx_start").alias("_mx_start"),
        F.col("_mx_slope").alias("_mx_slope"), F.col("_mx_total").alias("_mx_total"),
    )


def _numbered(rows: DataFrame, by: list[str], order: list[Column | str]) -> DataFrame:
    """``rows`` with ``_mx_number``, from 1 on among rows that are equal in ``by``."""
    return rows.withColumn("_mx_number", F.row_number().over(W.partitionBy(*by).orderBy(*order)))


def training_order(
    docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The rows of ``docs`` as often as the plan takes them, range-sorted by training position.

    Copy k of a document stands k source lengths behind its first copy in the source's stream.

    * Rows that repeat id, text and source are numbered, and so are their rows of the plan: each
      gets the copies of one of these. A null id, text or source meets its like.
    * Other columns go through; names that begin with ``_mx_`` are the operator's own.
    """
    by = ["_mx_id", "_mx_row", "_mx_source"]
    hashed = {c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind} - {id_col, text_col, source_col}
    others = [F.col(f"`{c}`") for c in sorted(hashed)]
    keyed = docs.withColumns({"_mx_id": F.col(id_col), "_mx_row": F.xxhash64(text_col), "_mx_source": F.col(source_col)})
    keyed = _numbered(keyed, by, [F.xxhash64(F.lit(0), *others)])
    plan = plan.select(
        F.col("doc_id").alias("_mx_id"), F.col("row_key").alias("_mx_row"), F.col("source").alias("_mx_source"),
        "_mx_s", "_mx_taken", "_mx_start", "_mx_slope", "_mx_total", F.col("copies").alias("_mx_copies"),
    )
    plan = _numbered(plan, by, ["_mx_start", F.desc("_mx_copies")]).where(F.col("_mx_copies") > 0)
    joined = join_null_safe(keyed, plan, [*by, "_mx_number"])
    joined = joined.withColumn("_mx_copy", F.explode(F.sequence(F.lit(0), (F.col("_mx_copies") - 1).cast("int"))))
    done = F.least((F.col("_mx_start") + F.col("_mx_copy") * F.col("_mx_s")) / F.greatest("_mx_taken", F.lit(1)), F.lit(1.0))
    joined = joined.withColumn("_mx_position", due(done, F.col("_mx_slope")) * F.col("_mx_total"))
    return joined.orderBy("_mx_position", "_mx_id", "_mx_row", "_mx_copy").select(*docs.columns)
