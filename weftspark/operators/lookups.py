"""Draws of values from a look-up table, with or without weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.functions import rng
from weftspark.operators.ordered import range_lookup, running


def weight_ranges(table: DataFrame, order: list[str], weight: str | None = None) -> DataFrame:
    """``table`` with its part of the unit interval, [_low, _high): by weight, in ``order``.

    Rows of null, negative or zero weight have no part. ``order`` tells all rows apart.
    """
    w = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    weighed = table.withColumn("_w", w).where(F.col("_w") > 0)
    # Sums of decimals do not depend on how the rows are dealt.
    weighed = weighed.withColumn("_w", F.col("_w").cast("decimal(28,9)"))
    summed = running(weighed, order, ["_w"])
    total = weighed.agg(F.sum("_w").alias("_t"))
    whole = F.col("_t").cast("double")
    low = (F.col("run__w") - F.col("_w")).cast("double") / whole
    # The last part ends beyond 1, so that no draw falls behind it.
    high = F.when(F.col("run__w") == F.col("_t"), 2.0).otherwise(F.col("run__w").cast("double") / whole)
    return summed.join(F.broadcast(total)).select(*table.columns, low.alias("_low"), high.alias("_high"))


def draw_from(
    rows: DataFrame, key: str, table: DataFrame, take: list[str], order: list[str], weight: str | None = None, seed: int = 7, stream: str = "lookup"
) -> DataFrame:
    """``rows`` with the columns ``take`` of a row of ``table`` drawn with replacement by ``weight``.

    A draw hangs on the seed, the stream and the row's ``key`` alone. Without a row of weight above
    0 all values are null. A column of ``rows`` that is named like a taken one is replaced.
    """
    rest = rows.drop(*take)
    drawn = rest.withColumn("_u", rng.digest01(seed, stream, F.col(key)))
    return range_lookup(drawn, "_u", weight_ranges(table, order, weight), "_low", "_high", take).drop("_u")


def sample_from(table: DataFrame, n: int, order: list[str], weight: str | None = None, seed: int = 7) -> DataFrame:
    """n draws of whole rows of ``table``, with replacement, numbered in ``draw``."""
    rows = table.sparkSession.range(n).withColumnRenamed("id", "draw")
    return draw_from(rows, "draw", table, table.columns, order, weight, seed)
