"""Streaming forms of the rolling aggregates. An extension: the batch operators have no stream.

Windows are tumbling or sliding event-time windows with a watermark, so state is bounded by
the lateness allowed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AGGREGATES = {"mean": F.avg, "sum": F.sum, "count": F.count, "std": F.stddev_samp, "min": F.min, "max": F.max}


def windowed(
    stream: DataFrame, time: str, keys: list[str], aggregates: dict[str, tuple[str, str]], size: str, slide: str | None = None, late: str = "10 minutes"
) -> DataFrame:
    """Aggregates {name: (mean|sum|count|std|min|max, column)} per key and event-time window.

    The time column is cast to TIMESTAMP, as watermarks need it.
    """
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    window = F.window("_t", size, slide) if slide else F.window("_t", size)
    made = [AGGREGATES[kind](column).alias(name) for name, (kind, column) in aggregates.items()]
    out = timed.groupBy(window.alias("w"), *keys).agg(*made)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggregates)


def sessions(stream: DataFrame, time: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions per key: rows with gaps below ``gap``."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    out = timed.groupBy(F.session_window("_t", gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


def first_seen(stream: DataFrame, time: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark: streaming de-duplication."""
    timed = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.dropDuplicatesWithinWatermark(keys).drop("_t")
