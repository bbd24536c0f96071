"""Running sums, row numbers and look-ups in ranges over a whole frame, without one task that sorts it all.

Rows are dealt to buckets by splitters: keys of the whole order, not of its first column alone, so
rows that are equal in that one spread too. The splitters are literals in the plan, so every
evaluation deals rows alike; sums inside buckets and offsets of buckets make the whole. What a
window over all rows would do in one task, this does in ``buckets``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 64
#: Rows drawn for each splitter that is asked for.
DRAWN = 40


def splitters(df: DataFrame, order: list[str], buckets: int = BUCKETS) -> list[tuple]:
    """At most ``buckets`` - 1 keys, ascending, that cut ``df`` into parts of about equal size.

    They are ranks of a random draw of ``buckets`` * DRAWN rows, which is what the driver gets.
    """
    drawn = df.select(*order).orderBy(F.rand(7)).limit(buckets * DRAWN).orderBy(*order).collect()
    marks = [tuple(drawn[len(drawn) * i // buckets]) for i in range(1, buckets)] if drawn else []
    return list(dict.fromkeys(marks))


def _key(df: DataFrame, order: list[str], values: tuple | None = None) -> Column:
    """The order columns, or values of their types, as a struct: these compare column by column, nulls first."""
    return F.struct(*[(F.col(c) if values is None else F.lit(values[i]).cast(df.schema[c].dataType)).alias(f"k{i}") for i, c in enumerate(order)])


def bucketed(df: DataFrame, order: str | list[str], buckets: int = BUCKETS) -> DataFrame:
    """Adds ``_bucket``, ascending with the order."""
    order = [order] if isinstance(order, str) else order
    marks = splitters(df, order, buckets)
    if not marks:
        return df.withColumn("_bucket", F.lit(0))

    def place(low: int, high: int) -> Column:
        """How many of the marks are not above the key, if it is ``low`` to ``high``: a binary search."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col("_key") < _key(df, order, marks[middle]), place(low, middle)).otherwise(place(middle + 1, high))

    at = place(0, len(marks))
    return df.withColumn("_key", _key(df, order)).withColumn("_bucket", at).drop("_key")


def running(df: DataFrame, order: str | list[str], sums: list[str], nexts: bool = False) -> DataFrame:
    """Adds run_<c> (inclusive running sums in ``order``) and, if asked, next_<order's first>."""
    order = [order] if isinstance(order, str) else order
    placed = bucketed(df, order)
    inside = W.partitionBy("_bucket").orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    summed = placed.withColumns({f"_in_{c}": F.sum(c).over(upto) for c in sums})
    if nexts:
        summed = summed.withColumn("_next", F.lead(order[0]).over(inside))
    ends = placed.groupBy("_bucket").agg(F.min(order[0]).alias("_first"), *[F.sum(c).alias(f"_all_{c}") for c in sums])
    along = W.orderBy("_bucket")  # one row a bucket
    before = along.rowsBetween(W.unboundedPreceding, -1)
    offsets = ends.select(
        F.col("_bucket").alias("_b"), F.lead("_first").over(along).alias("_after"),
        *[F.coalesce(F.sum(f"_all_{c}").over(before), F.lit(0)).alias(f"_off_{c}") for c in sums],
    )
    out = summed.join(F.broadcast(offsets), F.col("_bucket") == F.col("_b"))  # at most BUCKETS rows
    more = [F.coalesce("_next", "_after").alias(f"next_{order[0]}")] if nexts else []
    return out.select(*df.columns, *[(F.col(f"_in_{c}") + F.col(f"_off_{c}")).alias(f"run_{c}") for c in sums], *more)


def with_numbers(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """``df`` with numbers 0, 1, ... in ``order``."""
    placed = bucketed(df, order)
    inside = placed.withColumn("_in", F.row_number().over(W.partitionBy("_bucket").orderBy(*order)) - 1)
    sizes = placed.groupBy("_bucket").agg(F.count("*").alias("_n"))
    before = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    out = inside.join(F.broadcast(offsets), F.col("_bucket") == F.col("_b"))  # at most BUCKETS rows
    return out.select(*df.columns, (F.col("_in") + F.col("_off")).alias(name))


def numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``df`` with ``number`` (0, 1, ...) in ``order``, and its size."""
    return with_numbers(df, order), df.count()


def range_lookup(points: DataFrame, x: str, ranges: DataFrame, low: str, high: str, take: list[str], buckets: int = BUCKETS) -> DataFrame:
    """``points`` with the columns ``take`` of the range that holds ``x``: low <= x < high.

    Ranges do not overlap; those that are empty or lack an end hold nothing. Points in a gap, and
    null ones, get nulls. Both sides are dealt to cells between splitters of either; a range enters
    every cell it touches, so ranges and points of a cell meet in one sorted pass, and no pair of
    these is formed. In the cells are at most as many ranges more as there are cells.
    """
    held = ranges.where(F.col(low) < F.col(high)).select(F.col(low).cast("double").alias("_x"), F.col(high).cast("double").alias("_hi"), *[F.col(c).alias(f"_take_{c}") for c in take])
    asked = points.withColumn("_x", F.col(x).cast("double"))
    marks = sorted({m[0] for df in (held, asked) for m in splitters(df.where("_x is not null"), ["_x"], buckets)})
    edges = F.array(*[F.lit(m).cast("double") for m in marks]) if marks else F.array().cast("array<double>")
    cell = lambda c: F.size(F.filter(edges, lambda m: m <= c))
    # The last cell is that of the greatest number below the range's end.
    last = F.size(F.filter(edges, lambda m: m < F.col("_hi")))
    starts = held.withColumn("_cell", F.explode(F.sequence(cell(F.col("_x")), last)))
    taken = F.struct("_hi", *[f"_take_{c}" for c in take]).alias("_range")
    starts = starts.select("_cell", F.lit(0).alias("_kind"), "_x", taken, F.lit(None).cast(_struct(points)).alias("_row"))
    kind = starts.schema["_range"].dataType
    rows = asked.select(cell(F.col("_x")).alias("_cell"), F.lit(1).alias("_kind"), "_x", F.lit(None).cast(kind).alias("_range"), F.struct(*points.columns).alias("_row"))
    along = W.partitionBy("_cell").orderBy("_x", "_kind").rowsBetween(W.unboundedPreceding, 0)
    met = starts.union(rows).withColumn("_range", F.last("_range", ignorenulls=True).over(along)).where("_kind = 1")
    inside = F.col("_x") < F.col("_range._hi")
    return met.select("_row.*", *[F.when(inside, F.col(f"_range._take_{c}")).alias(c) for c in take])


def _struct(df: DataFrame):
    return df.select(F.struct(*df.columns).alias("s")).schema["s"].dataType
