"""Exact quantiles of many columns at once by distributed selection.

Values are counted once for each column. A quantile lies between two ranks; what holds a wanted
rank is narrowed down by histograms whose edges are drawn from the values themselves, so their
bins are about equally full whatever the distribution. A bin that no longer has many distinct
values is sorted, the others are cut again. No task ever holds the values of a column.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftspark.session import scratch_path

#: Distinct values that one task sorts, edges of a histogram, and values drawn for an edge.
FEW, EDGES, DRAWN = 50_000, 100, 20


def stacked_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value): the columns as doubles below each other, NaN as null."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    x = F.nanvl(F.col("value"), F.lit(None).cast("double"))
    return df.selectExpr(f"stack({len(columns)}, {pairs}) as (column, value)").withColumn("value", x)


def kept(counts: DataFrame) -> DataFrame:
    """(column, value, n) as a written table: every later pass reads this."""
    path = scratch_path(counts.sparkSession, "counts")
    counts.write.parquet(path)
    return counts.sparkSession.read.schema(counts.schema).parquet(path)


def counted(values: DataFrame) -> DataFrame:
    """(column, value, n): how often each column has each value, written."""
    return kept(values.where("value is not null").groupBy("column", "value").agg(F.count("*").alias("n")))


def _members(counts: DataFrame, groups: list[tuple[str, float, float]]) -> DataFrame:
    """``counts`` of the values in the groups (column, low, high), ends included, with the group's number."""
    rows = [(i, c, low, high) for i, (c, low, high) in enumerate(groups)]
    g = counts.sparkSession.createDataFrame(rows, "grp int, column string, low double, high double")
    return counts.join(F.broadcast(g), "column").where("value between low and high").select("grp", "value", "n")  # a group a wanted rank


def values_at(counts: DataFrame, ranks: dict[str, list[int]], few: int = FEW) -> dict[tuple[str, int], float]:
    """The value at every asked rank (from 0) of every column, from (column, value, n)."""
    found: dict[tuple[str, int], float] = {}
    # What is asked: a rank within the values of a column between two ends, and its rank in the column.
    asked = [(c, -math.inf, math.inf, r, r) for c, rs in ranks.items() for r in sorted(set(rs))]
    while asked:
        groups = sorted({a[:3] for a in asked})
        inside = _members(counts, groups)
        sizes = {r["grp"]: r for r in inside.groupBy("grp").agg(F.count("*").alias("m"), F.min("value").alias("lo")).collect()}  # a row a group
        small = {g for i, g in enumerate(groups) if i in sizes and sizes[i]["m"] <= few}
        large = [g for i, g in enumerate(groups) if i in sizes and g not in small]
        if small:
            some = sorted(small)
            want = [(some.index(a[:3]), a[3]) for a in asked if a[:3] in small]
            along = W.partitionBy("grp").orderBy("value")
            run = _members(counts, some).withColumn("upto", F.sum("n").over(along.rowsBetween(W.unboundedPreceding, 0)))
            wanted = counts.sparkSession.createDataFrame(want, "grp int, rank long")
            hit = run.join(F.broadcast(wanted), "grp").where("rank >= upto - n and rank < upto")  # a row a wanted rank
            at = {(r["grp"], r["rank"]): r["value"] for r in hit.select("grp", "rank", "value").collect()}
            found |= {(a[0], a[4]): at[some.index(a[:3]), a[3]] for a in asked if a[:3] in small}
        asked = [a for a in asked if a[:3] in set(large)]
        if asked:
            asked = _narrowed(counts, asked, large, [sizes[groups.index(g)]["m"] for g in large])
    return found


def _narrowed(counts: DataFrame, asked: list[tuple], groups: list[tuple], sizes: list[int]) -> list[tuple]:
    """What is asked, with the bin of a histogram that holds each rank for its group."""
    spark, inside = counts.sparkSession, _members(counts, groups)
    share = F.element_at(F.array(*[F.lit(min(1.0, EDGES * DRAWN / m)) for m in sizes]), F.col("grp") + 1)
    drawn: dict[int, list[float]] = {}
    for r in inside.where(F.rand(7) < share).select("grp", "value").collect():  # some EDGES * DRAWN values a group
        drawn.setdefault(r["grp"], []).append(r["value"])
    edges = [(i, sorted({sorted(v)[len(v) * k // EDGES] for k in range(1, EDGES)})) for i, v in drawn.items()]
    marks = spark.createDataFrame([*edges, *[(i, []) for i in range(len(groups)) if i not in drawn]], "grp int, marks array<double>")
    bins = inside.join(F.broadcast(marks), "grp").withColumn("bin", F.size(F.filter("marks", lambda m: m <= F.col("value"))))
    rows = bins.groupBy("grp", "bin").agg(F.sum("n").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).orderBy("grp", "bin").collect()
    out = []
    for column, low, high, rank, whole in asked:
        grp, before = groups.index((column, low, high)), 0
        for r in (r for r in rows if r["grp"] == grp):
            if rank < before + r["n"]:
                out.append((column, r["lo"], r["hi"], rank - before, whole))
                break
            before += r["n"]
    return out


def exact_quantiles(counts: DataFrame, quantiles: tuple[float, ...], few: int = FEW) -> DataFrame:
    """(column, q): the quantiles of every column of (column, value, n), linear between two ranks."""
    sizes = {r["column"]: r["n"] for r in counts.groupBy("column").agg(F.sum("n").alias("n")).collect()}  # a row a column
    places = {c: [q * (n - 1) for q in quantiles] for c, n in sizes.items()}
    at = values_at(counts, {c: [f(p) for p in ps for f in (math.floor, math.ceil)] for c, ps in places.items()}, few)

    def between(c: str, p: float) -> float:
        low, high = math.floor(p), math.ceil(p)
        return at[c, low] if at[c, low] == at[c, high] else (high - p) * at[c, low] + (p - low) * at[c, high]

    return counts.sparkSession.createDataFrame([(c, [between(c, p) for p in ps]) for c, ps in places.items()], "column string, q array<double>")
