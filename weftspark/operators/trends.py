"""Trends between tables: how a parent's column and a child's go together, in two datasets.

Children are first summed up by their key, so the foreign-key join has a row a key (for two
numbers) or a row a key and value, however many children a parent has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bins of a number that is compared with a category.
BINS = 10


def _numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def joined_correlations(parent: DataFrame, pk: str, child: DataFrame, fk: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(parent_col, child_col, r): Pearson r over the join of all pairs of number columns; pairs with a null are left out.

    A child table is summed by its key in one grouping, and joined once.
    """
    xs, ys = list(dict.fromkeys(p for p, _ in pairs)), list(dict.fromkeys(c for _, c in pairs))
    y = lambda c: F.col(f"`{c}`").cast("double")
    by_key = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_k")).agg(
        *[x for i, c in enumerate(ys) for x in (F.count(y(c)).alias(f"n{i}"), F.sum(y(c)).alias(f"s{i}"), F.sum(y(c) * y(c)).alias(f"q{i}"))]
    )
    keyed = parent.select(F.col(pk).alias("_k"), *[y(c).alias(f"x{i}") for i, c in enumerate(xs)])
    both = keyed.join(by_key, "_k")

    def sums(i: int, j: int) -> Column:
        x, n = F.col(f"x{i}"), F.when(F.col(f"x{i}").isNotNull(), F.col(f"n{j}"))
        held = F.when(x.isNotNull(), F.col(f"s{j}"))
        return F.struct(
            F.sum(n).cast("double").alias("n"), F.sum(n * x).alias("x"), F.sum(n * x * x).alias("xx"), F.sum(held).alias("y"),
            F.sum(F.when(x.isNotNull(), F.col(f"q{j}"))).alias("yy"), F.sum(x * held).alias("xy"),
        )

    rows = both.agg(*[sums(xs.index(p), ys.index(c)).alias(f"p{k}") for k, (p, c) in enumerate(pairs)])
    one = F.explode(F.array(*[F.struct(F.lit(p).alias("parent_col"), F.lit(c).alias("child_col"), F.col(f"p{k}").alias("t")) for k, (p, c) in enumerate(pairs)]))
    t = rows.select(one.alias("s")).select("s.*")
    n, sx, sy = F.col("t.n"), F.col("t.x"), F.col("t.y")
    spread = lambda q, s: F.col(f"t.{q}") - F.try_divide(s * s, n)
    r = F.try_divide(F.col("t.xy") - F.try_divide(sx * sy, n), F.sqrt(F.greatest(spread("xx", sx), F.lit(0.0)) * F.greatest(spread("yy", sy), F.lit(0.0))))
    return t.select("parent_col", "child_col", r.alias("r"))


def joined_counts(parent: DataFrame, pk: str, child: DataFrame, fk: str, parent_value: Column, child_value: Column) -> DataFrame:
    """(a, b, n): how often values of a parent and of its children meet; a null is a value."""
    by_key = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_k"), child_value.cast("string").alias("b")).agg(F.count("*").alias("n"))
    keyed = parent.select(F.col(pk).alias("_k"), parent_value.cast("string").alias("a"))
    return keyed.join(by_key, "_k").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _binned(df: DataFrame, column: str, ends: tuple[float | None, float | None]) -> Column:
    """Numbers as one of BINS equal parts of the range ``ends``; what lies outside is in the nearest one."""
    x, (low, high) = F.col(f"`{column}`").cast("double"), ends
    if low is None or high == low:
        return F.when(x.isNotNull(), F.lit(0))
    return F.least(F.greatest(F.floor((x - low) / ((high - low) / BINS)), F.lit(0)), F.lit(BINS - 1))


def intertable_trends(
    real: tuple[DataFrame, DataFrame], made: tuple[DataFrame, DataFrame], pk: str, fk: str, parent_columns: list[str], child_columns: list[str]
) -> DataFrame:
    """(parent_col, child_col, metric, similarity) of all pairs of a parent's and a child's columns.

    Two numbers: 1 - |r - r'| / 2 of their correlations over the join. Else: 1 minus half the L1
    distance of the shares of value pairs, numbers in BINS parts of their range in the real data.
    Null where a side has nothing to compare.
    """
    pairs = [(p, c) for p in parent_columns for c in child_columns]
    numbers = [(p, c) for p, c in pairs if _numeric(real[0], p) and _numeric(real[1], c)]
    out = []
    if numbers:
        a = joined_correlations(real[0], pk, real[1], fk, numbers)
        b = joined_correlations(made[0], pk, made[1], fk, numbers).withColumnRenamed("r", "other")
        both = a.join(b, ["parent_col", "child_col"])
        out.append(both.select("parent_col", "child_col", F.lit("correlation").alias("metric"), (1 - F.abs(F.col("r") - F.col("other")) / 2).alias("similarity")))
    mixed = [x for x in pairs if x not in numbers]
    ends = {}
    for df, columns in ((real[0], {p for p, _ in mixed}), (real[1], {c for _, c in mixed})):
        asked = [c for c in sorted(columns) if _numeric(df, c)]
        if asked:
            row = df.agg(*[f(F.col(f"`{c}`").cast("double")) for c in asked for f in (F.min, F.max)]).first()
            ends |= {(id(df), c): (row[2 * i], row[2 * i + 1]) for i, c in enumerate(asked)}

    def value(df: DataFrame, like: DataFrame, column: str) -> Column:
        return _binned(df, column, ends[id(like), column]) if (id(like), column) in ends else F.col(f"`{column}`")

    for p, c in mixed:
        a, b = (joined_counts(x[0], pk, x[1], fk, value(x[0], real[0], p), value(x[1], real[1], c)) for x in (real, made))
        total = a.agg(F.sum("n").alias("_na")).join(F.broadcast(b.agg(F.sum("n").alias("_nb"))))  # one row
        keyed = lambda df, n: df.select(F.struct("a", "b").alias("k"), F.col("n").alias(n))
        both = keyed(a, "na").join(keyed(b, "nb"), "k", "full").join(F.broadcast(total))
        gap = F.abs(F.coalesce("na", F.lit(0)) / F.col("_na") - F.coalesce("nb", F.lit(0)) / F.col("_nb"))
        out.append(both.agg((1 - F.sum(gap) / 2).alias("similarity")).select(F.lit(p).alias("parent_col"), F.lit(c).alias("child_col"), F.lit("contingency").alias("metric"), "similarity"))
    return reduce(DataFrame.unionByName, out)


def trend_score(trends: DataFrame) -> float | None:
    """Mean similarity of the pairs that have one."""
    return trends.agg(F.avg("similarity")).first()[0]
