"""Constraints made to hold, and checks that they do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.operators.predicates import condition


def _default(kind: T.DataType) -> Column:
    if isinstance(kind, T.IntegralType):
        return F.lit(0).cast(kind)
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return F.lit(0.0).cast(kind)
    if isinstance(kind, T.BooleanType):
        return F.lit(False)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit("1970-01-01").cast(kind)
    return F.lit("").cast(kind)


def enforce_fd(df: DataFrame, lhs: list[str], rhs: list[str], order: list[str]) -> DataFrame:
    """Every row of an lhs group gets the rhs values of the group's first row in ``order``.

    Aggregate and join back, rather than a window: a group may hold a third of all rows, and
    the first row of a group is found by partial aggregation.
    """
    first = df.groupBy(*[F.col(c).alias(f"_l_{c}") for c in lhs]).agg(
        F.min_by(F.struct(*rhs), F.struct(*order)).alias("_first")
    )
    on = [F.col(c).eqNullSafe(F.col(f"_l_{c}")) for c in lhs]
    out = df.join(first, on)
    return out.select(*[F.col(f"_first.{c}").alias(c) if c in rhs else F.col(c) for c in df.columns])


def enforce_implication(df: DataFrame, when: dict, column: str, effect: str, value=None) -> DataFrame:
    """Where the predicate holds: ``is_null``, ``not_null`` (default ``value``, else "") or ``eq`` value."""
    kind = df.schema[column].dataType
    old = F.col(column)
    new = {
        "is_null": F.lit(None).cast(kind),
        "not_null": F.coalesce(old, _default(kind) if value is None else F.lit(value).cast(kind)),
        "eq": F.lit(value).cast(kind),
    }.get(effect)
    if new is None:
        raise ValueError(f"unknown effect {effect!r}")
    return df.withColumn(column, F.when(condition(when), new).otherwise(old))


def enforce_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULLs become the default of the column's type."""
    return df.withColumns({c: F.coalesce(F.col(c), _default(df.schema[c].dataType)) for c in columns})


def enforce(df: DataFrame, fds: list[dict], implications: list[dict], not_null: list[str], order: list[str]) -> DataFrame:
    """Dependencies first, then implications, then NOT NULL."""
    for fd in fds:
        df = enforce_fd(df, fd["lhs"], fd["rhs"], order)
    for i in implications:
        df = enforce_implication(df, i["when"], i["column"], i["effect"], i.get("value"))
    return enforce_not_null(df, not_null) if not_null else df


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    """(key columns, n): keys that occur more than once."""
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def assert_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """``df``, after a check that its key is unique."""
    bad = duplicates(df, key).limit(3).collect()
    if bad:
        raise ValueError(f"{key} is not unique, e.g. {[r.asDict() for r in bad]}")
    return df


def dedup_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``; partial aggregation, no window."""
    rest = [c for c in df.columns if c not in key]
    first = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return first.select(*[F.col(c) if c in key else F.col(f"_first.{c}").alias(c) for c in df.columns])
