"""Structured predicates, event activity and outlier filters as boolean Columns."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.operators.quantiles import counted, exact_quantiles, stacked_values

COMPARE = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "lt": lambda c, v: c < v, "le": lambda c, v: c <= v,
    "gt": lambda c, v: c > v, "ge": lambda c, v: c >= v, "in": lambda c, v: c.isin(list(v)),
    "is_null": lambda c, _: c.isNull(), "not_null": lambda c, _: c.isNotNull(),
}


def condition(tree: dict) -> Column:
    """{"col", "op", "value"} atoms under {"and": [...]}, {"or": [...]} and {"not": ...}."""
    if "and" in tree or "or" in tree:
        kind = "and" if "and" in tree else "or"
        parts = [condition(t) for t in tree[kind]]
        if not parts:
            raise ValueError(f"an empty {kind!r}")
        out = parts[0]
        for p in parts[1:]:
            out = out & p if kind == "and" else out | p
        return out
    if "not" in tree:
        return ~condition(tree["not"])
    if tree.get("op") not in COMPARE:
        raise ValueError(f"unknown comparison {tree.get('op')!r}; there are {', '.join(COMPARE)}")
    return COMPARE[tree["op"]](F.col(tree["col"]), tree.get("value"))


def read_condition(text: str) -> dict:
    """``col in ('a', 'b')``, ``col == 'x'`` and ``col != 'x'`` as a structured predicate."""
    listed = re.fullmatch(r"\s*(\w+)\s+in\s*[\(\[](.*)[\)\]]\s*", text, re.I)
    value = lambda t: t.strip().strip("'\"")
    if listed:
        return {"col": listed[1], "op": "in", "value": [value(v) for v in listed[2].split(",") if v.strip()]}
    one = re.fullmatch(r"\s*(\w+)\s*(==|=|!=|<>|<=|>=|<|>)\s*(.+?)\s*", text)
    if not one:
        raise ValueError(f"can't read the condition {text!r}")
    ops = {"==": "eq", "=": "eq", "!=": "ne", "<>": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}
    raw = value(one[3])
    quoted = one[3].strip()[0] in "'\""
    number = None if quoted else re.fullmatch(r"-?\d+(\.\d+)?", raw)
    return {"col": one[1], "op": ops[one[2]], "value": float(raw) if number and "." in raw else int(raw) if number else raw}


def active(start: str | int | None, end: str | int | None, time_col: str | None, row: Column | None = None, rows: int | None = None) -> Column:
    """Whether a row lies in [start, end): ISO times on ``time_col``, "50%" or numbers on ``row``."""

    def bound(x):
        if isinstance(x, str) and x.endswith("%"):
            return None, int(float(x[:-1]) / 100 * (rows or 0))
        if isinstance(x, int) or str(x).isdigit():
            return None, int(x)
        return dt.datetime.fromisoformat(str(x)), None

    out = F.lit(True)
    for x, after in ((start, True), (end, False)):
        if x is None:
            continue
        time, number = bound(x)
        if time is not None and time_col is None or number is not None and row is None:
            raise ValueError(f"bound {x!r} needs a {'time column' if time is not None else 'row number'}")
        column, value = (F.col(time_col), F.lit(time)) if time is not None else (row, F.lit(number))
        out = out & (column >= value if after else column < value)
    return out


def iqr_outliers(df: DataFrame, column: str, width: float = 1.5) -> DataFrame:
    """Rows outside [Q1 - width IQR, Q3 + width IQR], exact quartiles; NULLs are no outliers.

    The fences are one row, which joins the rows without a shuffle. Without values there is no fence
    and no outlier.
    """
    q = exact_quantiles(counted(stacked_values(df, [column])), (0.25, 0.75))
    fence = q.select(
        (F.col("q")[0] - width * (F.col("q")[1] - F.col("q")[0])).alias("_low"),
        (F.col("q")[1] + width * (F.col("q")[1] - F.col("q")[0])).alias("_high"),
    )
    return df.join(F.broadcast(fence), (F.col(column) < F.col("_low")) | (F.col(column) > F.col("_high"))).drop("_low", "_high")


def z_outliers(df: DataFrame, column: str, limit: float = 3.0) -> DataFrame:
    """Rows further than ``limit`` population deviations from the mean."""
    m = df.agg(F.avg(column).alias("_mean"), F.stddev_pop(column).alias("_dev"))
    far = F.abs(F.col(column) - F.col("_mean")) > limit * F.col("_dev")
    return df.join(F.broadcast(m), far).drop("_mean", "_dev")
