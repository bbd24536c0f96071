"""Workload SQL over views of the tables, and how well it answers on synthetic data."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.operators.metrics import gini
from weftspark.session import TABLES, register_views

#: Seconds that a workload query may take.
LIMIT_S = 5.0


def run_workload(spark: SparkSession, sf_dir: str, sql: str, names: tuple[str, ...] = TABLES) -> DataFrame:
    """The query's result; Catalyst plans it as any other query."""
    register_views(spark, sf_dir, names)
    return spark.sql(sql)


def fallback_sql(kind: str, name: str, columns: list[str]) -> str:
    """A query for a workload entry without SQL: grouped by the first column, or a plain count."""
    if kind == "group_by" and columns:
        return f"select `{columns[0]}`, count(*) as n from {name} group by `{columns[0]}`"
    return f"select count(*) as n from {name}"


def measure(spark: SparkSession, entries: list[dict]) -> list[dict]:
    """Runs entries ({"sql", "type"}) one by one: seconds, rows, skew of groups, or the error."""
    out = []
    for entry in entries:
        began = time.time()
        row = {"sql": entry["sql"], "type": entry.get("type", "filter")}
        try:
            found = spark.sql(entry["sql"])
            numeric = next((f.name for f in found.schema if isinstance(f.dataType, T.NumericType)), None)
            row["rows"] = found.count()
            row["elapsed"] = time.time() - began
            row["passed"] = row["elapsed"] <= LIMIT_S
            if row["type"] == "group_by" and numeric:
                row["group_gini"] = gini(found, numeric).first()["gini"]
                top = found.agg((F.max(numeric) / F.sum(numeric)).alias("top1")).first()
                row["top1_share"] = top["top1"]
        except Exception as error:  # noqa: BLE001  (the error is the row's result)
            row |= {"elapsed": time.time() - began, "passed": False, "error": str(error).splitlines()[0][:300]}
        out.append(row)
    return out


def query_utility(spark: SparkSession, sql: str, real: dict[str, DataFrame], made: dict[str, DataFrame]) -> DataFrame:
    """One row: 1 - min(1, relative error) of the first cell. ``sql`` names tables in braces."""

    def first(frames: dict[str, DataFrame], name: str) -> DataFrame:
        space = f"w{uuid.uuid4().hex[:8]}"
        for t, frame in frames.items():
            frame.createOrReplaceTempView(f"{space}_{t}")
        found = spark.sql(sql.format(**{t: f"{space}_{t}" for t in frames}))
        return found.limit(1).select(F.col(f"`{found.columns[0]}`").cast("double").alias(name))

    both = first(real, "a").join(F.broadcast(first(made, "b")))
    error = F.when(F.col("a") == 0, F.when(F.col("b") == 0, 0.0).otherwise(1.0)).otherwise(F.abs(F.col("b") - F.col("a")) / F.abs(F.col("a")))
    return both.select((1 - F.least(F.lit(1.0), error)).alias("utility"))
