"""Evaluation of synthetic tables: each column by the test its distribution calls for, and whole datasets.

A test is a grouped aggregate of ``metrics``; only its single row reaches the driver, where the
p-value and the verdict are made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.functions.special import chi_square_tail, kolmogorov_tail
from weftspark.operators import matching, metrics, relational, scores
from weftspark.plans.spec import Dataset

# What a column must reach.
LEAST_R2, LEAST_P, LEAST_COVERAGE = 0.92, 0.01, 0.999
FITTED = ("uniform", "normal", "lognormal", "exponential", "pareto", "poisson")
REPORT = "tab string, col string, metric string, value double, passed boolean"


def evaluate_column(df: DataFrame, column: str, distribution: dict) -> tuple[str, float, bool] | None:
    """(metric, value, passed) of one column; None for kinds without a test and for columns without values."""
    kind = distribution["kind"]
    if kind in FITTED:
        row = metrics.ks_fitted(df, column, kind).first()
        if not row["n"]:
            return None
        p = kolmogorov_tail(row["ks"], row["n"])
        return "ks_p", p, p >= LEAST_P
    if kind == "zipf":
        r2 = metrics.rank_frequency_fit(df, column).first()["r2"]
        return "zipf_r2", r2, r2 >= LEAST_R2
    if kind == "categorical":
        values, shares = [str(v) for v in distribution["values"]], distribution.get("probs")
        total = sum(shares) if shares else len(values)
        row = metrics.chi_square(df, column, {v: s / total for v, s in zip(values, shares or [1.0] * len(values), strict=True)}).first()
        if row["statistic"] is None:
            return None
        p = chi_square_tail(row["statistic"], row["freedom"])
        return "chi2_p", p, p >= LEAST_P
    return None


def single_tables(spark: SparkSession, spec: Dataset, made: dict[str, DataFrame]) -> DataFrame:
    """(tab, col, metric, value, passed): columns by their distribution, foreign keys by coverage, tables by row counts."""
    rows = []
    for rule in spec.rules:
        if rule.distribution and rule.table in made and rule.column in made[rule.table].columns:
            found = evaluate_column(made[rule.table], rule.column, rule.distribution)
            if found:
                rows.append((rule.table, rule.column, found[0], float(found[1]), bool(found[2])))
    for t in spec.tables.values():
        for k in t.foreign_keys:
            if t.name in made and k.ref_table in made:
                share = relational.fk_coverage(made[t.name], k.column, made[k.ref_table], k.ref_column).first()["coverage"]
                rows.append((t.name, k.column, "fk_coverage", float(share), share > LEAST_COVERAGE))
        if t.row_count and t.name in made:
            share = made[t.name].count() / t.row_count
            rows.append((t.name, None, "row_share", share, share >= LEAST_COVERAGE))
    return spark.createDataFrame(rows, REPORT)


def several_tables(
    spark: SparkSession, spec: Dataset, real: dict[str, DataFrame], made: dict[str, DataFrame],
    measures: dict[str, list[str]] | None = None, utility: dict[str, tuple[list[str], str]] | None = None,
) -> dict[str, float]:
    """The parts of the global score of a dataset against the real one, and ``global``.

    ``measures``: numeric columns by table whose correlations count. ``utility``: features and
    a label by table for a model trained on either side. Parts without anything to compare are absent.
    """
    keys = {t.name: [*t.primary_key, *[k.column for k in t.foreign_keys]] for t in spec.tables.values()}
    parts = {"schema": scores.schema_score(real, made, keys)}
    intra = [scores.intra_score(real[t], made[t], c) for t, c in (measures or {}).items() if t in real and t in made and len(c) > 1]
    inter = [
        scores.inter_score((real[k.ref_table], real[t.name]), (made[k.ref_table], made[t.name]), k.ref_column, k.column)
        for t in spec.tables.values() for k in t.foreign_keys if {t.name, k.ref_table} <= set(real) & set(made)
    ]
    models = [scores.model_utility(real[t], made[t], f, label) for t, (f, label) in (utility or {}).items() if t in real and t in made]
    for name, values in (("structure_intra", intra), ("structure_inter", inter), ("utility", models)):
        if values:
            parts[name] = sum(values) / len(values)
    return parts | {"global": scores.global_score(parts)}


def schema_report(real: DataFrame, made: DataFrame) -> DataFrame:
    """(metric, value) of two schema frames: F1 of tables, columns, primary and foreign keys, accuracy of
    types among common columns, accuracy of keys among the real ones, and the mean of these six."""
    f1 = matching.coverage(real, made).select(F.concat(F.col("kind"), F.lit("_f1")).alias("metric"), F.col("f1").alias("value"))
    same = real.join(made.select("tab", "col", F.col("sql_type").alias("type_"), F.col("role").alias("role_"), F.col("ref").alias("ref_")), ["tab", "col"], "left")
    share = lambda hit, of: F.coalesce(F.try_divide(F.count_if(hit).cast("double"), F.count_if(of)), F.lit(1.0))
    key = (F.col("role") == "primary_key") | F.col("ref").isNotNull()
    found = F.when(F.col("role") == "primary_key", F.col("role_") == "primary_key").otherwise(F.col("ref") == F.col("ref_"))
    row = same.agg(share(F.col("sql_type") == F.col("type_"), F.col("type_").isNotNull()).alias("t"), share(key & found, key).alias("k"))
    both = f1.union(row.selectExpr("stack(2, 'type_accuracy', t, 'key_accuracy', k) as (metric, value)"))
    return both.union(both.groupBy().agg(F.lit("mean").alias("metric"), F.avg("value").alias("value")))


def rules_coverage(real: Dataset, made: Dataset) -> dict[str, float]:
    """F1 of what the specs generate: columns with a rule, and (event, table, column) effects."""
    def f1(a: set, b: set) -> float:
        return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0

    columns = lambda s: {(r.table, r.column) for r in s.rules}
    effects = lambda s: {(e.name, x["table"], x["column"]) for e in s.events for x in e.effects}
    return {"columns_f1": f1(columns(real), columns(made)), "events_f1": f1(effects(real), effects(made))}
