"""Scores over whole datasets: marginals, structure, foreign keys, utility and one global figure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.functions.special import chi_square_tail, kolmogorov_tail
from weftspark.operators import metrics, relational

WEIGHTS = {"schema": 0.4, "structure_intra": 0.2, "structure_inter": 0.2, "utility": 0.2}


def column_score(real: DataFrame, made: DataFrame, column: str) -> float:
    """Numeric: mean of the KS p-value and 1 - min(1, W1 / 10). Others: chi-squared p-value.

    Times count as numbers of days. Two columns without values are alike (1.0); one without is
    unlike any other (0.0).
    """
    kind = real.schema[column].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        days = lambda df: df.select((F.col(column).cast("timestamp").cast("double") / 86_400).alias(column))
        return column_score(days(real), days(made), column)
    if isinstance(kind, T.NumericType):
        row = metrics.two_sample(real, made, column).first()
        if not row["n_a"] or not row["n_b"]:
            return float(bool(row["n_a"]) == bool(row["n_b"]))
        n = row["n_a"] * row["n_b"] / (row["n_a"] + row["n_b"])
        return (kolmogorov_tail(row["ks"], n) + 1 - min(1.0, row["wasserstein"] / 10)) / 2
    row = metrics.categorical_two_sample(real, made, column).first()
    if row["chi2"] is None:  # without values on one side at least
        return float(not row["k"])
    return chi_square_tail(row["chi2"], row["k"] - 1)


def schema_score(real: dict[str, DataFrame], made: dict[str, DataFrame], keys: dict[str, list[str]] | None = None) -> float:
    """Mean column score of common tables, times the shares of tables and of columns covered.

    ``keys`` by table: columns that only name rows; they count as covered, their values do not.
    """
    common = [t for t in real if t in made]
    if not common:
        return 0.0
    scores, shares = [], []
    for t in common:
        columns = [c for c in real[t].columns if c in made[t].columns]
        shares.append(len(columns) / len(real[t].columns))
        scores += [column_score(real[t], made[t], c) for c in columns if c not in (keys or {}).get(t, ())]
    return sum(scores) / max(len(scores), 1) * len(common) / len(real) * sum(shares) / len(shares)


def intra_score(real: DataFrame, made: DataFrame, columns: list[str]) -> float:
    """1 minus the mean difference of Pearson r over all pairs of columns, pairwise complete."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if not pairs:
        return 1.0
    r = lambda df: df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in pairs]).first()
    gaps = [abs((x or 0.0) - (y or 0.0)) / 2 for x, y in zip(r(real), r(made), strict=True)]
    return 1 - sum(gaps) / len(gaps)


def inter_score(real: tuple[DataFrame, DataFrame], made: tuple[DataFrame, DataFrame], pk: str, fk: str) -> float:
    """0.4 of the coverage, 0.3 of 1 / (1 + W1 of the degrees), 0.3 of their mean with the cardinality ratio."""
    coverage = relational.fk_coverage(made[1], fk, made[0], pk).first()["coverage"]
    degrees = [relational.degrees(p, pk, c, fk).select(F.col("degree").cast("double").alias("x")) for p, c in (real, made)]
    found = metrics.two_sample(*degrees, "x").first()
    w1 = found["wasserstein"]
    if w1 is None:  # without parents on one side, or on both
        w1 = float("inf") if found["n_a"] or found["n_b"] else 0.0
    ratio = [c.count() / max(p.count(), 1) for p, c in (real, made)]
    cardinality = min(ratio) / max(ratio) if max(ratio) else 1.0
    return 0.4 * coverage + 0.3 / (1 + w1) + 0.3 * (coverage + cardinality) / 2


def model_utility(real: DataFrame, made: DataFrame, features: list[str], label: str, split: float = 0.7, seed: int = 7) -> float:
    """Accuracy on held-out real rows of a model trained on synthetic rows, by that of one trained on real rows."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler

    make = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip")
    ready = lambda df: make.transform(df.select(*features, F.col(label).cast("double").alias("label")))
    share = F.pmod(F.xxhash64(F.lit(seed), *features), F.lit(1000)) < int(split * 1000)
    rows = ready(real)
    train, test = rows.where(share), rows.where(~share)
    accuracy = MulticlassClassificationEvaluator(metricName="accuracy")
    learn = LogisticRegression(maxIter=50, regParam=1e-3)
    scores = [accuracy.evaluate(learn.fit(t).transform(test)) for t in (ready(made), train)]
    return min(1.0, scores[0] / (scores[1] + 1e-9))


def global_score(parts: dict[str, float], weights: dict[str, float] | None = None) -> float:
    """Weighted mean of the parts at hand."""
    weights = weights or WEIGHTS
    total = sum(weights[k] for k in parts if k in weights)
    return sum(v * weights[k] for k, v in parts.items() if k in weights) / total if total else 0.0
