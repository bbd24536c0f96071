"""From data to a dataset spec: profiles, dependencies, keys and fitted distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.functions.special import kolmogorov_tail
from weftspark.operators import dependencies, metrics, profile
from weftspark.plans.spec import Column, Dataset, ForeignKey, Rule, Table

#: More distinct values than this make a categorical column a Zipf one.
MOST_VALUES = 1000
#: So do more than these, if the commonest has a greater share than this.
MANY_VALUES, COMMON = 100, 0.1


def column_type(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "INT"
    if isinstance(kind, (T.FractionalType, T.DecimalType)):
        return "FLOAT"
    if isinstance(kind, T.BooleanType):
        return "BOOL"
    if isinstance(kind, T.DateType):
        return "DATE"
    return "DATETIME" if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else "TEXT"


def numeric_rule(df: DataFrame, column: str) -> dict:
    """The family of greatest KS p-value, among equals of greatest likelihood; uniform where none fits."""
    rows = profile.fit_distributions(df, column).collect()
    found = {r["family"]: r for r in metrics.ks_of_families(df, column, [r["family"] for r in rows]).collect()} if rows else {}
    p = lambda f: round(kolmogorov_tail(found[f]["ks"], found[f]["n"]), 12) if found[f]["ks"] is not None else 0.0
    fits = {r["family"]: (p(r["family"]), r["loglik"]) for r in rows}
    best = max(rows, key=lambda r: fits[r["family"]], default=None)
    if best is None:
        return {"kind": "uniform", "low": 0.0, "high": 1.0}
    a, b = best["a"], best["b"]
    return {
        "normal": lambda: {"kind": "normal", "mean": a, "std": b},
        "lognormal": lambda: {"kind": "lognormal", "mean": a, "sigma": b},
        "exponential": lambda: {"kind": "exponential", "scale": a},
        "pareto": lambda: {"kind": "pareto", "alpha": a, "xm": b},
        "uniform": lambda: {"kind": "uniform", "low": a, "high": b},
        "poisson": lambda: {"kind": "poisson", "lam": a},
    }[best["family"]]()


def categorical_rule(df: DataFrame, column: str) -> dict:
    """The values with their shares, or a Zipf law over ranks: where there are too many, or many and one is common."""
    counts = profile.value_counts(df, column)
    sizes = counts.agg(F.count("*").alias("k"), (F.max("n") / F.sum("n")).alias("top")).first()
    top = counts.orderBy("value").limit(MOST_VALUES + 1).collect()
    if len(top) > MOST_VALUES or (sizes["k"] > MANY_VALUES and sizes["top"] > COMMON):
        fit = metrics.rank_frequency_fit(df, column).first()
        return {"kind": "zipf", "n": int(fit["n_values"]), "s": max(float(fit["exponent"]), 0.01)}
    total = sum(r["n"] for r in top)
    return {"kind": "categorical", "values": [str(r["value"]) for r in top], "probs": [r["n"] / total for r in top]}


def spec_from_data(tables: dict[str, DataFrame], foreign_keys: dict[str, list[ForeignKey]] | None = None, primary_keys: dict[str, list[str]] | None = None) -> Dataset:
    """A spec that generates tables like the given ones.

    Dependencies of single columns are looked for among columns of keys, texts and truth values.
    What they make of the columns gives the candidate keys; those that say no more than a key does
    are left out, and the others become the table's dependencies.
    """
    spec = Dataset({})
    for name, df in tables.items():
        keys = (foreign_keys or {}).get(name, [])
        counted = {r["column"]: r for r in dependencies.unique_columns(df).collect()}
        n = next(iter(counted.values()))["n"] if counted else 0
        unique = [c for c in df.columns if counted[c]["is_unique"] and n]
        primary = (primary_keys or {}).get(name) or unique[:1]
        nulls = {r["column"]: r["n_null"] for r in profile.null_counts(df).collect()}
        columns = []
        for f in df.schema:
            role = "primary_key" if f.name in primary else "foreign_key" if f.name in {k.column for k in keys} else None
            columns.append(Column(f.name, column_type(f.dataType), nulls[f.name] > 0, f.name in unique and f.name not in primary, role))
        named = [c.name for c in columns if c.role or c.sql_type in ("TEXT", "BOOL")]
        found = [({r["lhs"]}, {r["rhs"]}) for r in dependencies.discover_fds(df, named, 1, confidence=1.0).collect()] if n and len(named) > 1 else []
        candidates = [list(k) for k in dependencies.candidate_keys(named, found, [u for u in unique if u in named], 2)] if n else []
        others = dependencies.split_key_fds(found, [tuple(k) for k in candidates])[1]
        fds = [{"lhs": sorted(a), "rhs": sorted(b)} for a, b in sorted(others, key=lambda x: (sorted(x[0]), sorted(x[1])))]
        several = [k for k in candidates if len(k) > 1 and len(named) == len(df.columns)]  # other columns might depend on more
        spec.tables[name] = Table(name, columns, "fact" if keys else "dimension", max(int(n), 1), primary, keys, [[u] for u in unique] + several, fds)
        for c in columns:
            if c.role in ("primary_key", "foreign_key"):
                continue
            if c.sql_type in ("INT", "FLOAT"):
                spec.rules.append(Rule(name, c.name, numeric_rule(df, c.name)))
            elif c.sql_type in ("TEXT", "BOOL"):
                spec.rules.append(Rule(name, c.name, categorical_rule(df, c.name)))
            else:
                shares = {r["name"]: r["share"] for r in profile.month_shares(df, c.name).collect() if r["share"]}
                spec.rules.append(Rule(name, c.name, {"kind": "seasonal", "by": "month", "weights": shares}))
    return spec
