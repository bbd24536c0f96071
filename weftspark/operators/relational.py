"""Joins between facts and dimensions, and measures of referential integrity.

Joins are left to adaptive execution: a side below Spark's broadcast threshold is sent, any
other is shuffled on its key, with skewed partitions split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(fact: DataFrame, dims: dict[str, tuple[DataFrame, str, str]], columns: dict[str, list[str]] | None = None) -> DataFrame:
    """Left equi-joins of ``fact`` with {name: (dim, fact key, dim key)}.

    Only the named columns of a dimension come along (all, if none are named); a name that is
    taken gets the suffix _<dimension>. The dimension's key itself does not come along.
    """
    for name, (dim, key, dim_key) in dims.items():
        wanted = [c for c in (columns or {}).get(name, dim.columns) if c != dim_key]
        renamed = {c: f"{c}_{name}" if c in fact.columns else c for c in wanted}
        side = dim.select(F.col(dim_key).alias(f"_{name}_key"), *[F.col(c).alias(n) for c, n in renamed.items()])
        fact = fact.join(side, fact[key] == side[f"_{name}_key"], "left").drop(f"_{name}_key")
    return fact


def covered(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose key exists in the parent (NULL does not)."""
    return child.join(parent.select(F.col(pk).alias("_pk")), F.col(fk) == F.col("_pk"), "left_semi")


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Child rows whose key does not exist in the parent, NULL keys among them."""
    return child.join(parent.select(F.col(pk).alias("_pk")), F.col(fk) == F.col("_pk"), "left_anti")


def fk_coverage(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """One row: n, n_covered and coverage (1.0 for an empty child).

    The child is first counted per key, so what is joined has a row per distinct key.
    """
    keys = child.groupBy(F.col(fk).alias("_fk")).agg(F.count("*").alias("_n"))
    parents = parent.select(F.col(pk).alias("_pk")).distinct()
    joined = keys.join(parents, F.col("_fk") == F.col("_pk"), "left")
    out = joined.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("_pk").isNotNull(), F.col("_n"))), F.lit(0)).alias("n_covered"),
    )
    return out.withColumn("coverage", F.when(F.col("n") == 0, 1.0).otherwise(F.try_divide(F.col("n_covered").cast("double"), F.col("n"))))


def degrees(parent: DataFrame, pk: str, child: DataFrame, fk: str) -> DataFrame:
    """(key, degree): children of every parent, 0 included. The child is counted before the join."""
    counts = child.where(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("_fk")).agg(F.count("*").alias("_n"))
    keys = parent.select(F.col(pk).alias("key")).distinct()
    return keys.join(counts, F.col("key") == F.col("_fk"), "left").select("key", F.coalesce("_n", F.lit(0)).alias("degree"))


def degree_counts(parent: DataFrame, pk: str, child: DataFrame, fk: str) -> DataFrame:
    """(degree, n_parents): the exact degree histogram."""
    return degrees(parent, pk, child, fk).groupBy("degree").agg(F.count("*").alias("n_parents"))


def degree_histogram(parent: DataFrame, pk: str, child: DataFrame, fk: str) -> DataFrame:
    """(bin, low, high, n_parents) with automatic bins: the finer of Sturges and Freedman-Diaconis.

    Bins are at least 1 wide, as degrees are whole numbers.
    """
    d = degrees(parent, pk, child, fk)
    s = d.agg(
        F.count("*").alias("n"), F.min("degree").alias("lo"), F.max("degree").alias("hi"),
        F.percentile(F.col("degree").cast("double"), F.array(F.lit(0.25), F.lit(0.75))).alias("q"),
    )
    span = (F.col("hi") - F.col("lo")).cast("double")
    sturges = span / (F.log2(F.col("n")) + 1)
    freedman = 2 * (F.col("q")[1] - F.col("q")[0]) / F.pow(F.col("n").cast("double"), F.lit(1 / 3))
    width = F.greatest(F.when(freedman > 0, F.least(freedman, sturges)).otherwise(sturges), F.lit(1.0))
    bins = F.greatest(F.ceil(span / width), F.lit(1)).cast("int")
    s = s.select("lo", "hi", span.alias("span"), bins.alias("bins"))
    at = F.when(F.col("span") == 0, 0).otherwise(
        F.least(F.floor((F.col("degree") - F.col("lo")) * F.col("bins") / F.col("span")), F.col("bins") - 1)
    )
    put = d.join(F.broadcast(s)).groupBy(at.cast("int").alias("bin"), "lo", "span", "bins").agg(F.count("*").alias("n_parents"))
    edge = lambda i: F.col("lo") + i * F.col("span") / F.col("bins")
    return put.select("bin", edge(F.col("bin")).alias("low"), edge(F.col("bin") + 1).alias("high"), "n_parents")


def join_selectivity(joined: DataFrame, base: DataFrame) -> DataFrame:
    """One row: rows of a join by rows of its base table."""
    a, b = joined.agg(F.count("*").alias("n_joined")), base.agg(F.count("*").alias("n_base"))
    return a.join(F.broadcast(b)).withColumn("selectivity", F.try_divide(F.col("n_joined").cast("double"), F.col("n_base")))


def sample_keys(n: int, parent: DataFrame, pk: str, seed: int = 7) -> DataFrame:
    """(row, key): n uniform draws of parent keys.

    The parent's numeric keys are numbered bucket by bucket; rows draw a number.
    """
    from weftspark.operators.ordered import numbered

    keys, count = numbered(parent.select(F.col(pk).alias("key")).distinct(), ["key"])
    rows = parent.sparkSession.range(n).withColumn("_at", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(max(count, 1))))
    return rows.join(keys, F.col("_at") == F.col("number")).select(F.col("id").alias("row"), "key")
