"""Fidelity statistics between frames, as grouped aggregates.

Two-sample statistics first count both samples per distinct value; running sums over distinct
values go through ``ordered.running``, so no single task sorts all values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.functions.special import normal_cdf
from weftspark.operators.ordered import numbered, running


def _counts(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    x = F.col(column).cast("double")
    one = a.where(x.isNotNull() & ~F.isnan(x)).select(x.alias("x"), F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    two = b.where(x.isNotNull() & ~F.isnan(x)).select(x.alias("x"), F.lit(0).cast("long").alias("a"), F.lit(1).cast("long").alias("b"))
    return one.union(two).groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def two_sample(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: ks, wasserstein, ks_complement, n_a, n_b of two samples of a numeric column.

    The first three are null where a sample has no value.
    """
    counts = _counts(a, b, column)
    total = counts.agg(F.sum("a").alias("_na"), F.sum("b").alias("_nb"))
    run = running(counts, "x", ["a", "b"], nexts=True).join(F.broadcast(total))
    gap = F.abs(F.try_divide("run_a", "_na") - F.try_divide("run_b", "_nb"))
    both = (F.max("_na") > 0) & (F.max("_nb") > 0)
    out = run.select(gap.alias("gap"), (F.col("next_x") - F.col("x")).alias("step"), "_na", "_nb")
    return out.agg(
        F.max("gap").alias("ks"), F.when(both, F.coalesce(F.sum(F.col("gap") * F.col("step")), F.lit(0.0))).alias("wasserstein"),
        (1 - F.max("gap")).alias("ks_complement"), F.max("_na").alias("n_a"), F.max("_nb").alias("n_b"),
    )


def poisson_cdf(k: Column, mean: Column) -> Column:
    """P(X <= k) for whole k, term by term."""
    def step(acc: Column, i: Column) -> Column:
        term = acc["p"] * mean / i
        return F.struct(term.alias("p"), (acc["s"] + term).alias("s"))

    first = F.exp(-mean)
    terms = F.sequence(F.lit(1).cast("long"), F.greatest(k.cast("long"), F.lit(1)))
    upto = F.aggregate(terms, F.struct(first.alias("p"), first.alias("s")), step, lambda acc: acc["s"])
    return F.when(k < 0, 0.0).when(k < 1, first).otherwise(F.least(upto, F.lit(1.0)))


def ks_fitted(df: DataFrame, column: str, family: str) -> DataFrame:
    """One row: KS distance of a column to a family with the parameters fitted to it.

    Families: uniform, normal, lognormal; exponential and pareto from 0; poisson of whole numbers.
    """
    x = F.col(column).cast("double")
    values = df.where(x.isNotNull() & ~F.isnan(x)).select((F.log(x) if family == "lognormal" else x).alias("x")).where("x is not null")
    counts = values.groupBy("x").agg(F.count("*").alias("c"))
    fit = values.agg(
        F.count("*").alias("_n"), F.min("x").alias("_lo"), F.max("x").alias("_hi"), F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"),
        F.avg(F.when(F.col("x") > 0, F.log("x"))).alias("_lm"),
    )
    run = running(counts, "x", ["c"]).join(F.broadcast(fit))
    if family == "uniform":
        cdf = F.try_divide(F.col("x") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    elif family in ("normal", "lognormal"):
        cdf = normal_cdf(F.try_divide(F.col("x") - F.col("_m"), F.col("_s")))
    elif family == "exponential":
        cdf = F.when(F.col("x") < 0, 0.0).otherwise(1 - F.exp(-F.try_divide(F.col("x"), F.col("_m"))))
    elif family == "pareto":
        alpha = F.try_divide(F.lit(1.0), F.col("_lm") - F.log("_lo"))
        cdf = F.when(F.col("_lo") > 0, 1 - F.pow(F.col("_lo") / F.col("x"), alpha))
    elif family == "poisson":
        cdf = poisson_cdf(F.floor("x"), F.col("_m"))
    else:
        raise ValueError(f"no such family: {family}")
    # A whole-number family jumps where the sample does: just below a value its CDF is that of the one before.
    lower = poisson_cdf(F.ceil("x") - 1, F.col("_m")) if family == "poisson" else cdf
    above = F.abs(F.col("run_c") / F.col("_n") - cdf)
    below = F.abs((F.col("run_c") - F.col("c")) / F.col("_n") - lower)
    return run.agg(F.max(F.greatest(above, below)).alias("ks"), F.max("_n").alias("n"))


def ks_of_families(df: DataFrame, column: str, families: list[str]) -> DataFrame:
    """(family, ks, n): KS distance of a column to each family fitted to it, in one pass for all.

    The values are counted and summed up once; every family's gap is taken at the same places.
    Lognormal and pareto need positive values: else, and without values, ks is null.
    """
    x = F.col(column).cast("double")
    values = df.where(x.isNotNull() & ~F.isnan(x)).select(x.alias("x"))
    ln = F.when(F.col("x") > 0, F.log("x"))
    fit = values.agg(
        F.count("*").alias("_n"), F.min("x").alias("_lo"), F.max("x").alias("_hi"), F.avg("x").alias("_m"), F.stddev_pop("x").alias("_s"),
        F.avg(ln).alias("_lm"), F.stddev_pop(ln).alias("_ls"),
    )
    run = running(values.groupBy("x").agg(F.count("*").alias("c")), "x", ["c"]).join(F.broadcast(fit))  # one row
    v, lo, m = F.col("x"), F.col("_lo"), F.col("_m")
    positive = lambda cdf: F.when(lo > 0, cdf)
    cdfs = {
        "uniform": lambda: F.try_divide(v - lo, F.col("_hi") - lo),
        "normal": lambda: normal_cdf(F.try_divide(v - m, F.col("_s"))),
        "lognormal": lambda: positive(normal_cdf(F.try_divide(F.log(v) - F.col("_lm"), F.col("_ls")))),
        "exponential": lambda: F.when(v < 0, 0.0).otherwise(1 - F.exp(-F.try_divide(v, m))),
        "pareto": lambda: positive(1 - F.pow(lo / v, F.try_divide(F.lit(1.0), F.col("_lm") - F.log(lo)))),
        "poisson": lambda: poisson_cdf(F.floor(v), m),
    }
    gaps = []
    for f in families:
        cdf = cdfs[f]()
        lower = poisson_cdf(F.ceil(v) - 1, m) if f == "poisson" else cdf
        above, below = F.abs(F.col("run_c") / F.col("_n") - cdf), F.abs((F.col("run_c") - F.col("c")) / F.col("_n") - lower)
        gaps.append(F.max(F.greatest(above, below)).alias(f))
    row = run.agg(F.max("_n").alias("n"), *gaps)
    return row.selectExpr("n", f"stack({len(families)}, " + ", ".join(f"'{f}', {f}" for f in families) + ") as (family, ks)").select("family", "ks", "n")


def rank_frequency_fit(df: DataFrame, column: str) -> DataFrame:
    """One row: R^2 and exponent of ln(count) over ln(rank); (0, 0) below two distinct values. Equal counts rank in order of value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("c"))
    ranked, _ = numbered(counts.select((-F.col("c")).alias("_neg"), "v", "c"), ["_neg", "v"])
    ranked = ranked.withColumn("rank", F.col("number") + 1)
    y, x = F.log(F.col("c").cast("double")), F.log(F.col("rank").cast("double"))
    out = ranked.agg(F.regr_r2(y, x).alias("r2"), (-F.regr_slope(y, x)).alias("exponent"), F.count("*").alias("k"))
    few = F.col("k") < 2
    return out.select(*[F.when(few, 0.0).otherwise(F.col(c)).alias(c) for c in ("r2", "exponent")], F.col("k").alias("n_values"))


def gini(df: DataFrame, column: str) -> DataFrame:
    """One row: Gini coefficient of the positive values, from value counts in value order."""
    x = F.col(column).cast("double")
    counts = df.where(x > 0).groupBy(x.alias("x")).agg(F.count("*").cast("long").alias("c"))
    run = running(counts, "x", ["c"])
    # A value with c copies ending at rank r has ranks r - c + 1 to r; their sum is c (2r - c + 1) / 2.
    ranks = F.col("c") * (2 * F.col("run_c") - F.col("c") + 1) / 2.0
    out = run.agg(F.sum(ranks * F.col("x")).alias("_rx"), F.sum(F.col("c") * F.col("x")).alias("_sx"), F.sum("c").alias("n"))
    n = F.col("n")
    return out.select((2 * F.col("_rx") / (n * F.col("_sx")) - (n + 1) / n).alias("gini"), "n")


def top_k_share(df: DataFrame, column: str, k: int) -> DataFrame:
    """One row: share of the k greatest values in the sum."""
    top = df.where(F.col(column).isNotNull()).orderBy(F.desc(column)).limit(k).agg(F.sum(column).alias("_t"))
    return df.agg(F.sum(column).alias("_s")).join(F.broadcast(top)).select(F.try_divide(F.col("_t").cast("double"), F.col("_s")).alias("share"))


def chi_square(df: DataFrame, column: str, expected: dict[str, float] | None = None) -> DataFrame:
    """One row: statistic and degrees of freedom against shares (uniform over the values, if none).

    Without values the statistic is null and the freedom 0.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias("o"))
    if expected is None:
        total = counts.agg(F.sum("o").alias("_n"), F.count("*").alias("_k"))
        cells = counts.join(F.broadcast(total)).withColumn("e", F.col("_n") / F.col("_k"))
    else:
        want = df.sparkSession.createDataFrame(list(expected.items()), "w string, p double")
        total = counts.agg(F.sum("o").alias("_n"))
        cells = counts.join(F.broadcast(want), F.col("v") == F.col("w"), "full").join(F.broadcast(total))
        cells = cells.select(F.coalesce("o", F.lit(0)).alias("o"), (F.coalesce("p", F.lit(0.0)) * F.col("_n")).alias("e"))
    cells = cells.where((F.col("o") > 0) | (F.col("e") > 0))
    term = F.when(F.col("e") > 0, F.pow(F.col("o") - F.col("e"), F.lit(2.0)) / F.col("e")).otherwise(F.lit(float("inf")))
    return cells.agg(F.sum(term).alias("statistic"), F.greatest(F.count("*") - 1, F.lit(0)).alias("freedom"))


def categorical_two_sample(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: chi-squared of b against a's shares, total variation and its complement; null where a side has no value."""
    side = lambda df, n: df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias(n))
    x, y = side(a, "a"), side(b, "b")
    both = x.join(y, "v", "full").select(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    total = x.agg(F.sum("a").alias("_na")).join(F.broadcast(y.agg(F.sum("b").alias("_nb"))))
    both = both.join(F.broadcast(total)).withColumn("e", F.col("a") / F.col("_na") * F.col("_nb"))
    chi = F.when(F.col("e") > 0, F.pow(F.col("b") - F.col("e"), F.lit(2.0)) / F.col("e")).when(F.col("e").isNotNull(), F.when(F.col("b") > 0, F.lit(float("inf"))).otherwise(0.0))
    gap = F.abs(F.col("a") / F.col("_na") - F.col("b") / F.col("_nb"))
    return both.agg(F.sum(chi).alias("chi2"), (F.sum(gap) / 2).alias("tv"), (1 - F.sum(gap) / 2).alias("tv_complement"), F.count("*").alias("k"))


def _average_ranks(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("c"))
    return running(counts, "x", ["c"]).select("x", (F.col("run_c") - (F.col("c") - 1) / 2.0).alias("rank"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: Pearson r of the average ranks, pairs with a NULL left out."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    pairs = rows.groupBy("a", "b").agg(F.count("*").alias("w"))
    ra = _average_ranks(rows.select(F.col("a").alias("x")), "x").withColumnsRenamed({"x": "a", "rank": "ra"})
    rb = _average_ranks(rows.select(F.col("b").alias("x")), "x").withColumnsRenamed({"x": "b", "rank": "rb"})
    t = pairs.join(ra, "a").join(rb, "b")
    s = lambda e: F.sum(F.col("w") * e)
    m = t.agg(F.sum("w").alias("n"), s(F.col("ra")).alias("x"), s(F.col("rb")).alias("y"), s(F.col("ra") * F.col("rb")).alias("xy"),
              s(F.col("ra") * F.col("ra")).alias("xx"), s(F.col("rb") * F.col("rb")).alias("yy"))
    n, x, y = F.col("n").cast("double"), F.col("x"), F.col("y")
    top = F.col("xy") - x * y / n
    return m.select(F.try_divide(top, F.sqrt((F.col("xx") - x * x / n) * (F.col("yy") - y * y / n))).alias("spearman"))


def mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mutual information in nats of two categorical columns."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c"))
    xs, ys = cells.groupBy("a").agg(F.sum("c").alias("ca")), cells.groupBy("b").agg(F.sum("c").alias("cb"))
    n = cells.agg(F.sum("c").alias("n"))
    t = cells.join(xs, "a").join(ys, "b").join(F.broadcast(n))
    c = F.col("c").cast("double")
    return t.agg(F.sum(c / F.col("n") * F.log(c * F.col("n") / (F.col("ca") * F.col("cb")))).alias("mi"))


def contingency_similarity(a: DataFrame, b: DataFrame, columns: tuple[str, str]) -> DataFrame:
    """One row: 1 minus half the L1 distance of two contingency tables of shares; 0 against an empty side, null if both are."""
    key = F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(columns)])
    side = lambda df, n: df.groupBy(key.alias("k")).agg(F.count("*").alias(n))
    x, y = side(a, "a"), side(b, "b")
    total = x.agg(F.sum("a").alias("_na")).join(F.broadcast(y.agg(F.sum("b").alias("_nb"))))
    both = x.join(y, "k", "full").join(F.broadcast(total))
    gap = F.abs(F.coalesce("a", F.lit(0)) / F.col("_na") - F.coalesce("b", F.lit(0)) / F.col("_nb"))
    return both.agg(F.when(F.count("*") > 0, F.coalesce(1 - F.sum(gap) / 2, F.lit(0.0))).alias("similarity"))


def correlation_similarity(a: DataFrame, b: DataFrame, columns: tuple[str, str]) -> DataFrame:
    """One row: 1 - |r_a - r_b| / 2, and both r."""
    r = lambda df, n: df.agg(F.corr(*[F.col(c).cast("double") for c in columns]).alias(n))
    out = r(a, "r_a").join(F.broadcast(r(b, "r_b")))
    return out.withColumn("similarity", 1 - F.abs(F.col("r_a") - F.col("r_b")) / 2)


def range_similarity(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: length of the common range by the length of the whole one; 0 against a side without values, null if both have none."""
    ends = lambda df, n: df.agg(F.min(column).cast("double").alias(f"lo_{n}"), F.max(column).cast("double").alias(f"hi_{n}"))
    t = ends(a, "a").join(F.broadcast(ends(b, "b")))
    common = F.greatest(F.least("hi_a", "hi_b") - F.greatest("lo_a", "lo_b"), F.lit(0.0))
    whole = F.greatest("hi_a", "hi_b") - F.least("lo_a", "lo_b")
    lacks = (F.col("lo_a").isNull().cast("int") + F.col("lo_b").isNull().cast("int"))
    found = F.when(lacks == 1, 0.0).when(lacks == 0, F.when(whole == 0, 1.0).otherwise(F.try_divide(common, whole)))
    return t.select(found.alias("similarity"))


def domain_similarity(a: DataFrame, b: DataFrame, column: str, weight: float = 0.5) -> DataFrame:
    """One row: weight * Jaccard of the values + (1 - weight) * common mass of the shares; 0 against a
    side without values, null if both have none."""
    side = lambda df, n: df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("v")).agg(F.count("*").alias(n))
    x, y = side(a, "a"), side(b, "b")
    total = x.agg(F.sum("a").alias("_na")).join(F.broadcast(y.agg(F.sum("b").alias("_nb"))))
    both = x.join(y, "v", "full").join(F.broadcast(total))
    common = F.try_divide(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()), F.count("*"))
    part = lambda n: F.coalesce(F.col(n) / F.col(f"_n{n}"), F.lit(0.0))
    mass = F.sum(F.least(part("a"), part("b")))
    return both.agg(F.when(F.count("*") > 0, weight * common + (1 - weight) * mass).alias("similarity"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays, the shorter one padded with 0, held within [0, 1]."""
    zero = lambda x: F.coalesce(x.cast("double"), F.lit(0.0))
    products = F.zip_with(a, b, lambda x, y: zero(x) * zero(y))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, x: acc + x)
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: zero(x) * zero(x))))
    return F.least(F.greatest(F.coalesce(F.try_divide(total(products), norm(a) * norm(b)), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def moment_similarity(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row: 0.4 of the ranges' similarity and 0.3 each of how near means and deviations are.

    Nearness of two figures is 1 - min(1, |x - y| / max(|x|, |y|)), and 1 where both are 0. It is 0
    against a side without values, null if both have none.
    """
    side = lambda df, n: df.agg(F.avg(F.col(column).cast("double")).alias(f"m_{n}"), F.coalesce(F.stddev_samp(F.col(column).cast("double")), F.lit(0.0)).alias(f"s_{n}"))
    t = side(a, "a").join(F.broadcast(side(b, "b"))).join(F.broadcast(range_similarity(a, b, column)))
    near = lambda x, y: 1 - F.least(F.lit(1.0), F.coalesce(F.try_divide(F.abs(F.col(x) - F.col(y)), F.greatest(F.abs(x), F.abs(y))), F.lit(0.0)))
    whole = 0.4 * F.col("similarity") + 0.3 * near("m_a", "m_b") + 0.3 * near("s_a", "s_b")
    lacks = F.col("m_a").isNull() != F.col("m_b").isNull()
    return t.select(F.when(lacks, 0.0).when(F.col("m_a").isNotNull(), whole).alias("similarity"))


def word_jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of lower-cased words of two texts."""
    words = lambda t: F.array_remove(F.array_distinct(F.split(F.lower(t), r"\s+")), "")
    x, y = words(a), words(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)).cast("double"), F.size(F.array_union(x, y))), F.lit(0.0))
