"""Column profiles in one pass per table, and value statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.operators.quantiles import counted, exact_quantiles, kept, stacked_values

QUANTILES = (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
MONTHS = "January February March April May June July August September October November December".split()


def _moments(c: Column) -> tuple[Column, Column]:
    """Biased skewness and excess kurtosis."""
    return F.skewness(c), F.kurtosis(c)


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: counts, mean, deviation, range, quantiles, moments and type hints.

    Values are stacked to (column, value). What is summed needs no shuffle of them; distinct values
    and quantiles are those of the values counted once, see ``quantiles``.
    """
    tall = stacked_values(df, columns)
    v = F.col("value")
    skew, kurt = _moments(v)
    sums = tall.groupBy("column").agg(
        F.count("*").alias("n"), F.count_if(v.isNull()).alias("n_null"),
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        skew.alias("skewness"), kurt.alias("kurtosis"),
        F.bool_and(v % 1 == 0).alias("is_discrete"), F.bool_and(v > 0).alias("is_positive"),
        F.bool_and((v >= 0) & (v <= 1)).alias("is_bounded"),
    )
    counts = counted(tall)
    distinct = counts.groupBy("column").agg(F.count("*").alias("n_distinct"))
    out = sums.join(distinct, "column", "left").join(F.broadcast(exact_quantiles(counts, QUANTILES)), "column", "left")  # a row a column
    out = out.withColumn("n_distinct", F.coalesce("n_distinct", F.lit(0)))
    names = [f"p{round(q * 100)}" for q in QUANTILES]
    rest = [c for c in out.columns if c != "q"]
    out = out.select(*rest, *[F.col("q")[i].alias(n) for i, n in enumerate(names)])
    ratio = F.try_divide(F.col("n_distinct").cast("double"), F.col("n") - F.col("n_null"))
    return out.withColumns({"uniqueness": ratio, "is_unique": ratio > 0.99, "null_share": F.col("n_null") / F.col("n")})


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The k commonest values; equal counts in order of value."""
    return value_counts(df, column).orderBy(F.desc("n"), "value").limit(k)


def categorical_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: distinct values, top-1 and top-5 share, entropy in nats."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in columns)
    tall = df.selectExpr(f"stack({len(columns)}, {pairs}) as (column, value)").where("value is not null")
    counts = tall.groupBy("column", "value").agg(F.count("*").alias("c"))
    out = counts.groupBy("column").agg(
        F.sum("c").alias("n"), F.count("*").alias("n_distinct"), F.max("c").alias("top1"),
        F.sum(F.col("c") * F.log(F.col("c").cast("double"))).alias("clogc"),
    )
    # A window that is cut at a rank: tasks hand on their five greatest counts of a column.
    rank = F.row_number().over(W.partitionBy("column").orderBy(F.desc("c"), "value"))
    top = counts.withColumn("rank", rank).where("rank <= 5").groupBy("column").agg(F.sum("c").alias("top5"))
    out = out.join(top, "column")
    return out.select(
        "column", "n", "n_distinct", (F.col("top1") / F.col("n")).alias("top1_share"), (F.col("top5") / F.col("n")).alias("top5_share"),
        (F.log(F.col("n").cast("double")) - F.col("clogc") / F.col("n")).alias("entropy"),
    )


def month_shares(df: DataFrame, column: str) -> DataFrame:
    """(month, name, n, share) for all twelve months."""
    names = df.sparkSession.createDataFrame(list(enumerate(MONTHS, 1)), "month int, name string")
    counts = df.where(F.col(column).isNotNull()).groupBy(F.month(column).alias("_m")).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"))
    out = F.broadcast(names).join(counts, F.col("month") == F.col("_m"), "left").join(F.broadcast(total))
    n = F.coalesce("_n", F.lit(0))
    return out.select("month", "name", n.alias("n"), F.try_divide(n.cast("double"), F.col("_t")).alias("share"))


def time_profile(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """One row: range, median gap in days between rows in ``order``, and what that gap is called.

    ``granularity`` has the label by the gap's length; ``granularity_compat`` names a median of
    0 days "day", below 7 "week", below 30 "month". The gaps of ordered rows come from day
    counts: rows are counted per instant first, so no window runs over all rows.
    """
    micros = F.unix_micros(F.col(column).cast("timestamp"))
    per = df.where(F.col(column).isNotNull()).groupBy(micros.alias("t")).agg(F.count("*").alias("n"))
    year = F.floor(F.col("t") / (366 * 86_400_000_000))
    inside = W.partitionBy("year").orderBy("t")
    gaps = per.withColumn("year", year).withColumn("gap", F.col("t") - F.lag("t").over(inside))
    ends = gaps.groupBy("year").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    across = ends.select("year", (F.col("first") - F.lag("last").over(W.orderBy("year"))).alias("jump"))  # a row a year
    gaps = gaps.join(F.broadcast(across), "year").select("t", "n", F.coalesce("gap", "jump").alias("gap"))
    same = gaps.where("n > 1").select(F.lit(0).cast("long").alias("gap"), (F.col("n") - 1).alias("w"))
    steps = gaps.where("gap is not null").select("gap", F.lit(1).cast("long").alias("w")).union(same)
    gaps = steps.groupBy(F.lit("gap").alias("column"), F.col("gap").cast("double").alias("value")).agg(F.sum("w").alias("n"))
    median = exact_quantiles(kept(gaps), (0.5,)).agg((F.max(F.col("q")[0]) / 86_400_000_000).alias("median_gap_days"))  # null without gaps
    span = df.agg(F.min(column).alias("first"), F.max(column).alias("last"), F.count(column).alias("n"))
    g = F.col("median_gap_days")
    label = F.when(g < 1 / 24, "minute").when(g < 1, "hour").when(g < 7, "day").when(g < 28, "week").when(g < 365, "month").otherwise("year")
    compat = F.when(F.floor(g) == 0, "day").when(g < 7, "week").when(g < 30, "month").otherwise("year")
    return span.join(F.broadcast(median)).withColumns({"granularity": label, "granularity_compat": compat})


def trend(df: DataFrame, value: str, index: str) -> DataFrame:
    """One row: slope and intercept of ``value`` over ``index``."""
    y, x = F.col(value).cast("double"), F.col(index).cast("double")
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def correlations(df: DataFrame, columns: list[str], strong: float = 0.7) -> DataFrame:
    """(a, b, r, is_strong) for all pairs of columns, in one aggregate over one scan."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    stacked = ", ".join(f"'{a}', '{b}', r{i}" for i, (a, b) in enumerate(pairs))
    return row.selectExpr(f"stack({len(pairs)}, {stacked}) as (a, b, r)").withColumn("is_strong", F.abs("r") > strong)


def column_summaries(df: DataFrame, k: int = 100) -> DataFrame:
    """Numeric columns: min and max. Others: the k commonest values with their shares among these."""
    numeric = [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType))]
    text = [f.name for f in df.schema if isinstance(f.dataType, (T.StringType, T.BooleanType))]

    def as_double(c: str) -> Column:
        if isinstance(df.schema[c].dataType, T.NumericType):
            return F.col(c).cast("double")
        return F.unix_micros(F.col(c).cast("timestamp")).cast("double") * 1000

    parts = []
    if numeric:
        row = df.agg(*[f(as_double(c)).alias(f"{n}_{i}") for i, c in enumerate(numeric) for n, f in (("lo", F.min), ("hi", F.max))])
        stacked = ", ".join(f"'{c}', lo_{i}, hi_{i}" for i, c in enumerate(numeric))
        row = row.selectExpr(f"stack({len(numeric)}, {stacked}) as (column, low, high)")
        parts.append(row.select("column", "low", "high", F.lit(None).cast("string").alias("value"), F.lit(None).cast("double").alias("share")))
    if text:
        stacked = ", ".join(f"'{c}', cast(`{c}` as string)" for c in text)
        counts = df.selectExpr(f"stack({len(text)}, {stacked}) as (column, value)").where("value is not null").groupBy("column", "value").count()
        rank = F.row_number().over(W.partitionBy("column").orderBy(F.desc("count"), "value"))
        top = counts.withColumn("rank", rank).where(F.col("rank") <= k)
        total = F.sum("count").over(W.partitionBy("column"))
        none = F.lit(None).cast("double")
        parts.append(top.select("column", none.alias("low"), none.alias("high"), "value", (F.col("count") / total).alias("share")))
    return reduce(DataFrame.unionByName, parts)


def null_counts(df: DataFrame) -> DataFrame:
    """(column, n, n_null) of all columns."""
    row = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    stacked = ", ".join(f"'{c}', c{i}" for i, c in enumerate(df.columns))
    return row.selectExpr("n", f"stack({len(df.columns)}, {stacked}) as (column, n_null)").select("column", "n", "n_null")


def infer_types(df: DataFrame) -> DataFrame:
    """(column, n, sql_type) for string columns: the narrowest of BOOL, INT, FLOAT, DATE, DATETIME, TEXT all values fit."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    stacked = ", ".join(f"'{c}', nullif(trim(`{c}`), '')" for c in names)
    tall = df.selectExpr(f"stack({len(names)}, {stacked}) as (column, value)").where("value is not null")
    fits = lambda pattern: F.bool_and(F.rlike("value", F.lit(pattern)))
    out = tall.groupBy("column").agg(
        F.count("*").alias("n"), fits("(?i)^(true|false)$").alias("b"), fits(r"^[+-]?\d{1,18}$").alias("i"),
        fits(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$").alias("f"), fits(r"^\d{4}-\d{2}-\d{2}$").alias("d"),
        fits(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$").alias("t"),
    )
    kind = F.when(F.col("b"), "BOOL").when(F.col("i"), "INT").when(F.col("f"), "FLOAT").when(F.col("d"), "DATE").when(F.col("t"), "DATETIME")
    return out.select("column", "n", kind.otherwise("TEXT").alias("sql_type"))


def fit_distributions(df: DataFrame, column: str) -> DataFrame:
    """One row per family: parameters by maximum likelihood and the log-likelihood per value.

    Families: normal, lognormal, exponential, pareto (values above 0), uniform, poisson (whole
    values from 0). All parameters and likelihoods are closed forms of one aggregate's moments.
    """
    x = F.col(column).cast("double")
    ok = F.when(x > 0, F.log(x))
    whole = F.bool_and((x >= 0) & (x % 1 == 0))
    m = df.where(x.isNotNull() & ~F.isnan(x)).agg(
        F.count("*").cast("double").alias("n"), F.avg(x).alias("m"), F.stddev_pop(x).alias("s"), F.min(x).alias("lo"), F.max(x).alias("hi"),
        F.avg(ok).alias("lm"), F.stddev_pop(ok).alias("ls"), whole.alias("whole"), F.avg(F.when(x >= 0, F.expr(f"ln(greatest(cast(factorial(least(cast(`{column}` as int), 20)) as double), 1))"))).alias("lf"),
    )
    two_pi = 1.8378770664093453
    pos = F.col("lo") > 0
    alpha = 1 / (F.col("lm") - F.log("lo"))
    rows = [
        ("normal", F.col("m"), F.col("s"), -0.5 * (two_pi + 1) - F.log("s")),
        ("lognormal", F.when(pos, F.col("lm")), F.when(pos, F.col("ls")), F.when(pos, -0.5 * (two_pi + 1) - F.log("ls") - F.col("lm"))),
        ("exponential", F.when(F.col("lo") >= 0, F.col("m")), F.lit(None).cast("double"), F.when(F.col("lo") >= 0, -F.log("m") - 1)),
        ("pareto", F.when(pos, alpha), F.when(pos, F.col("lo")), F.when(pos, F.log(alpha) + alpha * F.log("lo") - (alpha + 1) * F.col("lm"))),
        ("uniform", F.col("lo"), F.col("hi"), -F.log(F.col("hi") - F.col("lo"))),
        ("poisson", F.when(F.col("whole"), F.col("m")), F.lit(None).cast("double"),
         F.when(F.col("whole") & (F.col("hi") <= 20), F.col("m") * F.log("m") - F.col("m") - F.col("lf"))),
    ]
    table = F.array(*[F.struct(F.lit(n).alias("family"), a.alias("a"), b.alias("b"), ll.alias("loglik")) for n, a, b, ll in rows])
    return m.select(F.explode(table).alias("r")).select("r.*").where("loglik is not null")
