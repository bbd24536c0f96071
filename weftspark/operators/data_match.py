"""Schema matching by what the data say: ranges, domains, cardinalities and dependencies.

Every term is a small frame with a row for a column, a table or a pair of these. What is read of
the data is one aggregate a table for ranges and row counts, and one grouping of the text columns
for domains, of which the commonest values of a column go on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftspark.operators.matching import NUMERIC, TIMES, assign, role_similarity, trigram_similarity

# Weights of the terms of a column pair and of a table pair, and decays of differences.
COLUMN_WEIGHTS = {"name": 0.1, "range": 0.4, "role": 0.3, "dependency": 0.2}
TABLE_WEIGHTS = {"name": 0.1, "columns": 0.6, "cardinality": 0.1, "dependency": 0.1}
DECAY_LEFT, DECAY_RIGHT, DECAY_ROWS = 0.5, 0.5, 0.4
#: Values of a text column that make its domain.
DOMAIN_VALUES = 100


def _unioned(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """(tab, n): row counts."""
    return _unioned([df.agg(F.count("*").alias("n")).select(F.lit(t).alias("tab"), "n") for t, df in tables.items()])


def column_ranges(tables: dict[str, DataFrame], schema: DataFrame) -> DataFrame:
    """(tab, col, lo, hi) of the number and time columns of ``schema``, times in seconds; one scan a table.

    Columns without values, and those that a table lacks, have no row.
    """
    kinds = schema.where(F.col("sql_type").isin(*NUMERIC, *TIMES)).select("tab", "col", "sql_type").collect()  # a row a column
    parts = []
    for t, df in tables.items():
        columns = [(r["col"], r["sql_type"] in TIMES) for r in kinds if r["tab"] == t and r["col"] in df.columns]
        if not columns:
            continue
        x = [(F.col(f"`{c}`").cast("timestamp") if time else F.col(f"`{c}`")).cast("double") for c, time in columns]
        row = df.agg(*[f(F.nanvl(v, F.lit(None).cast("double"))).alias(f"{n}{i}") for i, v in enumerate(x) for n, f in (("lo", F.min), ("hi", F.max))])
        stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi")) for i, (c, _) in enumerate(columns)]))
        parts.append(row.select(F.lit(t).alias("tab"), stacked.alias("s")).select("tab", "s.*"))
    empty = schema.sparkSession.createDataFrame([], "tab string, col string, lo double, hi double")
    return _unioned([empty, *parts]).where("lo is not null")


def column_domains(tables: dict[str, DataFrame], schema: DataFrame, values: int = DOMAIN_VALUES) -> DataFrame:
    """(tab, col, value, share): the commonest values of the other columns, shares among these.

    Equal counts go in order of value.
    """
    kinds = schema.where(~F.col("sql_type").isin(*NUMERIC, *TIMES)).select("tab", "col").collect()  # a row a column
    parts = []
    for t, df in tables.items():
        columns = [r["col"] for r in kinds if r["tab"] == t and r["col"] in df.columns]
        if columns:
            pair = F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
            parts.append(df.select(F.lit(t).alias("tab"), pair.alias("s")).select("tab", "s.*"))
    empty = schema.sparkSession.createDataFrame([], "tab string, col string, value string")
    counts = _unioned([empty, *parts]).where("value is not null").groupBy("tab", "col", "value").agg(F.count("*").alias("n"))
    each = W.partitionBy("tab", "col")
    top = counts.withColumn("rank", F.row_number().over(each.orderBy(F.desc("n"), "value"))).where(F.col("rank") <= values)
    return top.select("tab", "col", "value", (F.col("n") / F.sum("n").over(each)).alias("share"))


def dependency_counts(schema: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(tab, col, n_left, n_right): in how many dependencies (tab, lhs, rhs) a column stands on a side.

    ``lhs`` and ``rhs`` are lists of columns joined by commas.
    """
    sides = [dependencies.select("tab", F.explode(F.array_distinct(F.split(s, ","))).alias("col"), F.lit(s).alias("side")) for s in ("lhs", "rhs")]
    counts = sides[0].union(sides[1]).groupBy("tab", "col").agg(F.count_if(F.col("side") == "lhs").alias("n_left"), F.count_if(F.col("side") == "rhs").alias("n_right"))
    found = schema.select("tab", "col").join(counts, ["tab", "col"], "left")
    return found.select("tab", "col", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_left", "n_right")])


def dependency_signatures(schema: DataFrame, dependencies: DataFrame) -> DataFrame:
    """(tab, signature) of every table: number of dependencies; mean length of left and right sides;
    columns in any; greatest, then least lengths; how many have a single column on the left, on the right."""
    parts = dependencies.select("tab", F.split("lhs", ",").alias("l"), F.split("rhs", ",").alias("r"))
    left, right = F.size("l"), F.size("r")
    figures = parts.groupBy("tab").agg(
        F.count("*").alias("f0"), F.avg(left).alias("f1"), F.avg(right).alias("f2"),
        F.size(F.array_distinct(F.flatten(F.collect_set(F.concat("l", "r"))))).alias("f3"),
        F.max(left).alias("f4"), F.max(right).alias("f5"), F.min(left).alias("f6"), F.min(right).alias("f7"),
        F.count_if(left == 1).alias("f8"), F.count_if(right == 1).alias("f9"),
    )
    found = schema.select("tab").distinct().join(figures, "tab", "left")
    return found.select("tab", F.array(*[F.coalesce(F.col(f"f{i}").cast("double"), F.lit(0.0)) for i in range(10)]).alias("signature"))


def dependency_similarity(left_a: Column, right_a: Column, left_b: Column, right_b: Column) -> Column:
    """Exponential decay of the differences of two columns' counts."""
    return F.exp(-DECAY_LEFT * F.abs(left_a - left_b) - DECAY_RIGHT * F.abs(right_a - right_b))


def signature_similarity(a: Column, b: Column) -> Column:
    """Cosine, 1 for two zero vectors, 0 against one."""
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x * x)))
    zeros = (norm(a) == 0).cast("int") + (norm(b) == 0).cast("int")
    return F.when(zeros == 2, 1.0).when(zeros == 1, 0.0).otherwise(F.greatest(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0)))


def cardinality_similarity(n: Column, m: Column) -> Column:
    """Exponential decay of the difference of the logarithms of two row counts."""
    return F.exp(-DECAY_ROWS * F.abs(F.log(n + F.lit(1.0)) - F.log(m + F.lit(1.0))))


def _named(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])


def range_similarities(real: dict[str, DataFrame], made: dict[str, DataFrame], real_schema: DataFrame, made_schema: DataFrame, weight: float = 0.5) -> DataFrame:
    """(r_tab, r_col, m_tab, m_col, range) of column pairs that have something in common.

    Numbers, and times: the common range by the whole one, 0 where that is a point. Others: ``weight``
    of the Jaccard similarity of their domains and the rest of the common mass of their shares.
    Domains meet in a join on the value.
    """
    family = F.when(F.col("sql_type").isin(*TIMES), "time").otherwise("number")
    ends = lambda tables, schema, p: _named(column_ranges(tables, schema).join(schema.select("tab", "col", family.alias("family")), ["tab", "col"]), p)
    a, b = ends(real, real_schema, "r"), ends(made, made_schema, "m")
    common = F.least("r_hi", "m_hi") - F.greatest("r_lo", "m_lo")
    whole = F.greatest("r_hi", "m_hi") - F.least("r_lo", "m_lo")
    key = ["r_tab", "r_col", "m_tab", "m_col"]
    numbers = a.join(b, F.col("r_family") == F.col("m_family")).select(*key, F.try_divide(common, whole).alias("range")).where("range > 0")
    x, y = _named(column_domains(real, real_schema), "r"), _named(column_domains(made, made_schema), "m")
    sizes = lambda df, p: df.groupBy(f"{p}_tab", f"{p}_col").agg(F.count("*").alias(f"{p}_n"))
    met = x.join(y, F.col("r_value") == F.col("m_value")).groupBy(*key).agg(F.count("*").alias("both"), F.sum(F.least("r_share", "m_share")).alias("mass"))
    met = met.join(sizes(x, "r"), ["r_tab", "r_col"]).join(sizes(y, "m"), ["m_tab", "m_col"])
    jaccard = F.col("both") / (F.col("r_n") + F.col("m_n") - F.col("both"))
    return numbers.union(met.select(*key, (weight * jaccard + (1 - weight) * F.col("mass")).alias("range")))


def column_scores(
    real: dict[str, DataFrame], made: dict[str, DataFrame], real_schema: DataFrame, made_schema: DataFrame,
    real_dependencies: DataFrame, made_dependencies: DataFrame, weights: dict[str, float] | None = None,
) -> DataFrame:
    """(r_tab, r_col, m_tab, m_col, name, range, role, dependency, score) of pairs of fitting types."""
    weights = weights or COLUMN_WEIGHTS
    family = F.when(F.col("sql_type").isin(*NUMERIC), "number").when(F.col("sql_type").isin(*TIMES), "time").otherwise(F.col("sql_type"))
    side = lambda schema, found, p: _named(schema.select("tab", "col", "role", family.alias("family")).join(dependency_counts(schema, found), ["tab", "col"]), p)
    pairs = side(real_schema, real_dependencies, "r").join(side(made_schema, made_dependencies, "m"), F.col("r_family") == F.col("m_family"))
    key = ["r_tab", "r_col", "m_tab", "m_col"]
    pairs = pairs.join(range_similarities(real, made, real_schema, made_schema), key, "left")
    terms = {
        "name": trigram_similarity(F.col("r_col"), F.col("m_col")), "range": F.coalesce("range", F.lit(0.0)),
        "role": role_similarity(F.col("r_role"), F.col("m_role")),
        "dependency": dependency_similarity(F.col("r_n_left"), F.col("r_n_right"), F.col("m_n_left"), F.col("m_n_right")),
    }
    out = pairs.select(*key, *[t.alias(n) for n, t in terms.items()])
    return out.withColumn("score", sum((w * F.col(n) for n, w in weights.items()), F.lit(0.0)))


def table_scores(
    columns: DataFrame, real: dict[str, DataFrame], made: dict[str, DataFrame], real_schema: DataFrame, made_schema: DataFrame,
    real_dependencies: DataFrame, made_dependencies: DataFrame, weights: dict[str, float] | None = None,
) -> DataFrame:
    """(r_tab, m_tab, name, columns, cardinality, dependency, score) of all pairs of tables.

    ``columns`` is the greatest sum of scores of columns assigned one to one, by the greater number
    of columns; the assignment of a pair of tables is a small problem on the driver.
    """
    spark, weights = real_schema.sparkSession, weights or TABLE_WEIGHTS
    wide = {p: {r["tab"]: r["n"] for r in s.groupBy("tab").agg(F.count("*").alias("n")).collect()} for p, s in (("r", real_schema), ("m", made_schema))}
    found: dict[tuple[str, str], dict[tuple[str, str], float]] = {}
    for r in columns.collect():  # a row a pair of columns of the schemas
        found.setdefault((r["r_tab"], r["m_tab"]), {})[r["r_col"], r["m_col"]] = max(r["score"], 0.0)
    rows = []
    for a in wide["r"]:
        for b in wide["m"]:
            scores = found.get((a, b), {})
            xs, ys = sorted({x for x, _ in scores}), sorted({y for _, y in scores})
            grid = [[scores.get((x, y), 0.0) for y in ys] for x in xs]
            total = sum(grid[i][j] for i, j in assign(grid))
            rows.append((a, b, min(1.0, total / max(wide["r"][a], wide["m"][b]))))
    aligned = spark.createDataFrame(rows, "r_tab string, m_tab string, columns double")
    side = lambda tables, schema, deps, p: _named(dependency_signatures(schema, deps).join(table_sizes(tables), "tab", "left"), p)
    out = aligned.join(side(real, real_schema, real_dependencies, "r"), "r_tab").join(side(made, made_schema, made_dependencies, "m"), "m_tab")
    rows_of = lambda p: F.coalesce(f"{p}_n", F.lit(0))
    out = out.select(
        "r_tab", "m_tab", trigram_similarity(F.col("r_tab"), F.col("m_tab")).alias("name"), "columns",
        cardinality_similarity(rows_of("r"), rows_of("m")).alias("cardinality"), signature_similarity(F.col("r_signature"), F.col("m_signature")).alias("dependency"),
    )
    return out.withColumn("score", F.least(F.lit(1.0), sum((w * F.col(n) for n, w in weights.items()), F.lit(0.0))))


def match_by_data(columns: DataFrame, tables: DataFrame, least: float = 0.0) -> list[tuple[str, str, float, list[tuple[str, str, float]]]]:
    """(real table, made table, score, column pairs): tables, then their columns, assigned one to one; columns from ``least`` on."""
    def best(scores: dict[tuple[str, str], float]) -> list[tuple[str, str, float]]:
        xs, ys = sorted({x for x, _ in scores}), sorted({y for _, y in scores})
        return [(xs[i], ys[j], scores[xs[i], ys[j]]) for i, j in assign([[scores.get((x, y), 0.0) for y in ys] for x in xs])]

    of: dict[tuple[str, str], dict[tuple[str, str], float]] = {}
    for r in columns.where(F.col("score") >= least).collect():  # a row a pair of columns of the schemas
        of.setdefault((r["r_tab"], r["m_tab"]), {})[r["r_col"], r["m_col"]] = r["score"]
    pairs = best({(r["r_tab"], r["m_tab"]): r["score"] for r in tables.collect()})
    return [(a, b, s, best(of.get((a, b), {}))) for a, b, s in pairs]
