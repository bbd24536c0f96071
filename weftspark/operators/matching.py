"""Schema similarity and matching.

Schemas are rows: (table, column, sql_type, role). Similarities of column pairs are a join of
two such frames; a schema's number of columns bounds what reaches the driver, where the small
assignment problem is solved.
"""

from __future__ import annotations

import math
import re
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.plans.spec import Dataset

SCHEMA = "tab string, col string, sql_type string, role string, ref string"
NUMERIC, TIMES = ("INT", "FLOAT"), ("DATE", "DATETIME")


def schema_frame(spark: SparkSession, spec: Dataset) -> DataFrame:
    rows = [
        (t.name, c.name, c.sql_type, c.role or "attribute", next((f"{k.ref_table}.{k.ref_column}" for k in t.foreign_keys if k.column == c.name), None))
        for t in spec.tables.values() for c in t.columns
    ]
    return spark.createDataFrame(rows, SCHEMA)


def coverage(real: DataFrame, made: DataFrame) -> DataFrame:
    """(kind, precision, recall, f1) of exact names: tables, columns, primary and foreign keys."""
    key = lambda df, what: df.select(F.lit(what[0]).alias("kind"), what[1].alias("name")).where("name is not null").distinct()
    kinds = (
        ("table", F.col("tab")), ("column", F.concat_ws(".", "tab", "col")),
        ("primary_key", F.when(F.col("role") == "primary_key", F.concat_ws(".", "tab", "col"))),
        ("foreign_key", F.when(F.col("ref").isNotNull(), F.concat_ws(">", F.concat_ws(".", "tab", "col"), "ref"))),
    )
    side = lambda df, flag: [key(df, k).withColumn(flag, F.lit(1)) for k in kinds]
    parts = [a.join(b, ["kind", "name"], "full") for a, b in zip(side(real, "r"), side(made, "m"), strict=True)]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    hit, r, m = F.sum(F.col("r") * F.col("m")), F.sum("r"), F.sum("m")
    out = rows.groupBy("kind").agg(F.coalesce(F.try_divide(hit.cast("double"), m), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide(hit.cast("double"), r), F.lit(0.0)).alias("recall"))
    return out.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def type_similarity(a: Column, b: Column) -> Column:
    """1 for one type, 0.8 within numbers or times, else 0."""
    both = lambda kinds: a.isin(*kinds) & b.isin(*kinds)
    return F.when(a == b, 1.0).when(both(NUMERIC) | both(TIMES), 0.8).otherwise(0.0)


def role_similarity(a: Column, b: Column) -> Column:
    """1 for two primary keys, 0.8 for two foreign keys, 0.5 for two others, else 0."""
    return F.when((a == b) & (a == "primary_key"), 1.0).when((a == b) & (a == "foreign_key"), 0.8).when(~a.isin("primary_key", "foreign_key") & ~b.isin("primary_key", "foreign_key"), 0.5).otherwise(0.0)


def trigrams(name: Column) -> Column:
    text = F.concat(F.lit("##"), F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", "")), F.lit("##"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    x, y = trigrams(a), trigrams(b)
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def common_substring(a: Column, b: Column) -> Column:
    """Length of the longest common substring, letters of either case alike.

    One step a character of ``a``: how long a common substring ends there and at each character of ``b``.
    """
    chars = lambda t: F.filter(F.split(F.lower(t), ""), lambda c: c != "")
    x, y = chars(a), chars(b)
    none = F.transform(y, lambda _: F.lit(0))

    def step(acc: Column, c: Column) -> Column:
        before = F.concat(F.array(F.lit(0)), acc["ends"])
        ends = F.zip_with(y, before, lambda d, n: F.when(c == d, n + 1).otherwise(0))
        ends = F.slice(ends, F.lit(1), F.size(y))  # ``before`` is longer by one
        return F.struct(ends.alias("ends"), F.greatest(acc["best"], F.coalesce(F.array_max(ends), F.lit(0))).alias("best"))

    return F.aggregate(x, F.struct(none.alias("ends"), F.lit(0).alias("best")), step, lambda acc: acc["best"])


def common_ratio(a: Column, b: Column) -> Column:
    """Longest common substring by the length of the longer name; 0 for two empty ones."""
    return F.coalesce(F.try_divide(common_substring(a, b).cast("double"), F.greatest(F.char_length(a), F.char_length(b))), F.lit(0.0))


def name_compatible(a: Column, b: Column, least: float = 0.75) -> Column:
    """Equal but for case, marks and a plural s, or a common substring of ``least`` of the longer name."""
    plain = lambda t: F.regexp_replace(F.regexp_replace(F.lower(t), "[^a-z0-9]", ""), "s+$", "")
    return (plain(a) == plain(b)) | (common_ratio(a, b) >= least)


def column_similarities(real: DataFrame, made: DataFrame, weights: tuple[float, float, float] = (0.4, 0.4, 0.2)) -> DataFrame:
    """(real table and column, made table and column, score): names, types and roles, for pairs of fitting types.

    Joined on the type's family, so pairs of unlike families are never formed.
    """
    family = F.when(F.col("sql_type").isin(*NUMERIC), "number").when(F.col("sql_type").isin(*TIMES), "time").otherwise(F.col("sql_type"))
    a = real.select(*[F.col(c).alias(f"r_{c}") for c in real.columns], family.alias("family"))
    b = made.select(*[F.col(c).alias(f"m_{c}") for c in made.columns], family.alias("family"))
    name = trigram_similarity(F.col("r_col"), F.col("m_col"))
    score = weights[0] * name + weights[1] * type_similarity(F.col("r_sql_type"), F.col("m_sql_type")) + weights[2] * role_similarity(F.col("r_role"), F.col("m_role"))
    return a.join(b, "family").select("r_tab", "r_col", "m_tab", "m_col", score.alias("score"))


def name_similarity(a: str, b: str) -> float:
    """0.4 of the words' Jaccard and 0.6 of the longest-block ratio; 1 for equal plain names."""
    plain = lambda s: re.sub(r"[^a-z0-9]", "", s.lower()).rstrip("s")
    if plain(a) == plain(b):
        return 1.0
    words = lambda s: set(re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", s)) and {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", s)}
    x, y = words(a), words(b)
    return 0.4 * (len(x & y) / len(x | y) if x | y else 0.0) + 0.6 * SequenceMatcher(None, a.lower(), b.lower()).ratio()


def assign(score: list[list[float]]) -> list[tuple[int, int]]:
    """Pairs (row, column) of greatest total score, each row and column once; zero scores are no pairs.

    Shortest augmenting paths with potentials over the negated scores.
    """
    n, m = len(score), len(score[0]) if score else 0
    if not n or not m:
        return []
    turned = n > m
    if turned:
        score = [list(c) for c in zip(*score, strict=True)]
        n, m = m, n
    row_price, column_price, owner = [0.0] * (n + 1), [0.0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        owner[0], free, slack, came, seen = i, 0, [math.inf] * (m + 1), [0] * (m + 1), [False] * (m + 1)
        while True:
            seen[free], row, step, best = True, owner[free], math.inf, 0
            for j in (j for j in range(1, m + 1) if not seen[j]):
                reduced = -score[row - 1][j - 1] - row_price[row] - column_price[j]
                if reduced < slack[j]:
                    slack[j], came[j] = reduced, free
                if slack[j] < step:
                    step, best = slack[j], j
            for j in range(m + 1):
                if seen[j]:
                    row_price[owner[j]] += step
                    column_price[j] -= step
                else:
                    slack[j] -= step
            free = best
            if not owner[free]:
                break
        while free:
            owner[free], free = owner[came[free]], came[free]
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    pairs = [(j, i) if turned else (i, j) for i, j in pairs if score[i][j] > 0]
    return sorted(pairs)


def compatible_columns(real: DataFrame, made: DataFrame, least: float = 0.75) -> DataFrame:
    """(r_tab, r_col, m_tab, m_col): columns of fitting types and compatible names; joined on the type's family."""
    family = F.when(F.col("sql_type").isin(*NUMERIC), "number").when(F.col("sql_type").isin(*TIMES), "time").otherwise(F.col("sql_type"))
    a = real.select(F.col("tab").alias("r_tab"), F.col("col").alias("r_col"), family.alias("family"))
    b = made.select(F.col("tab").alias("m_tab"), F.col("col").alias("m_col"), family.alias("family"))
    return a.join(b, "family").where(name_compatible(F.col("r_col"), F.col("m_col"), least)).drop("family")


def most_pairs(options: dict[str, list[str]]) -> dict[str, str]:
    """One to one, as many keys as can be, each with one of its options.

    Keys of fewest options choose first. One that finds all its options taken asks their owners to
    move on to another one, and these ask in turn (augmenting paths).
    """
    owner: dict[str, str] = {}

    def settle(key: str, tried: set[str]) -> bool:
        for option in options[key]:
            if option not in tried:
                tried.add(option)
                if option not in owner or settle(owner[option], tried):
                    owner[option] = key
                    return True
        return False

    for key in sorted(options, key=lambda k: (len(options[k]), k)):
        settle(key, set())
    return {key: option for option, key in sorted(owner.items(), key=lambda x: x[1])}


def match_by_options(real: DataFrame, made: DataFrame, least: float = 0.75) -> DataFrame:
    """(r_tab, m_tab, n_pairs, f1, mapping) of every pair of tables with compatible columns.

    The mapping has as many column pairs as can be; F1 is of these among both tables' columns. A
    pair of tables is a small problem on the driver.
    """
    wide = {(p, r["tab"]): r["n"] for p, df in (("r", real), ("m", made)) for r in df.groupBy("tab").agg(F.count("*").alias("n")).collect()}
    options: dict[tuple[str, str], dict[str, list[str]]] = {}
    for r in compatible_columns(real, made, least).orderBy("r_col", "m_col").collect():  # a row a pair of columns
        options.setdefault((r["r_tab"], r["m_tab"]), {}).setdefault(r["r_col"], []).append(r["m_col"])
    rows = []
    for (a, b), found in sorted(options.items()):
        pairs = most_pairs(found)
        rows.append((a, b, len(pairs), 2 * len(pairs) / (wide["r", a] + wide["m", b]), pairs))
    return real.sparkSession.createDataFrame(rows, "r_tab string, m_tab string, n_pairs int, f1 double, mapping map<string,string>")


def match_schemas(real: DataFrame, made: DataFrame, least: float = 0.3) -> list[tuple[str, str, float, list[tuple[str, str, float]]]]:
    """(real table, made table, score, column pairs), tables and columns assigned one to one."""
    rows = [r for r in column_similarities(real, made).collect() if r["score"] >= least]  # bounded by the schemas' columns
    tables: dict[tuple[str, str], list] = {}
    for r in rows:
        tables.setdefault((r["r_tab"], r["m_tab"]), []).append((r["r_col"], r["m_col"], r["score"]))
    width = {(k, r["tab"]): r["n"] for k, df in (("r", real), ("m", made)) for r in df.groupBy("tab").agg(F.count("*").alias("n")).collect()}
    best = {}
    for (a, b), pairs in tables.items():
        xs, ys = sorted({p[0] for p in pairs}), sorted({p[1] for p in pairs})
        grid = [[0.0] * len(ys) for _ in xs]
        for x, y, s in pairs:
            grid[xs.index(x)][ys.index(y)] = s
        chosen = [(xs[i], ys[j], grid[i][j]) for i, j in assign(grid)]
        best[a, b] = (2 * sum(c[2] for c in chosen) / (width["r", a] + width["m", b]), chosen)
    xs, ys = sorted({a for a, _ in best}), sorted({b for _, b in best})
    grid = [[best.get((a, b), (0.0, []))[0] for b in ys] for a in xs]
    return [(xs[i], ys[j], grid[i][j], best[xs[i], ys[j]][1]) for i, j in assign(grid)]
