"""Scores of keys and dependencies of two schemas, in the names of the first one.

Schemas, matches and dependencies are rows, one for a column or a dependency; the second schema's
names become the first one's in joins. Closures are taken on the driver: their input is metadata.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.operators.dependencies import closure
from weftspark.plans.spec import Dataset

Dependency = tuple[set[str], set[str]]


def minimal_cover(fds: list[Dependency]) -> list[tuple[tuple[str, ...], str]]:
    """Dependencies with one column on the right and none too many on the left, of which none follows
    from the others; together they imply what ``fds`` imply. In order of their names."""
    cover = sorted({(tuple(sorted(lhs)), c) for lhs, rhs in fds for c in rhs if c not in lhs})

    def implies(given: list, lhs: tuple[str, ...], c: str) -> bool:
        return c in closure(set(lhs), [(set(x), {y}) for x, y in given])

    for i, (lhs, c) in enumerate(cover):
        for column in lhs:
            shorter = tuple(x for x in cover[i][0] if x != column)
            if shorter and implies(cover, shorter, c):
                cover[i] = (shorter, c)
    cover = sorted(set(cover))
    for f in list(cover):
        rest = [g for g in cover if g != f]
        if implies(rest, *f):
            cover = rest
    return cover


def implied_share(fds: list[Dependency], by: list[Dependency]) -> tuple[int, int]:
    """(implied, all): how many of ``fds`` follow from the dependencies ``by``."""
    return sum(rhs <= closure(lhs, by) for lhs, rhs in fds), len(fds)


def match_frame(spark, matched: list) -> DataFrame:
    """(r_tab, m_tab, r_col, m_col) of a list of matched tables and columns; a table without columns has one row with nulls."""
    rows = [(a, b, x, y) for a, b, _, pairs in matched for x, y, _ in (pairs or [(None, None, None)])]
    return spark.createDataFrame(rows, "r_tab string, m_tab string, r_col string, m_col string")


def renamed_columns(real: DataFrame, made: DataFrame, match: DataFrame) -> DataFrame:
    """(m_tab, m_col, tab, col): columns of ``made`` in matched tables by the names they have in ``real``.

    A column without a match keeps its name if the matched table has one of that name; others are left out.
    """
    tables = match.select("m_tab", F.col("r_tab").alias("tab")).distinct()
    columns = match.where("m_col is not null").select("m_tab", "m_col", "r_col")
    known = real.select("tab", F.col("col").alias("same")).withColumn("m_col", F.col("same"))
    every = made.select(F.col("tab").alias("m_tab"), F.col("col").alias("m_col")).join(tables, "m_tab")
    every = every.join(columns, ["m_tab", "m_col"], "left").join(known, ["tab", "m_col"], "left")
    return every.select("m_tab", "m_col", "tab", F.coalesce("r_col", "same").alias("col")).where("col is not null")


def renamed_dependencies(dependencies: DataFrame, names: DataFrame) -> DataFrame:
    """(tab, lhs, rhs) of ``dependencies`` in the names of ``renamed_columns``, each side in order.

    Columns without such a name go, and a dependency of which a side has none left.
    """
    numbered = dependencies.select(F.col("tab").alias("m_tab"), "lhs", "rhs").distinct()
    side = lambda s: numbered.select("*", F.explode(F.split(s, ",")).alias("m_col")).join(names, ["m_tab", "m_col"]).groupBy("m_tab", "lhs", "rhs").agg(
        F.first("tab").alias("tab"), F.concat_ws(",", F.sort_array(F.collect_set("col"))).alias(f"new_{s}"))
    both = side("lhs").join(side("rhs").drop("tab"), ["m_tab", "lhs", "rhs"])
    return both.select("tab", F.col("new_lhs").alias("lhs"), F.col("new_rhs").alias("rhs")).distinct()


def _ordered(dependencies: DataFrame) -> DataFrame:
    side = lambda s: F.concat_ws(",", F.array_sort(F.array_distinct(F.split(s, ",")))).alias(s)
    return dependencies.select("tab", side("lhs"), side("rhs")).distinct()


def _keys(schema: DataFrame) -> DataFrame:
    """(tab, key): the primary key's columns in order; tables without one have no row."""
    return schema.where(F.col("role") == "primary_key").groupBy("tab").agg(F.concat_ws(",", F.sort_array(F.collect_set("col"))).alias("key"))


def structure_scores(real: DataFrame, made: DataFrame, match: DataFrame, real_dependencies: DataFrame, made_dependencies: DataFrame) -> DataFrame:
    """(kind, n_gold, n_made, n_common, precision, recall, f1) of primary_key, foreign_key, dependency and implied.

    Schemas are (tab, col, role, ref), ``match`` as of ``match_frame``. A matched table counts for
    ``primary_key`` on both sides, and is common if it has a key and the renamed key of its
    counterpart is that one. Foreign keys and dependencies are compared as sets, those of ``made`` after renaming. ``implied``
    compares by closure: made ones that follow from the gold ones count for the precision, gold
    ones that follow from the made ones for the recall; n_common is the smaller number of the two.
    """
    spark = real.sparkSession
    names = renamed_columns(real, made, match)
    new = names.select(F.col("m_tab").alias("tab"), F.col("m_col").alias("col"), F.col("tab").alias("r_tab"), F.col("col").alias("r_col"))

    tables = match.select(F.col("r_tab").alias("tab")).distinct()
    made_keys = made.where(F.col("role") == "primary_key").join(new, ["tab", "col"])
    made_keys = _keys(made_keys.select(F.col("r_tab").alias("tab"), F.col("r_col").alias("col"), "role"))
    keys = tables.join(_keys(real), "tab", "left").join(made_keys.withColumnRenamed("key", "other"), "tab", "left")
    keys = keys.agg(F.count("*").alias("n_gold"), F.count("*").alias("n_made"), F.count_if(F.col("key") == F.col("other")).alias("n_common"))

    foreign = real.where("ref is not null").select(F.concat_ws(".", "tab", "col").alias("a"), F.col("ref").alias("b")).distinct()
    target = new.select(F.concat_ws(".", "tab", "col").alias("ref"), F.concat_ws(".", "r_tab", "r_col").alias("b"))
    mine = made.where("ref is not null").join(new, ["tab", "col"]).join(target, "ref").select(F.concat_ws(".", "r_tab", "r_col").alias("a"), "b").distinct()
    gold, other = _ordered(real_dependencies), renamed_dependencies(made_dependencies, names)

    def common(x: DataFrame, y: DataFrame) -> DataFrame:
        flagged = x.withColumn("x", F.lit(1)).join(y.withColumn("y", F.lit(1)), x.columns, "full")
        return flagged.agg(F.count("x").alias("n_gold"), F.count("y").alias("n_made"), F.count(F.col("x") + F.col("y")).alias("n_common"))

    counted = [("primary_key", keys), ("foreign_key", common(foreign, mine)), ("dependency", common(gold, other))]
    rows = [(kind, r["n_gold"], r["n_made"], r["n_common"], r["n_common"], r["n_common"]) for kind, df in counted for r in [df.first()]]

    def by_table(df: DataFrame) -> dict[str, list[Dependency]]:
        out: dict[str, list[Dependency]] = {}
        for r in df.collect():  # a row a dependency
            out.setdefault(r["tab"], []).append((set(r["lhs"].split(",")), set(r["rhs"].split(","))))
        return out

    a, b = by_table(gold), by_table(other)
    held = [implied_share(b[t], a.get(t, [])) for t in b], [implied_share(a[t], b.get(t, [])) for t in a]
    sums = [tuple(map(sum, zip(*h, strict=True))) if h else (0, 0) for h in held]
    rows.append(("implied", sums[1][1], sums[0][1], min(sums[0][0], sums[1][0]), sums[0][0], sums[1][0]))
    out = spark.createDataFrame(rows, "kind string, n_gold long, n_made long, n_common long, hit_made long, hit_gold long")
    share = lambda hit, n: F.coalesce(F.try_divide(F.col(hit).cast("double"), F.col(n)), F.lit(0.0))
    out = out.withColumns({"precision": share("hit_made", "n_made"), "recall": share("hit_gold", "n_gold")})
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))
    return out.select("kind", "n_gold", "n_made", "n_common", "precision", "recall", f1.alias("f1"))


def intra_structures(real: Dataset, made: Dataset, matched: list) -> list[tuple[str, str, float, float, float, float]]:
    """(real table, made table, dependencies, primary key, foreign keys, score) of matched tables with two matched columns at least.

    Of two specs alone: dependencies by their number and the mean lengths of their sides (1 if
    neither table has any, 0 if one has), primary keys 1 if they are named alike, else 0.5, foreign
    keys by their number. Two numbers are as near as 1 / (1 + their difference). The score takes
    0.4, 0.3 and 0.3 of these.
    """
    near = lambda x, y: 1 / (1 + abs(x - y))
    mean = lambda fds, side: sum(len(f[side]) for f in fds) / len(fds)
    out = []
    for a, b, _, pairs in matched:
        if a not in real.tables or b not in made.tables or len(pairs) < 2:
            continue
        x, y = real.tables[a], made.tables[b]
        if x.fds and y.fds:
            lengths = (near(mean(x.fds, "lhs"), mean(y.fds, "lhs")) + near(mean(x.fds, "rhs"), mean(y.fds, "rhs"))) / 2
            fds = (near(len(x.fds), len(y.fds)) + lengths) / 2
        else:
            fds = float(not x.fds and not y.fds)
        key, foreign = 1.0 if x.primary_key == y.primary_key else 0.5, near(len(x.foreign_keys), len(y.foreign_keys))
        out.append((a, b, fds, key, foreign, 0.4 * fds + 0.3 * key + 0.3 * foreign))
    return out


def intra_structure_score(real: Dataset, made: Dataset, matched: list) -> float:
    """Mean of ``intra_structures`` times the share of tables that are matched and the mean share of their columns; 0 without any."""
    scores = [r[-1] for r in intra_structures(real, made, matched)]
    known = [(a, pairs) for a, _, _, pairs in matched if a in real.tables]
    if not scores:
        return 0.0
    columns = sum(len(pairs) / len(real.tables[a].columns) for a, pairs in known) / len(known)
    return sum(scores) / len(scores) * len(known) / len(real.tables) * columns
