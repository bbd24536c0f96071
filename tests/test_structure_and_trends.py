"""Dependencies, keys, names, options and trends against plain Python."""

import datetime as dt
import random
import re
from itertools import combinations, permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftspark.operators import dependencies as deps
from weftspark.operators import matching, structure, trends, windows
from weftspark.operators.windows import Frame, WindowSpec, add_windows

COLUMNS = "abcd"
FDS = st.lists(st.tuples(st.sets(st.sampled_from(COLUMNS), min_size=1, max_size=3), st.sets(st.sampled_from(COLUMNS), min_size=1, max_size=2)), max_size=6)


@settings(max_examples=80, deadline=None)
@given(FDS)
def test_minimal_cover_implies_the_same_and_nothing_is_too_much(fds):
    cover = [(set(lhs), {c}) for lhs, c in structure.minimal_cover(fds)]
    for k in range(1, 5):
        for s in combinations(COLUMNS, k):
            assert deps.closure(set(s), fds) == deps.closure(set(s), cover)
    for i, (lhs, rhs) in enumerate(cover):
        assert not rhs <= deps.closure(lhs, cover[:i] + cover[i + 1 :])
        assert all(not rhs <= deps.closure(lhs - {x}, cover) for x in lhs if len(lhs) > 1)


def plain_fds(rows, names, size, confidence, support):
    found, out = set(), {}
    for k in range(1, size + 1):
        level = set()
        for lhs in combinations(names, k):
            groups = {}
            for r in rows:
                key = tuple(r[names.index(c)] for c in lhs)
                if None not in key:
                    groups.setdefault(key, []).append(r)
            if rows and len(groups) / len(rows) < support:
                continue
            for c in names:
                if c in lhs or any((t, c) in found for j in range(1, k) for t in combinations(lhs, j)):
                    continue
                values = [[r[names.index(c)] for r in g if r[names.index(c)] is not None] for g in groups.values()]
                n, held = sum(map(len, values)), sum(len(v) for v in values if len(set(v)) == 1)
                if n and held / n >= confidence:
                    level.add((lhs, c))
                    out[",".join(lhs), c] = (n, held / n)
        found |= level
    return out


@pytest.mark.parametrize(("seed", "confidence", "support", "pays"), [(1, 1.0, 0.0, 0.5), (2, 0.8, 0.0, 1.0), (3, 0.9, 0.05, 0.9), (4, 0.7, 0.3, 0.0)])
def test_dependencies_of_up_to_three_columns(spark, seed, confidence, support, pays):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        a, b, c = rng.randrange(6), rng.randrange(5), rng.choice([None, 1, 2, 3])
        rows.append((a, b, c, a * b if rng.random() < 0.95 else None, (a + b + (c or 0)) % 7 if rng.random() < 0.97 else 99, i if rng.random() < 0.9 else 0))
    rows += rows[:5]
    names = list("abcdef")
    df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in names))
    got = {(r["lhs"], r["rhs"]): (r["n"], r["confidence"]) for r in deps.discover_fds(df, names, 3, support, confidence, pays).collect()}
    want = plain_fds(rows, names, 3, confidence, support)
    assert got.keys() == want.keys() and all(got[k] == (want[k][0], pytest.approx(want[k][1])) for k in want)
    assert deps.discover_fds(df.limit(0), names, 2).count() == 0


@pytest.mark.parametrize(("frequent", "sets"), [(250_000, 200), (12, 200), (12, 3), (0, 200)])
def test_dependencies_with_frequent_values_and_odd_ones(spark, monkeypatch, frequent, sets):
    """Frequent values go to groupings and the rest to tasks; zeros and NaNs are one value each, in either."""
    monkeypatch.setattr(deps, "FREQUENT", frequent)
    monkeypatch.setattr(deps, "TASK_ROWS", 40)
    monkeypatch.setattr(deps, "SETS", sets)
    grouped, level = [], deps._level
    monkeypatch.setattr(deps, "_level", lambda sources, asked, **how: (grouped.extend(asked), level(sources, asked, **how))[1])
    rng = random.Random(9)
    zeros, texts = [0.0, -0.0, float("nan"), float("-nan"), 2.5, None], ["é", "e", "", None, "long text"]
    rows = []
    for i in range(300):
        key = i if i % 3 else 7
        rows.append((key, rng.choice(zeros), rng.choice(texts), dt.datetime(2024, 1, 1 + key % 5), f"t{key}" if rng.random() < 0.97 else None))
    df = spark.createDataFrame(rows, "a long, `b` double, c string, d timestamp_ntz, e string")
    flat = [tuple("nan" if x != x else x for x in r) for r in rows]
    got = {(r["lhs"], r["rhs"]): (r["n"], r["confidence"]) for r in deps.discover_fds(df, list("abcde"), 3, 0.0, 0.6).collect()}
    want = plain_fds(flat, list("abcde"), 3, 0.6, 0.0)
    assert want and got.keys() == want.keys() and all(got[k] == (want[k][0], pytest.approx(want[k][1])) for k in want)
    assert bool(grouped) == (frequent < 250_000)  # without frequent values nothing is shuffled but rows, once for a leading column
    nested = df.withColumn("f", F.array("c", "e"))  # no values that Arrow numbers
    assert ("f", "c") in {(r["lhs"], r["rhs"]) for r in deps.discover_fds(nested, ["f", "a", "c"], 2, 0.0, 1.0).collect()}


def test_support_of_sets(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, None), (1, "x")], "a int, b string")
    got = {r["columns"]: (r["n"], r["n_distinct"]) for r in deps.itemset_support(df, [("a",), ("a", "b")]).collect()}
    assert got == {"a": (4, 2), "a,b": (4, 2)}


def test_structure_scores_with_renamed_and_unmatched_columns(spark):
    schema = lambda rows: spark.createDataFrame(rows, matching.SCHEMA)
    real = schema([("t", "id", "INT", "primary_key", None), ("t", "x", "INT", "attribute", None), ("t", "y", "INT", "attribute", "u.k"), ("u", "k", "INT", "primary_key", None), ("v", "z", "INT", "primary_key", None)])
    made = schema([("T", "key", "INT", "primary_key", None), ("T", "x", "INT", "attribute", None), ("T", "w", "INT", "attribute", "U.k"), ("U", "k", "INT", "attribute", None), ("U", "more", "INT", "primary_key", None)])
    match = structure.match_frame(spark, [("t", "T", 1.0, [("id", "key", 1.0), ("y", "w", 1.0)]), ("u", "U", 1.0, [])])
    gold = spark.createDataFrame([("t", "id", "x"), ("t", "x", "y"), ("t", "id", "y")], "tab string, lhs string, rhs string")
    other = spark.createDataFrame([("T", "key", "x"), ("T", "x,none", "w"), ("T", "none", "w"), ("W", "a", "b")], "tab string, lhs string, rhs string")
    got = {r["kind"]: tuple(r)[1:] for r in structure.structure_scores(real, made, match, gold, other).collect()}
    assert got["primary_key"] == (2, 2, 1, 0.5, 0.5, 0.5)
    assert got["foreign_key"] == (1, 1, 1, 1.0, 1.0, 1.0)
    assert got["dependency"][:3] == (3, 2, 2) and got["implied"] == (3, 2, 2, 1.0, 1.0, 1.0)
    none = {r["kind"]: tuple(r)[1:4] for r in structure.structure_scores(real, made.limit(0), match.limit(0), gold, other.limit(0)).collect()}
    assert none == {"primary_key": (0, 0, 0), "foreign_key": (1, 0, 0), "dependency": (3, 0, 0), "implied": (3, 0, 0)}


def test_common_substrings(spark):
    names = ["", "a", "Order_ID", "orderid", "order_id_2", "xorderx", "ab" * 20, "ba" * 20, "Customers", "customer", "été"]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    for a, b, n, ok in df.select("a", "b", matching.common_substring(F.col("a"), F.col("b")), matching.name_compatible(F.col("a"), F.col("b"))).collect():
        x, y = a.lower(), b.lower()
        assert n == max((len(x[i:j]) for i in range(len(x)) for j in range(i, len(x) + 1) if x[i:j] in y), default=0), (a, b)
    assert {(a, b) for a, b, ok in df.select("a", "b", matching.name_compatible(F.col("a"), F.col("b"))).collect() if ok} >= {("Order_ID", "orderid"), ("Customers", "customer")}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sets(st.integers(0, 5), max_size=6), max_size=6))
def test_most_pairs_are_as_many_as_any_choice(options):
    keys = {f"k{i}": sorted(f"o{j}" for j in s) for i, s in enumerate(options)}
    pairs = matching.most_pairs(keys)
    assert all(o in keys[k] for k, o in pairs.items()) and len(set(pairs.values())) == len(pairs)
    best = max((sum(p is not None and p in s for p, s in zip(chosen, options, strict=True)) for chosen in permutations([*range(6), *[None] * len(options)], len(options))), default=0) if len(options) < 4 else None
    assert best is None or len(pairs) == best


def test_match_by_options_takes_the_path_that_greed_misses(spark):
    schema = lambda t, cols: spark.createDataFrame([(t, c, "INT", "attribute", None) for c in cols], matching.SCHEMA)
    got = matching.match_by_options(schema("r", ["abcd", "abce"]), schema("m", ["abc", "abcdx", "zz"]), 0.6).first()
    assert got["n_pairs"] == 2 and got["f1"] == pytest.approx(0.8) and set(got["mapping"].values()) == {"abc", "abcdx"}


def test_trends_equal_the_plain_join(spark):
    rng = np.random.default_rng(4)
    parent = [(i, float(rng.normal()) if i % 9 else None, "ab"[i % 2] if i % 7 else None) for i in range(40)]
    child = [(int(rng.integers(0, 50)), float(rng.normal()) if i % 11 else None, "xyz"[i % 3]) for i in range(600)] + [(None, 1.0, "x")]
    p, c = spark.createDataFrame(parent, "id long, x double, g string"), spark.createDataFrame(child, "k long, y double, h string")
    other = c.withColumn("y", F.col("y") * 2 + 1).where("h <> 'z'")
    rows = p.join(c, F.col("id") == F.col("k"))
    r = trends.joined_correlations(p, "id", c, "k", [("x", "y")]).first()["r"]
    assert r == pytest.approx(rows.where("x is not null and y is not null").agg(F.corr("x", "y")).first()[0])
    got = {(t["parent_col"], t["child_col"]): (t["metric"], t["similarity"]) for t in trends.intertable_trends((p, c), (p, other), "id", "k", ["x", "g"], ["y", "h"]).collect()}
    assert got["x", "y"][0] == "correlation" and {k for k, v in got.items() if v[0] == "contingency"} == {("x", "h"), ("g", "y"), ("g", "h")}
    share = lambda df: {(a, b): n / df.count() for a, b, n in df.groupBy("g", "h").count().collect()}
    a, b = share(rows), share(p.join(other, F.col("id") == F.col("k")))
    assert got["g", "h"][1] == pytest.approx(1 - sum(abs(a.get(k, 0) - b.get(k, 0)) for k in a.keys() | b.keys()) / 2)
    same = trends.intertable_trends((p, c), (p, c), "id", "k", ["x", "g"], ["y", "h"])
    assert trends.trend_score(same) == pytest.approx(1.0)
    assert trends.trend_score(trends.intertable_trends((p, c), (p, c.limit(0)), "id", "k", ["x", "g"], ["y", "h"])) is None


@pytest.mark.parametrize("rows", [7, 100_000])
def test_global_rows_windows_in_slabs(spark, rows, monkeypatch):
    monkeypatch.setattr(windows, "SLAB_ROWS", rows)
    monkeypatch.setattr(windows, "SLAB_SPANS", 1)
    df = spark.range(300).selectExpr("id", "cast(id * 7 % 50 as int) as t", "if(id % 13 = 0, null, id) as v")
    by = {"order_by": "t", "tiebreak": ("id",)}
    specs = {
        "s": WindowSpec("sum(v)", frame=Frame("ROWS", 4, 2), **by), "n": WindowSpec("count(*)", frame=Frame("ROWS", 3), **by), "a": WindowSpec("lag(v, 5)", **by),
        "b": WindowSpec("lead(v)", **by), "c": WindowSpec("sum(a)", frame=Frame("ROWS", 2), **by), "other": WindowSpec("lag(id)", "id"),
    }
    got = add_windows(df, specs)
    over = "over (order by t, id"
    want = df.selectExpr("*", f"sum(v) {over} rows between 3 preceding and 2 following) as s", f"count(*) {over} rows between 2 preceding and current row) as n", f"lag(v, 5) {over}) as a", f"lead(v) {over}) as b")
    want = want.selectExpr("*", f"sum(a) {over} rows between 1 preceding and current row) as c", "lag(id) over (order by id) as other")
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert add_windows(df.limit(0), specs).count() == 0


def test_structure_of_specs_alone():
    from weftspark.plans.spec import Column, Dataset, ForeignKey, Table

    fd = lambda *lhs: {"lhs": list(lhs), "rhs": ["y"]}
    table = lambda name, pk, fds=(), fks=0: Table(name, [Column(c) for c in ("id", "x", "y", "z")], primary_key=pk, fds=list(fds), foreign_keys=[ForeignKey("x", "u", "id")] * fks)
    real = Dataset({"a": table("a", ["id"], [fd("x"), fd("z")], 1), "b": table("b", ["id"]), "c": table("c", ["id"]), "d": table("d", ["id"])})
    made = Dataset({"A": table("A", ["id"], [fd("x", "z")], 0), "B": table("B", ["x"]), "C": table("C", ["id"], [fd("x")])})
    two = [("id", "id", 1.0), ("x", "x", 1.0)]
    matched = [("a", "A", 1.0, two), ("b", "B", 1.0, two), ("c", "C", 1.0, [*two, ("y", "y", 1.0), ("z", "z", 1.0)]), ("d", "B", 1.0, two[:1])]
    got = structure.intra_structures(real, made, matched)
    assert [r[:2] for r in got] == [("a", "A"), ("b", "B"), ("c", "C")]
    assert got[0][2:] == pytest.approx((0.625, 1.0, 0.5, 0.7)) and got[1][2:] == pytest.approx((1.0, 0.5, 1.0, 0.85)) and got[2][2:] == pytest.approx((0.0, 1.0, 1.0, 0.6))
    assert structure.intra_structure_score(real, made, matched) == pytest.approx((0.7 + 0.85 + 0.6) / 3 * 1.0 * (0.5 + 0.5 + 1.0 + 0.25) / 4)
    assert structure.intra_structure_score(real, made, []) == 0.0


TIMED = [(i, i % 2, None if i % 23 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(minutes=(i * i) % 900, microseconds=i % 3), None if i % 5 == 0 else float((i * 7) % 31)) for i in range(400)]


def plain_frame(row, before, behind, by_part):
    _, part, t, _ = row
    same = [r for r in TIMED if not by_part or r[1] == part]
    return [r[3] for r in same if (r[2] is None if t is None else r[2] is not None and t - before <= r[2] <= t + behind)]


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("by_part", [False, True])
def test_range_windows_in_blocks(spark, kind, by_part):
    df = spark.createDataFrame(TIMED, "i long, part long, t timestamp_ntz, v double").withColumn("t", F.col("t").cast(kind))
    part = ("part",) if by_part else ()
    for before, behind in ((45, 15), (120, 0), (0, 7), (0, 0)):
        frame = Frame("RANGE", f"{before}min" if before else 0, f"{behind}min" if behind else 0)
        specs = {k: WindowSpec(e, "t", part, frame) for k, e in {"s": "sum(v)", "m": "v", "d": "std(v)", "n": "count(v)", "all": "count(*)", "u": "sum(i)", "w": "sum(n)"}.items()}
        made = add_windows(df, specs)
        assert made.columns == [*df.columns, *specs] and made.schema["u"].dataType.simpleString() == "bigint"
        got = {r["i"]: r for r in made.collect()}
        assert len(got) == len(TIMED)
        for row in TIMED:
            values = plain_frame(row, dt.timedelta(minutes=before), dt.timedelta(minutes=behind), by_part)
            held = [v for v in values if v is not None]
            r = got[row[0]]
            assert (r["n"], r["all"]) == (len(held), len(values)) and r["s"] == (sum(held) if held else None)
            assert r["m"] == (pytest.approx(sum(held) / len(held)) if held else None)
            assert r["d"] == (pytest.approx(np.std(held, ddof=1), abs=1e-9) if len(held) > 1 else None)
    assert add_windows(df.limit(0), specs).count() == 0


def test_range_windows_take_no_sliding_frame(spark):
    """A frame that slides is summed anew for each row, so its cost grows with the square of how dense time is."""
    df = spark.createDataFrame(TIMED, "i long, part long, t timestamp_ntz, v double")
    for part in ((), ("part",)):
        for peers in ("sql", "physical"):
            made = add_windows(df, {"s": WindowSpec("sum(i)", "t", part, Frame("RANGE", "2h", "1h"), ("i",), peers)})
            plan = made._jdf.queryExecution().optimizedPlan().toString()
            frames = [x.split(")")[0] for x in plan.split("specifiedwindowframe(")[1:]]
            assert frames and all("unboundedpreceding" in f for f in frames)


@pytest.mark.parametrize("rows", [3, 7, 1000])
def test_rows_windows_of_wide_partitions_in_slabs(spark, rows, monkeypatch):
    monkeypatch.setattr(windows, "SLAB_ROWS", rows)
    monkeypatch.setattr(windows, "SLAB_SPANS", 1)
    df = spark.range(200).selectExpr("id as i", "case when id % 11 = 0 then null when id < 150 then 'a' else concat('b', id % 9) end as p", "case when id % 13 > 0 then hash(id) % 20 end as t", "case when id % 7 > 0 then id end as v")
    key = {"order_by": "t", "partition_by": ("p",), "tiebreak": ("i",)}
    asked = {"s": ("sum(v)", Frame("ROWS", 3, 2)), "n": ("count(*)", Frame("ROWS", 4)), "l": ("lag(v, 3)", Frame()), "m": ("lead(v)", Frame())}
    plain, wide = (add_windows(df, {n: WindowSpec(e, frame=f, wide=w, **key) for n, (e, f) in asked.items()}) for w in (False, True))
    assert wide.columns == plain.columns and sorted(map(repr, wide.collect())) == sorted(map(repr, plain.collect()))
    assert add_windows(df.limit(0), {"s": WindowSpec("sum(v)", frame=Frame("ROWS", 3, 2), wide=True, **key)}).count() == 0


def test_no_task_takes_all_events_of_a_type(spark):
    from weftspark.plans.q_projection import win_following

    plan = win_following(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "hashpartitioning(event_type#" in plan and not re.search(r"hashpartitioning\(event_type#\d+, \d+\)", plan)
