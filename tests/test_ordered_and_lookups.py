"""Splitters, range look-ups, weighted draws and exact quantiles against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftspark.operators import lookups, predicates, profile, quantiles, synth
from weftspark.operators.ordered import bucketed, numbered, range_lookup, running
from weftspark.plans.generate import generate
from weftspark.plans.providers import lookup_columns, lookup_source
from weftspark.plans.spec import Column, Dataset, Rule, Table


def test_equal_leading_values_spread_over_buckets(spark):
    df = spark.range(20_000).selectExpr("if(id % 10 = 0, id, -1) as lead", "id as rest")
    sizes = [r["count"] for r in bucketed(df, ["lead", "rest"]).groupBy("_bucket").count().collect()]
    assert len(sizes) == 64 and max(sizes) < 2 * 20_000 / 64
    got, n = numbered(df, ["lead", "rest"])
    want = {k: i for i, k in enumerate(sorted((i if i % 10 == 0 else -1, i) for i in range(20_000)))}
    assert n == 20_000 and all(want[r["lead"], r["rest"]] == r["number"] for r in got.collect())


def test_running_sums_with_nulls_and_text_keys(spark):
    rows = [(random.Random(i).choice([None, "a", "b", "é"]), i, i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    got = {r["i"]: r["run_v"] for r in running(df, ["k", "i"], ["v"]).collect()}
    total, want = 0, {}
    for k, i, v in sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1])):
        total += v
        want[i] = total
    assert got == want
    assert running(df.limit(0), ["k"], ["v"]).count() == 0


def test_range_lookup_equals_search(spark):
    rng = random.Random(5)
    edges = sorted(rng.uniform(0, 100) for _ in range(300)) + [90.0, 90.0]
    edges.sort()
    ranges = [(a, b, i) for i, (a, b) in enumerate(zip(edges, edges[1:])) if i % 5]
    ranges += [(None, 5.0, -1), (200.0, 100.0, -2), (150.0, 1e9, 999)]
    points = [(i, rng.choice([rng.uniform(-5, 105), rng.choice(edges), 160.0])) for i in range(2000)] + [(9001, None), (9002, float("inf")), (9003, -1.0)]
    df = spark.createDataFrame(points, "id long, x double").selectExpr("*", "id as what", "0 as _cell_no")
    got = {r["id"]: r["r"] for r in range_lookup(df.drop("what"), "x", spark.createDataFrame(ranges, "lo double, hi double, r int"), "lo", "hi", ["r"]).collect()}
    want = {i: next((r for a, b, r in ranges if x is not None and a is not None and a <= x < b), None) for i, x in points}
    assert got == want
    none = range_lookup(df, "x", spark.createDataFrame([], "lo double, hi double, r int"), "lo", "hi", ["r"])
    assert none.count() == len(points) and none.where("r is not null").count() == 0


def test_one_wide_range_is_in_all_cells(spark):
    df = spark.range(5000).selectExpr("id", "cast(id as double) as x")
    got = range_lookup(df, "x", spark.sql("select 0.0D as lo, 4000.0D as hi, 'in' as r"), "lo", "hi", ["r"])
    assert got.where("r = 'in'").count() == 4000


def test_draws_follow_weights_and_leave_out_what_has_none(spark):
    table = spark.createDataFrame([(1, "a", 1.0), (2, "b", 3.0), (3, "c", 0.0), (4, "d", None), (5, "e", -2.0)], "k int, v string, w double")
    rows = spark.range(4000).selectExpr("id", "'old' as v")
    got = lookups.draw_from(rows, "id", table, ["v"], ["k"], "w")
    n = Counter(r["v"] for r in got.collect())
    assert set(n) == {"a", "b"} and abs(n["b"] / 4000 - 0.75) < 0.03
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lookups.draw_from(rows.repartition(5), "id", table.repartition(3), ["v"], ["k"], "w").collect()))
    assert set(r["v"] for r in lookups.draw_from(rows.limit(9), "id", table.limit(0), ["v"], ["k"], "w").collect()) == {None}
    even = Counter(r["v"] for r in lookups.sample_from(table, 5000, ["k"]).collect())
    assert len(even) == 5 and all(abs(c - 1000) < 150 for c in even.values())


def test_lookup_providers_and_their_fall_back(spark):
    places = spark.createDataFrame([("Oslo", 5), ("Lima", 0), ("Riga", 5)], "city string, pop int")
    assert lookup_source("lookup.places.city") == ("places", "city") and lookup_source("lookup.values") is None and lookup_source("geo.city") is None
    rows = spark.range(200)
    asked = {"town": {"name": "lookup.places.city", "config": {"weight": "pop"}}, "land": {"name": "lookup.none.x", "config": {"fallback": "geo.country"}}}
    got = lookup_columns(rows, "id", asked, {"places": places}).collect()
    assert {r["town"] for r in got} == {"Oslo", "Riga"} and all(r["land"] for r in got)
    with pytest.raises(ValueError, match="look up"):
        lookup_columns(rows, "id", {"x": {"name": "lookup.none.x"}}, {})
    spec = Dataset(
        {"shop": Table("shop", [Column("id", "INT"), Column("town", "TEXT"), Column("again", "TEXT")], row_count=300, primary_key=["id"])},
        [Rule("shop", "town", provider={"name": "lookup.places.city", "config": {"weight": "pop"}}), Rule("shop", "again", provider={"name": "lookup.places.city"})],
    )
    made = generate(spark, spec, lookups={"places": places})["shop"]
    assert made.columns == ["id", "town", "again"] and made.count() == 300
    assert {r["town"] for r in made.collect()} == {"Oslo", "Riga"} and {r["again"] for r in made.collect()} == {"Oslo", "Lima", "Riga"}


@pytest.mark.parametrize("few", [quantiles.FEW, 40, 1])
def test_quantiles_of_odd_distributions(spark, few, monkeypatch):
    rng = np.random.default_rng(3)
    columns = {
        "even": rng.uniform(-5, 5, 3000), "wide": np.exp(rng.uniform(-600, 600, 3000)), "same": np.full(3000, 7.5), "ties": rng.integers(0, 4, 3000).astype(float),
        "tail": np.where(rng.random(3000) < 0.9, 1.0, rng.pareto(0.3, 3000)), "ends": np.r_[-np.inf, np.inf, np.zeros(2998)],
    }
    monkeypatch.setattr(quantiles, "DRAWN", 1 if few == 40 else quantiles.DRAWN)
    df = spark.createDataFrame([tuple(float(columns[c][i]) for c in columns) for i in range(3000)], ", ".join(f"{c} double" for c in columns))
    df = df.withColumn("gone", F.lit(None).cast("double")).withColumn("some", F.when(F.col("even") > 0, F.col("even")).otherwise(float("nan")))
    qs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)
    got = {r["column"]: r["q"] for r in quantiles.exact_quantiles(quantiles.counted(quantiles.stacked_values(df, df.columns)), qs, few).collect()}
    assert "gone" not in got and set(got) == set(df.columns) - {"gone"}
    for c in got:
        want = df.where(f"not isnan({c})").agg(F.percentile(c, F.array(*map(F.lit, qs)))).first()[0]
        assert got[c] == pytest.approx(want), c


def test_profiles_and_fences_without_values(spark):
    df = spark.sql("select cast(null as double) as x, timestamp'2024-01-01 00:00:00' as t")
    row = profile.numeric_profile(df, ["x"]).first()
    assert (row["n"], row["n_null"], row["n_distinct"], row["p50"]) == (1, 1, 0, None)
    assert predicates.iqr_outliers(df, "x").count() == 0
    assert profile.time_profile(df, "t", ["t"]).first()["median_gap_days"] is None


def test_fewer_rows_than_keys(spark):
    keys = spark.range(40).toDF("k")
    with pytest.raises(ValueError):
        synth.fk_counts(keys, "k", 25)
    got = {r["key"]: r["children"] for r in synth.fk_counts(keys, "k", 25, lacking=True).collect()}
    w = [round((i + 1) ** -1.2, 12) for i in range(40)]
    x = [a / sum(w) * (25 - 40) for a in w]
    whole = [int(np.floor(a)) for a in x]
    rest = sorted(range(40), key=lambda i: (-round(x[i] - whole[i], 9), i))[: -15 - sum(whole)]
    assert got == {i: 1 + whole[i] + (i in rest) for i in range(40)}
    assert sum(got.values()) == 25 and min(got.values()) < 0 and 0 in got.values()
    rows = synth.expand_counts(synth.fk_counts(keys, "k", 25, lacking=True)).collect()
    held = Counter(r["key"] for r in rows if r["lack"] is None)
    lacks = {r["key"]: r["lack"] for r in rows if r["lack"] is not None}
    assert dict(held) == {k: n for k, n in got.items() if n > 0} and lacks == {k: n for k, n in got.items() if n < 1}


def test_queries_of_allocation_with_more_keys_than_rows(spark, tmp_path):
    from weftspark.plans import q_synth

    spark.range(20_040).toDF("c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    counts = [r["children"] for r in q_synth.gen_fk_coverage(spark, str(tmp_path)).collect()]
    assert len(counts) == 20_040 and sum(counts) == q_synth.N
    assert {r["degree"]: r["n_keys"] for r in q_synth.gen_zipf_counts(spark, str(tmp_path)).collect()} == dict(Counter(counts))
