"""Statistics between frames of which one side, or both, have no values."""

import pytest

from weftspark.operators import evaluate, metrics, scores


@pytest.fixture(scope="module")
def sides(spark):
    some = spark.sql("select cast(id as double) as x, cast(id % 3 as string) as s, id % 2 as k from range(10)")
    return some, some.where("x < 0"), some.limit(0).selectExpr("cast(null as double) as x", "cast(null as string) as s", "k").union(some.limit(1).selectExpr("cast(null as double)", "cast(null as string)", "k"))


@pytest.mark.parametrize("name", ["range_similarity", "moment_similarity"])
def test_numeric_similarities(sides, name):
    some, none, nulls = sides
    value = lambda a, b: getattr(metrics, name)(a, b, "x").first()["similarity"]
    assert value(some, some) == pytest.approx(1.0)
    assert [value(some, none), value(none, some), value(nulls, some)] == [0.0] * 3
    assert value(none, none) is None and value(none, nulls) is None


def test_domain_and_contingency(sides):
    some, none, nulls = sides
    domain = lambda a, b: metrics.domain_similarity(a, b, "s").first()["similarity"]
    assert [domain(some, some), domain(some, none), domain(nulls, some)] == [1.0, 0.0, 0.0]
    assert domain(none, nulls) is None
    cells = lambda a, b: metrics.contingency_similarity(a, b, ("s", "k")).first()["similarity"]
    assert [cells(some, some), cells(some, none), cells(none, some)] == [1.0, 0.0, 0.0] and cells(none, none) is None


def test_two_samples(sides):
    some, none, nulls = sides
    rows = [metrics.two_sample(a, b, "x").first() for a, b in ((some, some), (some, none), (nulls, some), (none, none))]
    assert [r["ks"] for r in rows] == [0.0, None, None, None] and [r["wasserstein"] for r in rows] == [0.0, None, None, None]
    assert (rows[1]["n_a"], rows[1]["n_b"]) == (10, 0)
    assert metrics.categorical_two_sample(some, none, "s").first()["chi2"] is None


def test_chi_square_and_the_evaluator_do_not_judge_nothing(sides):
    some, none, _ = sides
    row = metrics.chi_square(none, "s").first()
    assert row["statistic"] is None and row["freedom"] == 0
    for kind in ({"kind": "categorical", "values": ["0", "1", "2"]}, {"kind": "normal"}, {"kind": "uniform"}):
        column = "s" if kind["kind"] == "categorical" else "x"
        assert evaluate.evaluate_column(none, column, kind) is None
        assert evaluate.evaluate_column(some, column, kind) is not None


def test_inter_score_without_parents(sides):
    some, none, _ = sides
    assert scores.inter_score((some, some), (some, some), "x", "x") == pytest.approx(1.0)
    assert scores.inter_score((some, some), (none, none), "x", "x") == pytest.approx(0.55)


def test_families_in_one_pass_are_those_one_by_one(spark):
    names = ["uniform", "normal", "lognormal", "exponential", "pareto", "poisson"]
    df = spark.range(1, 400).selectExpr("cast(pow(id % 37 + 1, 1.5) as double) as x", "cast(id % 7 as double) as k", "cast(null as double) as none")
    for column in ("x", "k"):
        got = {r["family"]: r for r in metrics.ks_of_families(df, column, names).collect()}
        for f in names:
            alone = metrics.ks_fitted(df, column, f).first()
            if column == "k" and f in ("lognormal", "pareto"):
                assert got[f]["ks"] is None
            else:
                assert got[f]["ks"] == pytest.approx(alone["ks"]) and got[f]["n"] == alone["n"], (column, f)
    assert {r["ks"] for r in metrics.ks_of_families(df, "none", names).collect()} == {None}
