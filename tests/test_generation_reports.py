"""Datasets that are written with a summary, and descriptions held against specs."""

import pytest

from weftspark.plans import nuances
from weftspark.plans.generate import write_dataset
from weftspark.plans.spec import Column, Dataset, Event, ForeignKey, Rule, Table


def dataset(rules=(), more=()):
    tables = {
        "good": Table("good", [Column("id", "INT"), Column("x", "FLOAT")], row_count=20, primary_key=["id"]),
        "bad": Table("bad", [Column("id", "INT"), Column("y", "FLOAT")], row_count=20, primary_key=["id"]),
        "of_good": Table("of_good", [Column("id", "INT"), Column("good_id", "INT")], "fact", 50, ["id"], [ForeignKey("good_id", "good", "id")]),
        "of_bad": Table("of_bad", [Column("id", "INT"), Column("bad_id", "INT")], "fact", 50, ["id"], [ForeignKey("bad_id", "bad", "id")]),
        **{t.name: t for t in more},
    }
    return Dataset(tables, list(rules))


@pytest.mark.parametrize(("rule", "says"), [
    (Rule("bad", "y", {"kind": "no such"}), "no such"),  # fails as it is planned
    (Rule("bad", "y", {"kind": "derived", "expression": "nope + 1"}), "nope"),  # fails the check
    (Rule("bad", "y", provider={"name": "lookup.none.z"}), "look up"),
])
def test_a_failing_table_leaves_the_others(spark, tmp_path, rule, says):
    got = {r["tab"]: r for r in write_dataset(spark, dataset([rule]), f"file://{tmp_path}").collect()}
    assert {t: (r["status"], r["rows"]) for t, r in got.items()} == {"good": ("written", 20), "of_good": ("written", 50), "bad": ("failed", None), "of_bad": ("skipped", None)}
    assert says in got["bad"]["message"] and got["of_bad"]["message"] == "without bad"
    assert spark.read.parquet(got["of_good"]["path"]).join(spark.read.parquet(got["good"]["path"]).withColumnRenamed("id", "good_id"), "good_id").count() == 50


def test_cycles_and_specs_of_nothing(spark, tmp_path):
    loop = [Table(a, [Column("id", "INT"), Column("o", "INT")], "fact", 5, ["id"], [ForeignKey("o", b, "id")]) for a, b in (("a", "b"), ("b", "a"))]
    got = {r["tab"]: r["status"] for r in write_dataset(spark, dataset(more=loop), f"file://{tmp_path}/x").collect()}
    assert got == {"good": "written", "bad": "written", "of_good": "written", "of_bad": "written", "a": "failed", "b": "failed"}
    with pytest.raises(ValueError, match="GEN_TABLE_MISSING"):
        write_dataset(spark, dataset([Rule("zzz", "y", {"kind": "uniform"})]), f"file://{tmp_path}/y")


KINDS = {
    "window": {"kind": "window", "expression": "mean(x)"}, "lag_lead": {"kind": "window", "expression": "lag(x, 1)"}, "lognormal": {"kind": "lognormal"}, "pareto": {"kind": "pareto"},
    "mixture": {"kind": "mixture"}, "zipf": {"kind": "zipf"}, "proration": {"kind": "derived", "expression": "overlap_days(a, b, c, d)"}, "seasonal": {"kind": "seasonal"},
    "condition": {"kind": "derived", "expression": "where(a > 1, 2, 3)"},
}


@pytest.mark.parametrize("family", sorted(nuances.FAMILIES))
def test_each_family_is_found_and_covered(spark, family):
    keywords, needs = nuances.FAMILIES[family]
    rows = [(i, f"Some {k.upper()} here") for i, k in enumerate(keywords)] + [(100, "Nothing to be seen"), (101, None), (102, ""), (None, keywords[0])]
    df = spark.createDataFrame(rows, "doc long, t string").selectExpr("*", "1 as family", "2 as id")
    got = [r for r in nuances.mentions(df, "doc", "t").collect() if r["family"] == family]
    assert sorted((r["id"] for r in got if r["id"] is not None)) == list(range(len(keywords))) and len(got) == len(keywords) + 1
    assert all(keywords[r["id"]] in r["keywords"] for r in got if r["id"] is not None)
    missing = nuances.uncovered(df, "doc", "t", Dataset({})).where(f"family = '{family}'")
    assert missing.count() == len(got) and missing.first()["needs"] == sorted(needs)
    for need in needs:
        spec = Dataset({}, [Rule("t", "c", KINDS[need])] if need in KINDS else [], [Event("e")] if need == "event" else [])
        assert need in nuances.constructs(spec) and nuances.uncovered(df, "doc", "t", spec).where(f"family = '{family}'").count() == 0


def test_categories_of_a_dimension_are_listed_once(spark):
    from weftspark.plans.generate import generate, is_category_name

    assert [is_category_name(n) for n in ("vehicle_type", "status_code", "name", "driver_name_type", "Class")] == [True, True, False, False, True]
    kinds = ["a", "b", "c"]
    spec = Dataset(
        {
            "dim": Table("dim", [Column("id", "INT"), Column("vehicle_type"), Column("x", "FLOAT")], "dimension", 50, ["id"]),
            "fact": Table("fact", [Column("id", "INT"), Column("dim_id", "INT"), Column("order_status")], "fact", 200, ["id"], [ForeignKey("dim_id", "dim", "id")]),
        },
        [Rule("dim", "vehicle_type", {"kind": "categorical", "values": kinds}), Rule("fact", "order_status", {"kind": "categorical", "values": kinds})],
    )
    made = generate(spark, spec)
    assert sorted(r["vehicle_type"] for r in made["dim"].collect()) == kinds
    assert made["fact"].count() == 200 and {r["dim_id"] for r in made["fact"].collect()} == {r["id"] for r in made["dim"].collect()} == {1, 2, 3}


def test_times_in_number_columns_go_by_name(spark):
    from weftspark.plans.generate import generate

    names = {"trip_minutes": (15, 60), "km": (3, 12), "surge": (1.0, 3.0), "other": (0, 23)}
    hours = {"kind": "seasonal", "by": "hour", "weights": {"07:00-09:00": 0.5, "11:00-13:00": 0.5}}
    spec = Dataset(
        {"t": Table("t", [Column("id", "INT"), Column("start_hour", "INT"), Column("day", "INT"), *[Column(n, "FLOAT") for n in names]], "dimension", 400, ["id"])},
        [Rule("t", n, hours) for n in (*names, "start_hour", "day")],
    )
    rows = generate(spark, spec)["t"].collect()
    for n, (low, high) in names.items():
        assert all(low <= r[n] <= high for r in rows) and len({r[n] for r in rows}) > 3
    assert {r["start_hour"] for r in rows} <= {7, 8, 9, 11, 12, 13} and {r["other"] for r in rows} <= {7.0, 8.0, 9.0, 11.0, 12.0, 13.0} and max(r["day"] for r in rows) > 24
