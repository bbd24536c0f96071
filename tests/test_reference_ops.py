"""Operators outside the catalogue, expression edge cases, specs, sources and streams."""

import datetime as dt
import math

import pytest

from weftspark.functions.derive import ExpressionError, Missing, dependencies, derive, levels
from weftspark.functions.special import chi_square_tail, kolmogorov_tail
from weftspark.operators import dependencies as deps
from weftspark.operators import matching, metrics, relational, scores, synth
from weftspark.operators.ordered import numbered
from weftspark.operators.predicates import read_condition
from weftspark.operators.windows import Frame, WindowSpec, add_windows, span_seconds
from weftspark.plans.examples import SHOP
from weftspark.plans.from_data import spec_from_data
from weftspark.plans.generate import checksum, generate
from weftspark.plans.providers import provide, register, registered
from weftspark.plans.spec import Column, Dataset, ForeignKey, Rule, Table
from weftspark.plans.validate import check, repaired
from weftspark.sources import readers
from weftspark.sources.catalogs import imdb, tpch
from weftspark.sources.ddl import read_ddl


def one(spark, sql, **expressions):
    return derive(spark.sql(sql), expressions).first().asDict()


def test_time_functions(spark):
    got = one(spark, "select timestamp_ntz'2024-02-29 23:59:00' as t", h="hour(t)", d="day_of_week(t)", m="month(t)", y="year(t)", day="day_of_month(t)", n="t + minutes(1)")
    assert (got["h"], got["d"], got["m"], got["y"], got["day"]) == (23, 3, 2, 2024, 29)
    assert got["n"] == dt.datetime(2024, 3, 1, 0, 0)


def test_nulls_zero_and_floor(spark):
    got = one(spark, "select cast(null as int) as n, 0 as z, -7 as x", a="x / z", b="x // 2", c="x % 3", d="x % z", e="n > 1", f="not (n > 1)", g="1 if n > 1 else 2", h="concat(n, 'x')")
    assert got["a"] is None and got["b"] == -4 and got["c"] == 2 and got["d"] is None and got["e"] is None
    assert got["f"] is True and got["g"] == 2 and got["h"] == "Nonex"


def test_strings(spark):
    got = one(spark, "select 'abcdef' as s, '{}-{1}' as tpl", a="substring(s, 2)", b="substring(s, -2, 1)", c="format('{0}{0}', s)", d="format(tpl, s, 1)", e="int('7.9')", f="float('x')")
    assert got["a"] == "cdef" and got["b"] == "e" and got["c"] == "abcdefabcdef" and got["e"] == 7 and got["f"] is None
    assert got["d"] == "abcdef-1"


def test_expression_errors(spark):
    df = spark.sql("select 1 as a")
    for bad in ("upper(a)", "a.b", "format(tpl=a)", "case_when(a)", "f'{a}'", "a in b", "[x for x in a]", "a +"):
        with pytest.raises(ExpressionError):
            derive(df, {"x": bad}).collect()
    with pytest.raises(Missing):
        derive(df, {"x": "nope + 1"})
    with pytest.raises(ExpressionError, match="cycle"):
        levels({"a": "b", "b": "a"})
    assert dependencies("month(month) + hour(ts)") == {"month", "ts"}


def test_random_functions_do_not_depend_on_partitions(spark):
    make = lambda n: derive(spark.range(0, 500, 1, n), {"u": "uniform(1, 2)", "c": "weighted_choice('a', 1, 'b', 3)", "p": "pareto(3)", "w": "weighted_choice_if(id > 5, ('x', 1), ('y', 1))"}, key=("id",))
    rows = {r["id"]: r for r in make(1).collect()}
    assert all(rows[r["id"]] == r for r in make(5).collect())
    assert all(1 <= r["u"] < 2 and r["p"] >= 0 for r in rows.values()) and 0.6 < sum(r["c"] == "b" for r in rows.values()) / 500 < 0.9


def test_span_parser():
    assert [span_seconds(x) for x in ("7d", "7days", "24hours", "5 minutes", "30s", "1.5h")] == [604800, 604800, 86400, 300, 30, 5400]
    for bad in ("7", "d", "3 weeks"):
        with pytest.raises(ValueError):
            span_seconds(bad)


def test_window_frames_and_errors(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 4.0)], "i int, v double")
    got = add_windows(df, {"s": WindowSpec("sum(v)", "i", (), Frame("ROWS", 2)), "l": WindowSpec("lag(v)", "i"), "m": WindowSpec("v", "i", (), Frame("ROWS", 3))})
    assert [(r["s"], r["l"], r["m"]) for r in got.orderBy("i").collect()] == [(1.0, None, 1.0), (1.0, 1.0, 1.0), (4.0, None, 2.5)]
    with pytest.raises(ValueError):
        add_windows(df, {"x": WindowSpec("median(v)", "i")})


def test_conditions():
    assert read_condition("a in ('x', 'y')") == {"col": "a", "op": "in", "value": ["x", "y"]}
    assert read_condition("a != 'x'") == {"col": "a", "op": "ne", "value": "x"} and read_condition("a >= 2.5")["value"] == 2.5


def test_p_values():
    assert chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05, abs=1e-9)
    assert kolmogorov_tail(0.0, 100) == 1.0 and kolmogorov_tail(0.5, 1000) < 1e-9


def test_numbering_and_keys(spark):
    df, n = numbered(spark.range(1000).selectExpr("(id * 37) % 1000 as k"), ["k"])
    assert n == 1000 and all(r["k"] == r["number"] for r in df.collect())
    with pytest.raises(ValueError):
        synth.shuffled_keys(spark, 10, 1, 5)
    with pytest.raises(ValueError):
        synth.fk_counts(spark.range(10), "id", 5)
    assert {r["k"] for r in relational.sample_keys(50, spark.range(5).toDF("k"), "k").selectExpr("key as k").collect()} <= set(range(5))


def test_zipf_beyond_the_table(spark):
    x = spark.range(20000).select(synth.zipf_rank(synth.rng.uniform01(7, "z", synth.F.col("id")), 100_000, 1.3).alias("r"))
    row = x.selectExpr("min(r) as lo", "max(r) as hi", "avg(cast(r = 1 as int)) as first").first()
    share = 1 / sum(k ** -1.3 for k in range(1, 100_001))
    assert row["lo"] == 1 and row["hi"] <= 100_000 and abs(row["first"] - share) < 0.1


def test_seasonal_week_and_hour(spark):
    key = synth.F.col("id")
    weeks = synth.sampler({"kind": "seasonal", "by": "week", "weights": {"1": 1, "53": 1}}, 7, "w", key)
    hours = synth.sampler({"kind": "seasonal", "by": "hour", "weights": {"07:00-09:00": 1}}, 7, "h", key)
    row = spark.range(2000).select(weeks.alias("w"), hours.alias("h")).selectExpr("max(month(w)) as m", "min(hour(h)) as a", "max(hour(h)) as b", "max(year(w)) as y").first()
    assert (row["m"], row["a"], row["b"]) == (12, 7, 9) and row["y"] <= 2023


def test_closure_and_keys():
    fds = [({"a"}, {"b"}), ({"b", "c"}, {"d"})]
    assert deps.closure({"a", "c"}, fds) == {"a", "b", "c", "d"}
    assert deps.candidate_keys(list("abcd"), fds) == [("a", "c")]
    assert deps.candidate_keys(list("abcd"), fds, ["d"])[0] == ("d",)
    of_keys, others = deps.split_key_fds(fds, [("a", "c")])
    assert not of_keys and others == [fds[1]]


def test_assignment_is_optimal():
    grid = [[0.9, 0.8, 0.0], [0.8, 0.1, 0.0]]
    assert matching.assign(grid) == [(0, 1), (1, 0)]
    assert matching.assign([[0.0]]) == [] and matching.assign([]) == []


def test_schema_matching(spark):
    real, made = matching.schema_frame(spark, SHOP), matching.schema_frame(spark, repaired(SHOP))
    assert {r["f1"] for r in matching.coverage(real, made).collect()} == {1.0}
    pairs = matching.match_schemas(real, made)
    assert [(a, b) for a, b, _, _ in pairs] == [("orders_x", "orders_x"), ("shops", "shops")] and all(x == y for _, _, _, c in pairs for x, y, _ in c)
    assert matching.name_similarity("customer_id", "CustomerIDs") == 1.0 and matching.name_similarity("abc", "xyz") < 0.2


def test_generate_reruns_agree_and_evaluate(spark):
    a, b = generate(spark, SHOP), generate(spark, SHOP)
    assert checksum(a["orders_x"]).collect() == checksum(b["orders_x"]).collect()
    other = generate(spark, SHOP, seed=8)
    a, other = ({name: spark.createDataFrame(df.toPandas()) for name, df in side.items()} for side in (a, other))
    assert checksum(a["orders_x"]).collect() != checksum(other["orders_x"]).collect()
    assert scores.inter_score((a["shops"], a["orders_x"]), (other["shops"], other["orders_x"]), "shop_id", "shop_id") > 0.9
    assert scores.intra_score(a["orders_x"], other["orders_x"], ["amount", "gross"]) > 0.9
    keys = {"orders_x": ["order_id", "shop_id"], "shops": ["shop_id"]}
    assert 0.2 < scores.schema_score(a, other, keys) < 1.0
    assert scores.global_score({"schema": 1.0, "utility": 0.5}) == pytest.approx((0.4 + 0.1) / 0.6)


def test_scores_without_values_or_with_unseen_ones(spark):
    some, none = spark.sql("select 1.0 as x, 'a' as s, date'2024-01-01' as d"), spark.sql("select 1.0 as x, 'a' as s, date'2024-01-01' as d where false")
    assert scores.column_score(some, spark.sql("select 'b' as s"), "s") == 0.0
    assert [scores.column_score(a, b, c) for c in "xd" for a, b in ((some, some), (none, none), (some, none))] == [1.0, 1.0, 0.0] * 2


def test_schema_score_of_known_tables(spark):
    t = spark.sql("select id, cast(id % 2 as string) as s, id / 2 as v from range(20)")
    assert scores.schema_score({"t": t}, {"t": t}, {"t": ["id"]}) == pytest.approx(1.0)
    assert scores.schema_score({"t": t, "u": t}, {"t": t.drop("v")}, {"t": ["id"]}) == pytest.approx(1 / 2 * 2 / 3)


def test_model_utility(spark):
    df = spark.range(400).selectExpr("id", "cast(id % 20 as double) as x", "cast(id % 20 > 9 as int) as y")
    assert scores.model_utility(df, df, ["x"], "y") > 0.9


def test_spec_round_trip_and_issues():
    assert Dataset.from_json(SHOP.to_json()).to_json() == SHOP.to_json()
    assert not [i for i in check(SHOP) if i.severe]
    bad = Dataset(
        {"t": Table("t", [Column("a", "VARCHAR(3)"), Column("ts", "DATETIME")], foreign_keys=[ForeignKey("x", "u", "k"), ForeignKey("a", "t", "nope")], primary_key=["id"])},
        [Rule("tt", "a", {"kind": "uniform"}), Rule("t", "b", {"kind": "uniform"}), Rule("t", "a", {"kind": "derived", "expression": "q + 1"}),
         Rule("t", "ts", {"kind": "window", "expression": "sum(a)", "order_by": "no", "partition_by": ["p"], "frame": {"preceding": "x"}})],
    )
    codes = {i.code for i in check(bad)}
    assert codes >= {"MISSING_ROW_COUNT", "PK_COL_MISSING", "FK_COL_MISSING", "FK_REF_TABLE_MISSING", "FK_REF_COL_MISSING", "GEN_TABLE_MISSING", "GEN_COL_MISSING",
                     "MISSING_DERIVED_DEP", "WINDOW_ORDER_BY_MISSING", "WINDOW_PARTITION_BY_MISSING", "WINDOW_FRAME_INVALID"}
    assert {i.code for i in check(Dataset({"t": Table("t", [Column("a")])}))} >= {"MISSING_PK", "SCHEMA_MODE_MISMATCH", "MISSING_GEN_SPEC"}
    fixed = repaired(Dataset({"users": Table("users", [Column("email")])}, [Rule("user", "emails", {"kind": "zipf", "n": 3})]))
    assert fixed.rules[0].table == "users" and fixed.tables["users"].row_count == 100_000
    with pytest.raises(ValueError):
        Column("x", "GEOMETRY")


def test_providers(spark):
    register("own.word", lambda config, seed, stream, key: synth.F.lit(config["w"]))
    assert "own.word" in registered()
    names = ["internet.email", "person.name", "phone.number", "geo.address", "text.sentence", "id.uuid"]
    row = spark.range(1).select(*[provide({"name": n}, 7, "s", synth.F.col("id")).alias(n.replace(".", "_")) for n in names], provide({"name": "own.word", "config": {"w": "hi"}}, 7, "s", synth.F.col("id")).alias("own")).first()
    assert "@" in row["internet_email"] and row["own"] == "hi" and len(row["id_uuid"]) == 36


def test_spec_from_data(spark):
    a = {name: spark.createDataFrame(df.toPandas()) for name, df in generate(spark, SHOP).items()}
    spec = spec_from_data(a, {"orders_x": [ForeignKey("shop_id", "shops", "shop_id")]}, {"orders_x": ["order_id"], "shops": ["shop_id"]})
    assert not [i for i in check(spec) if i.severe] and spec.rule("orders_x", "channel").distribution["kind"] == "categorical"
    assert spec.rule("orders_x", "amount").distribution["kind"] == "lognormal"
    assert generate(spark, spec)["orders_x"].count() == 2000


def test_ddl_and_catalogs():
    spec = read_ddl("CREATE TABLE IF NOT EXISTS `a` (`id` int(11) NOT NULL AUTO_INCREMENT, name varchar(20) DEFAULT 'x,(y', k enum('p','q'), PRIMARY KEY (`id`), UNIQUE KEY u (name), CONSTRAINT c FOREIGN KEY (k) REFERENCES b (bk));")
    t = spec.tables["a"]
    assert [c.name for c in t.columns] == ["id", "name", "k"] and t.primary_key == ["id"] and t.candidate_keys == [["name"]]
    assert t.foreign_keys == [ForeignKey("k", "b", "bk")] and t.columns[0].nullable is False
    assert len(tpch().tables) == 8 and len(imdb().tables) == 7 and tpch().tables["lineitem"].primary_key == ["l_orderkey", "l_linenumber"]


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1,x\n2,?\n")
    frames = readers.read_csv_dir(spark, f"file://{tmp_path}", ["t"])
    assert frames["t"].dtypes == [("a", "int"), ("b", "string")] and readers.missing_as_null(frames["t"]).where("b is null").count() == 1
    (tmp_path / "p.tbl").write_text("1|x|2.5|\n2|y|\n")
    schema = "k long, s string, v double"
    st = spark.createDataFrame([], schema).schema
    assert sorted(map(tuple, readers.read_tbl(spark, f"file://{tmp_path}/p.tbl", st).collect())) == [(1, "x", 2.5), (2, "y", None)]
    (tmp_path / "q.tsv").write_text('k\ts\tv\n1\t\\N\t2\n3\ta "b\t\\N\n')
    assert sorted(map(tuple, readers.read_tsv(spark, f"file://{tmp_path}/q.tsv", st).collect())) == [(1, None, 2.0), (3, 'a "b', None)]
    (tmp_path / "d.sql").write_text("DROP TABLE x;\nINSERT INTO `x` VALUES (1,'it''s, (ok)',2.5),(2,NULL,NULL);\nINSERT INTO y VALUES (9,'n',0);\n")
    assert sorted(map(tuple, readers.read_insert_dump(spark, f"file://{tmp_path}/d.sql", "x", st).collect())) == [(1, "it's, (ok)", 2.5), (2, None, None)]
    (tmp_path / "u.csv").write_text("a,c\n5,z\n")
    both = readers.union_files(spark, [f"file://{tmp_path}/t.csv", f"file://{tmp_path}/u.csv"])
    assert {r["indicator_code"] for r in both.collect()} == {"t", "u"} and both.count() == 3
    stats = spark.createDataFrame([(1.0,), (math.nan,), (math.inf,)], "v double")
    readers.write_statistics(stats, f"file://{tmp_path}/s")
    assert spark.read.json(f"file://{tmp_path}/s").where("v is null").count() == 2
    readers.write_csv(stats, f"file://{tmp_path}/w", single=True)
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/w").count() == 3
    assert readers.decoded_names(spark.sql("select 1 as `a%20b`")).columns == ["a b"]


def test_two_sample_against_numpy(spark):
    import numpy as np

    r = np.random.default_rng(1)
    x, y = r.normal(size=300).round(2), (r.normal(size=200) + 0.3).round(2)
    frame = lambda v: spark.createDataFrame([(float(i),) for i in v], "v double")
    row = metrics.two_sample(frame(x), frame(y), "v").first()
    at = np.unique(np.concatenate([x, y]))
    gap = np.abs(np.searchsorted(np.sort(x), at, "right") / 300 - np.searchsorted(np.sort(y), at, "right") / 200)
    assert row["ks"] == pytest.approx(gap.max()) and row["wasserstein"] == pytest.approx((gap[:-1] * np.diff(at)).sum())


def test_streaming(spark, tmp_path):
    from weftspark.streaming.rolling import sessions, windowed

    spark.sql("select timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,cast(id as int)) as ts, id % 2 as k, 1.0D as v from range(60)").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, k long, v double").parquet(f"{tmp_path}/in")
    for name, df in (("w", windowed(stream, "ts", ["k"], {"s": ("sum", "v")}, "30 minutes")), ("ss", sessions(stream, "ts", ["k"], "5 minutes"))):
        q = df.writeStream.outputMode("complete" if name == "w" else "append").format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
    assert {r["s"] for r in spark.sql("select s from w").collect()} == {15.0}
