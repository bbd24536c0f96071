"""Matching by data and text similarity against plain Python."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftspark.operators import data_match as dm
from weftspark.operators import text_diversity as td
from weftspark.operators.matching import SCHEMA

FDS = "tab string, lhs string, rhs string"


def schema(spark, rows):
    return spark.createDataFrame([(t, c, k, r, None) for t, c, k, r in rows], SCHEMA)


@pytest.fixture(scope="module")
def two(spark):
    a = spark.sql("select id, cast(id % 5 as string) as kind, id * 1.5 as price, date'2024-01-01' + cast(id as int) as day from range(100)")
    b = spark.sql("select id + 50 as key, cast(id % 4 as string) as sort, cast(null as double) as cost, date'2024-01-01' + cast(id as int) as made from range(50)")
    sa = schema(spark, [("a", "id", "INT", "primary_key"), ("a", "kind", "TEXT", "attribute"), ("a", "price", "FLOAT", "attribute"), ("a", "day", "DATE", "attribute"), ("a", "gone", "INT", "attribute")])
    sb = schema(spark, [("b", "key", "INT", "primary_key"), ("b", "sort", "TEXT", "attribute"), ("b", "cost", "FLOAT", "attribute"), ("b", "made", "DATE", "attribute")])
    return {"a": a}, {"b": b}, sa, sb, spark.createDataFrame([("a", "id", "kind"), ("a", "id,day", "price")], FDS), spark.createDataFrame([], FDS)


def test_ranges_and_domains(two):
    real, made, sa, sb, _, _ = two
    got = {(r["r_col"], r["m_col"]): r["range"] for r in dm.range_similarities(real, made, sa, sb).collect()}
    assert got["id", "key"] == pytest.approx(49 / 99) and got["day", "made"] == pytest.approx(49 / 99)
    assert got["kind", "sort"] == pytest.approx(0.5 * 4 / 5 + 0.5 * (3 * 0.2 + 0.2)) and ("price", "cost") not in got
    counts = {r["col"]: (r["n_left"], r["n_right"]) for r in dm.dependency_counts(sa, two[4]).collect()}
    assert counts == {"id": (2, 0), "kind": (0, 1), "price": (0, 1), "day": (1, 0), "gone": (0, 0)}
    few = dm.column_domains(real, sa, 2).collect()
    assert sorted((r["value"], r["share"]) for r in few) == [("0", 0.5), ("1", 0.5)]


def test_signatures_and_scores(two):
    sign = {r["tab"]: r["signature"] for r in dm.dependency_signatures(two[2], two[4]).collect()}
    assert sign == {"a": [2.0, 1.5, 1.0, 4.0, 2.0, 1.0, 1.0, 1.0, 1.0, 2.0]}
    columns = dm.column_scores(*two)
    r = columns.where("r_col = 'id' and m_col = 'key'").first()
    assert r["dependency"] == pytest.approx(math.exp(-1.0)) and r["role"] == 1.0
    assert {x["m_col"] for x in columns.where("r_col = 'day'").collect()} == {"made"}
    tables = dm.table_scores(columns, *two)
    t = tables.first()
    assert t["dependency"] == 0.0 and t["cardinality"] == pytest.approx(math.exp(-0.4 * abs(math.log(101) - math.log(51))))
    (a, b, s, pairs), = dm.match_by_data(columns, tables)
    assert (a, b) == ("a", "b") and s == t["score"] and {p[:2] for p in pairs} >= {("kind", "sort"), ("day", "made")}


def test_renamed_columns_are_found_by_their_data(spark, two):
    """Names say nothing here: x, y and z are matched by ranges and domains."""
    a = two[0]["a"].select("id", "kind", "price")
    b = a.selectExpr("price as x", "id as y", "kind as z")
    sa = schema(spark, [("a", "id", "INT", "attribute"), ("a", "kind", "TEXT", "attribute"), ("a", "price", "FLOAT", "attribute")])
    sb = schema(spark, [("b", "x", "FLOAT", "attribute"), ("b", "y", "INT", "attribute"), ("b", "z", "TEXT", "attribute")])
    none = spark.createDataFrame([], FDS)
    given = ({"a": a}, {"b": b}, sa, sb, none, none)
    columns = dm.column_scores(*given)
    (_, _, _, pairs), = dm.match_by_data(columns, dm.table_scores(columns, *given))
    assert {p[:2] for p in pairs} == {("id", "y"), ("kind", "z"), ("price", "x")}


def test_similarities_of_none(spark):
    row = spark.sql("select array(0.0D, 0.0D) as z, array(1.0D, 2.0D) as v, 0L as n")
    got = row.select(dm.signature_similarity(F.col("z"), F.col("z")), dm.signature_similarity(F.col("z"), F.col("v")), dm.signature_similarity(F.col("v"), F.col("v")), dm.cardinality_similarity(F.col("n"), F.col("n"))).first()
    assert list(got) == pytest.approx([1.0, 0.0, 1.0, 1.0])


def plain_similar(rows, threshold, weighting, stop=()):
    counts = {}
    for i, t in rows:
        if i is not None:
            counts.setdefault(i, Counter()).update(w for w in re.findall(r"\w{2,}", (t or "").lower()) if w not in stop)
    counts = {i: c for i, c in counts.items() if c}
    df = Counter(w for c in counts.values() for w in c)
    out = {}
    ids = sorted(counts)
    rep = {i: next(j for j in ids if counts[j] == counts[i]) for i in ids}
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if rep[b] != b:
                if rep[b] == a:
                    out[a, b] = 1.0
                continue
            if rep[a] != a:
                continue
            idf = lambda w: math.log((1 + 2) / (1 + (w in counts[a]) + (w in counts[b]))) + 1 if weighting == "pair" else math.log((1 + len(counts)) / (1 + df[w])) + 1  # noqa: B023, E731
            v = [{w: n * idf(w) for w, n in counts[i].items()} for i in (a, b)]
            dot = sum(n * v[1].get(w, 0.0) for w, n in v[0].items())
            cosine = dot / math.sqrt(sum(n * n for n in v[0].values()) * sum(n * n for n in v[1].values()))
            if cosine > threshold:
                out[a, b] = cosine
    return out


@pytest.mark.parametrize("weighting", ["pair", "corpus"])
@pytest.mark.parametrize("threshold", [0.0, 0.4, 0.9])
def test_similar_texts_equal_all_pairs(spark, weighting, threshold):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(40)] + ["école", "x_y", "the"]
    rows = [(i, " ".join(rng.choice(words[: rng.choice([6, 20, 43])]) for _ in range(rng.choice([0, 1, 3, 12])))) for i in range(45)]
    rows += [(100, rows[5][1]), (101, rows[5][1].upper()), (102, None), (None, "w1 w2"), (103, "a b c"), (104, "w1"), (104, "w2"), (105, "long " * 4000)]
    df = spark.createDataFrame(rows, "id long, text string").selectExpr("*", "1 as doc", "2 as term", "3 as df")
    got = {(r["a"], r["b"]): r["similarity"] for r in td.similar_texts(df, threshold=threshold, weighting=weighting, stop_words=("the",)).collect()}
    want = plain_similar(rows, threshold, weighting, ("the",))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_diverse_or_not_and_bad_parameters(spark):
    df = spark.createDataFrame([(1, "one two three"), (2, "four five six"), (3, None)], "id long, text string")
    assert td.is_diverse(df) and not td.is_diverse(df.union(spark.sql("select 4L, 'five six four'"))) and td.is_diverse(df.limit(0))
    for bad in ({"threshold": 1.0}, {"weighting": "none"}):
        with pytest.raises(ValueError, match="threshold"):
            td.similar_texts(df, **bad)
