"""Fill-in-middle against plain Python: units by whole matches, cuts by the id's digest."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from weftspark.llm.fill_middle import GRAMMARS, fill_in_middle, pieces, restore
from weftspark.llm.registry import op13_fill_middle

TEXTS = [
    (1, "one\ntwo\nthree"), (2, "one\n\n\ntwo\n"), (3, ""), (4, None), (5, "\n"), (6, "no newline at all"),
    (7, "a <P> mark\nof it"), (8, "<S>\n"), (9, "tail <M>"), (10, "<<P\n>\n<S\n"), (11, "é \U0001f600\n\U0001f600\r\nx y\n"),
    (None, "no id\nhere"), (12, "Hm... what?! Yes.\tNo. " * 40), (12, "same id\nother text\n"), (12, "same id\nother text\n"),
    (13, "long line " * 20000 + "\n" + "short\n" * 50000), (14, " \x0b lead and  trail \n "), (15, "a.b\nc! d"),
]
TEXTS += [(i, "".join(f"line {j} of {i}\n" for j in range(i % 9)) + "<" * (i % 3)) for i in range(100, 220)]


def plain(i, text, unit, rate=100, spm_rate=50, seed=7):
    text = text or ""
    units = re.findall(unit, text)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (i, len(units), "plain", None, None, text)
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm_rate:
        return (i, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}")
    return (i, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}")


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("name", sorted(GRAMMARS))
@pytest.mark.parametrize("rate", [100, 40])
def test_equals_plain_python(spark, name, rate):
    rows = [(i, t if t is None or name != "char" else t[:3000]) for i, t in TEXTS]
    out = fill_in_middle(frame(spark, rows), name, rate, 30, 11)
    got = out.select("doc_id", "n", "form", F.char_length("prefix"), F.char_length("middle"), "output", restore(F.col("output"), F.col("form")).alias("back"))
    want = sorted(((*plain(i, t, GRAMMARS[name].unit, rate, 30, 11), t or "") for i, t in rows), key=repr)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize("name", sorted(GRAMMARS))
def test_boundaries_are_those_of_the_units(spark, name):
    texts = ["", "\n", "\n\n", " ", ".", "a", "\U0001f600\U0001f600", "a\n b.c?! d\n\n", "\r\n\r", "x " * 50 + "\U0001f600\n."]
    got = frame(spark, list(enumerate(texts))).select("doc_id", pieces(F.col("text"), GRAMMARS[name])).collect()
    assert {i: u for i, u in got} == {i: re.findall(GRAMMARS[name].unit, t) for i, t in enumerate(texts)}


def test_query(spark, tmp_path):
    frame(spark, TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(*p[:5], sha(p[5]), sha(t or "")) for (i, t) in TEXTS for p in [plain(i, t, GRAMMARS["line"].unit)]]
    got = [tuple(r) for r in op13_fill_middle(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_clashing_columns_and_empty_table(spark):
    df = frame(spark, [(1, "a\nb\n")]).selectExpr("*", "7 as n", "'x' as form", "1 as units", "2 as output", "3 as c1")
    assert fill_in_middle(df).first()["output"] == plain(1, "a\nb\n", GRAMMARS["line"].unit)[5]
    assert fill_in_middle(df.limit(0)).count() == 0
