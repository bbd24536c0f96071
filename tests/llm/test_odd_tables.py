"""Operators on tables with clashing columns, null ids, very long texts and no rows."""

import pytest

from weftspark.llm import page_text, quality, token_counts
from weftspark.llm.digests import vocabulary


def test_pages_clashing_columns_null_ids_and_a_very_long_page(spark):
    long = "<article>" + "".join(f"<p>Paragraph {i} of a long page</p><aside>ad {i}</aside>" for i in range(20_000)) + "</article>"
    rows = [(None, "http://h/1", "<article><p>One</p></article>"), (None, None, "<article><p>Two</p></article>"), (7, "http://h/2", long), (8, "http://h/3", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as row", "2 as host", "3 as hashes", "4 as text", "5 as turned", "6 as copy")
    out = page_text.main_text(df)
    got = sorted((str(r["page_id"]), r["n_chars"], r["text"][:15], r["row"], r["copy"]) for r in out.collect())
    want = "\n".join(f"Paragraph {i} of a long page" for i in range(20_000))
    assert got == [("7", len(want), "Paragraph 0 of ", 1, 6), ("8", 0, "", 1, 6), ("None", 3, "One", 1, 6), ("None", 3, "Two", 1, 6)]
    assert page_text.main_text(df.limit(0)).count() == 0


def test_page_ties_of_nearest_paths_are_settled_alike(spark):
    page = lambda own: f"<div>Site</div><div>{own}</div><div>Foot</div>"
    rows = [(i, f"http://h/p{i}", page(f"Own {i}")) for i in (3, 1, 4, 2, 5)]
    texts = lambda order: {r["page_id"]: r["text"] for r in page_text.main_text(spark.createDataFrame(order, "page_id long, url string, html string").repartition(3)).collect()}
    assert texts(rows) == texts(rows[::-1]) == {i: f"Own {i}" for i in range(1, 6)}


def test_quality_clashing_columns_and_a_very_long_text(spark):
    rows = [(i, ("good words in a line " * 20 if i % 2 else "!!! $$$ 0000 " * 20), "en", f"s{i % 3}") for i in range(60)] + [(None, "good words in a line " * 50_000, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as evidence", "2 as keep", "3 as n", "4 as host", "5 as posterior_", "6 as site_prior")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int").selectExpr("*", "9 as text", "8 as source")
    out = quality.classify(df, labels)
    kept = {r["doc_id"]: r["keep"] for r in out.collect()}
    assert kept == {i: bool(i % 2) for i in range(60)} | {None: True}
    assert out.columns[:4] == df.columns[:4] and {"n", "host", "posterior_"} < set(out.columns) and out.columns.count("keep") == 1


@pytest.mark.parametrize("block", [64, 1 << 16])
def test_token_counts_clashing_columns_and_a_very_long_text(spark, block):
    rows = [(1, "a b"), (None, None), (1, "word " * 60_000), (2, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as file", "2 as n_tokens", "3 as ordinal", "4 as ends")
    if block == 64:
        df = df.where("length(text) < 10 or text is null")
    import base64

    import tiktoken
    from public_tokenizers import PATTERN

    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}, special_tokens={})
    want = sorted((str(r["doc_id"]), len(coder.encode_ordinary(r["text"] or ""))) for r in df.collect())
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts.count_tokens(df, path, 50256, block_bytes=block).collect()) == want
