"""Vector search, Jaccard join, pages, pieces, media and token files against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftspark.llm import jaccard_join, media_store, page_text, quality, sentence_pieces, token_counts, vector_search
from weftspark.llm.digests import piece_digests, vocabulary


def docs(spark, texts, ids=None):
    rows = [(i, t, "en", f"src{k % 3}") for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


# -- vectors -----------------------------------------------------------------------------
def brute_top(rows, k=10):
    ints = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in {i: v for i, v in ints if i % 100 == 0}.items():
        found = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in ints if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_vector_top_k_with_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(330)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # copies of a query's vector
    rows += [(2000, None), (2001, [float("nan")] * 8), (2002, [1.0, None] * 4), (None, [0.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn
    got = vector_search.top_k(df("rank", __import__("pyspark").sql.functions.lit(1)).repartition(5))
    assert sorted(tuple(r) for r in got.collect()) == brute_top(rows)


def test_vector_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in vector_search.top_k(few).collect()] == [(0, 1, 1, 1536 * 1024)]
    assert vector_search.top_k(few.limit(0)).count() == 0


def test_vector_repeated_ids_and_extra_columns(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 40, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(90) if i % 40]
    rows += [(100, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as x", "2 as q_row", "3 as upper", "4 as query_id", "5 as ids")
    assert sorted(tuple(r) for r in vector_search.top_k(df).collect()) == brute_top(rows)


def test_vector_overlong_and_uneven(spark):
    big = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="64 bits"):
        vector_search.top_k(big)
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1e12, 0.0])]  # scores of 524288 and 1.05e18
    assert sorted(tuple(r) for r in vector_search.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()) == brute_top(rows)
    rng = np.random.default_rng(9)
    mixed = [(i, [float(x) for x in rng.normal(size=3) * (1e9 if i % 3 == 0 else 1.0)]) for i in range(1, 400)] + [(400, [1e-3, -1e-3, 2e-3])]
    few = [(i, v) for i, v in mixed if i % 100 or i == 400]
    assert sorted(tuple(r) for r in vector_search.top_k(spark.createDataFrame(few, "vec_id long, embedding array<double>")).collect()) == brute_top(few)
    over = spark.createDataFrame([(0, [1e14, 0.0]), (1, [1e14, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="OVERFLOW|overflow|out of range"):
        vector_search.top_k(over).collect()
    uneven = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="numbers of components"):
        vector_search.top_k(uneven)


# -- Jaccard -----------------------------------------------------------------------------
def brute_components(items):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in items:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), top(i)) for i in ids)


def near_copies(seed, groups, size, words, edits):
    r = random.Random(seed)
    out = []
    common = [f"c{r.randrange(10**6)}" for _ in range(60)]
    for g in range(groups):
        base = [f"w{r.randrange(10**5)}" for _ in range(words)]
        for _ in range(size):
            t = list(base)
            for _ in range(r.randrange(edits)):
                t[r.randrange(len(t))] = f"e{r.randrange(10**6)}"
            if r.random() < 0.5:
                t = common + t
            out.append(" ".join(t))
        out.append(out[-1])
    return out


@pytest.mark.parametrize("seed,groups,size,words,edits", [(1, 6, 9, 120, 9), (2, 1, 70, 150, 12)])
def test_jaccard_components(spark, seed, groups, size, words, edits):
    texts = near_copies(seed, groups, size, words, edits)
    texts += [None, "", " \t\n", "one two", "ONE  two", "three", "a b c d e", "A b\tc d e"]
    want = brute_components(enumerate(texts))
    for limits in ({}, {"task_docs": 8, "task_hashes": 1500, "pivots": 4}):
        got = jaccard_join.jaccard_components(docs(spark, texts), **limits)
        assert sorted(tuple(r) for r in got.collect()) == want


def test_jaccard_large_group_of_near_copies(spark):
    """500 near copies about the threshold, through pivots, Voronoi regions and blocks."""
    r = random.Random(11)
    base = [f"w{r.randrange(10**5)}" for _ in range(90)]
    texts = []
    for i in range(500):
        t = base[(i % 3) * 8 :]
        for _ in range(r.randrange(4)):
            t[r.randrange(len(t))] = f"e{r.randrange(10**6)}"
        texts.append(" ".join(t))
    df = docs(spark, texts).repartition(5)
    got = jaccard_join.jaccard_components(df, task_docs=64, pivots=5)
    assert sorted(tuple(r) for r in got.collect()) == brute_components(enumerate(texts))


def test_jaccard_long_texts_and_clashing_columns(spark):
    r = random.Random(12)
    long = [f"w{r.randrange(10**6)}" for _ in range(120_000)]
    texts = [" ".join(long), " ".join(long[3000:]), " ".join(long[:60_000]), "w" * 500_000, "same words here are five"]
    df = docs(spark, texts).selectExpr("*", "1 as n", "2 as cid", "3 as set", "4 as region", "5 as sig", "6 as uid", "7 as doc", "8 as component_id")
    got = jaccard_join.jaccard_components(df)
    assert sorted((x["doc_id"], x["component_id"]) for x in got.collect()) == [(0, 0), (1, 0), (2, 2), (3, 3), (4, 4)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 14), min_size=1, max_size=12), min_size=2, max_size=14), st.data())
def test_link_region_joins_what_links_join(lists, data):
    sets = [np.unique(np.array(x, np.int64)) for x in lists]
    label = np.array(data.draw(st.lists(st.integers(0, 20), min_size=len(sets), max_size=len(sets))), np.int64)
    part = np.array(data.draw(st.lists(st.integers(0, 2), min_size=len(sets), max_size=len(sets))), np.int32)
    linked = lambda i, j: 100 * len({*sets[i]} & {*sets[j]}) >= 60 * len({*sets[i]} | {*sets[j]})
    found = jaccard_join.link_region(sets, label, part, 60)
    assert all(linked(i, j) for i, j in found)

    def groups(pairs):
        up = list(range(len(sets)))
        for i, j in pairs:
            a, b = up[i], up[j]
            up = [a if x == b else x for x in up]
        return [up.index(x) for x in up]

    alike = [(i, j) for i in range(len(sets)) for j in range(i) if label[i] == label[j]]
    asked = [(i, j) for i in range(len(sets)) for j in range(i) if linked(i, j) and not (part[i] and part[i] == part[j])]
    assert groups(alike + found) == groups(alike + asked) and len(found) < len(sets)


def test_jaccard_repeated_ids_keep_links_of_every_text(spark):
    a, b = ("a%d " * 40 % tuple(range(40))), ("b%d " * 40 % tuple(range(40)))
    got = jaccard_join.jaccard_components(docs(spark, [a, a, b, b + "x", "", None], [3, 5, 5, 7, 7, None]))
    assert sorted((x["doc_id"] or -1, x["component_id"] or -1) for x in got.collect()) == [(-1, -1), (3, 3), (5, 3), (5, 3), (7, 3), (7, 3)]
    last = 2**63 - 1
    got = jaccard_join.jaccard_components(docs(spark, [a, a], [last, None]))
    assert {(x["doc_id"], x["component_id"]) for x in got.collect()} == {(last, last), (None, None)}


def test_jaccard_null_and_repeated_ids(spark):
    texts = ["a b c d e f", "a b c d e f", "x y z u v w", "q q q q q q"]
    got = jaccard_join.jaccard_components(docs(spark, texts, [5, None, 5, 7]))
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in got.collect()) == [(-1, -1), (5, 5), (5, 5), (7, 7)]
    assert jaccard_join.jaccard_components(docs(spark, texts).limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB \t\né\x0b😀c"), max_size=40), min_size=1, max_size=6))
def test_shingler_counts_like_plain(texts):
    found = jaccard_join.Shingler(5)(pa.array(texts))
    assert [(i, len(s)) for i, s in enumerate(found)] == [(i, n) for i, n, _ in brute_components(enumerate(texts))]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["id"]: r["component"] for r in jaccard_join.components(links).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


# -- pages -------------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies</div>{body}
<div id="comments"><p>First!</p></div><form><input><label>Mail</label></form><footer>&copy; x</footer></body></html>"""


def test_page_structure():
    article = "<article><h1>Head &amp; shoulders</h1><p>A  <b>bold</b>\n word&nbsp;x<br>next<aside>ad</aside><p>Two<ul><li>i1<li>i2</ul></article>"
    lines = [t for t, s in page_text.page_lines(PAGE.replace("{body}", article)) if s == page_text.KEEP]
    assert lines == ["Head & shoulders", "A bold word x next", "Two", "i1", "i2"]


@pytest.mark.parametrize(("page", "want"), [
    ('<body class="post has-sidebar"><nav>n</nav><article><p>A</article><div class="sidebar">s</div>', ["A"]),
    ('<body class="search"><p>A<div class="sidebar">s</div>', ["A"]),
    ('<div class="content no-sidebar"><p>A</div>', ["A"]),
    ('<div id="content-sidebar-wrapper"><p>A</p><div class="sidebar">s</div></div>', ["A"]),
    ('<div class="sidebar-layout"><h1>T</h1><article><p>A</article><div class="sidebar">s</div></div>', ["A", "T"]),
    ('<form id="aspnetForm"><main><p>A</main></form>', ["A"]),
    ('<article><h2 id="search-methods">H</h2><p class="notice">N</p><section id="related-work"><p>R</p></section><p class="ad">x<div class="share">y</div></article>', ["H", "N", "R"]),
    ('<article><p>A</article><section class="related"><article><p>teaser</article></section><div class="post-comments"><p>c</div>', ["A"]),
    ('<main><p>A<div id="comments"><p>c</div></main><div class="sidebar-content"><p>s</div>', ["A"]),
    ('<html><head><title>t</title><meta charset=utf-8><body><p>A', ["A"]),
    ('<head><title>t</title><style>s</style><p>A<script>x</script>', ["A"]),
    ('<head><title>t</title>A', ["A"]),
    ('<article><p title="A hidden gem">A</p><p hidden>h<p data-x=hidden>B<p title=\'class="ad"\'>C</article>', ["A", "B", "C"]),
    ('<article><p class="ad">x<div>A</div><p class="ad">y<ul><li>B</ul></article>', ["A", "B"]),
    ('<table><tr><td class=sidebar>x<td>A<tr><td>B<tr class=ad><td>y</table><p>C', ["A", "B", "C"]),
    ('<dl><dt>A<dd class="ad">x<dt>B<dd><p>C<dd>D</dl>', ["A", "B", "C", "D"]),
    ('<ul><li class=ad><div>x<li>A<ul><li>B</ul><li>C</ul>', ["A", "B", "C"]),
    ('<article><p>A</p><div class="related-posts"><a>x</a></div><ul class="shareButtons"><li>y</ul><p class="related-work">B<div class="content-list">C</div></article>', ["A", "B", "C"]),
    ('<table><tr><td><table class=ad><tr><td>x</table>A<td>B</table>', ["A", "B"]),
])
def test_page_words_of_class_and_id(page, want):
    gone = (page_text.DROP,)
    assert sorted(t for t, s in page_text.page_lines(page) if s not in gone) == sorted(want)


def test_page_differencing_without_structure(spark):
    rows = []
    for i in range(6):
        body = f"<div>Site name</div><div>Unique text number {i}</div><div>All rights reserved</div>"
        rows.append((i, f"http://h.example/a/{i}", f"<body>{body}</body>"))
    rows += [(9, None, None), (10, "http://lone.example/", "<p>alone")]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in page_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == (f"Unique text number {i}", 20)
    assert got[9] == ("", 0) and got[10] == ("alone", 5)


def page_texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in page_text.main_text(df).collect()}


def test_page_differencing_beside_and_inside_articles(spark):
    page = "<body><h2>Own head {i}</h2><p>Call us today</p><div>Advert {i}</div><article><div>Share this</div><p>Text {i}</p><p>Same</p><div>Note {i}</div></article></body>"
    got = page_texts(spark, [(i, f"http://h/{i}", page.replace("{i}", str(i))) for i in range(4)] + [(9, "http://lone/", page)])
    assert got == {i: f"Own head {i}\nText {i}\nSame\nNote {i}" for i in range(4)} | {9: "Share this\nText {i}\nSame\nNote {i}"}
    # One article on two pages: what they share in it stays.
    twice = "<nav>{i}</nav><div class='content'>One<br>two <div>three</div></div>"
    assert set(page_texts(spark, [(i, f"http://h/{i}", twice.replace("{i}", str(i))) for i in range(3)]).values()) == {"One two\nthree"}


def test_page_copies_and_quotes_without_structure(spark):
    page = lambda *own: "".join(f"<div>{t}</div>" for t in ("Site name", *own, "All rights reserved"))
    rows = [(i, "http://copies/a" if i < 2 else f"http://copies/a{i}", page("Copied", "text")) for i in range(4)]
    rows += [(10 + i, f"http://copies/b{i}", page(f"Own {i}", *["Quoted"] * (i in (1, 2)))) for i in range(4)]
    rows += [(20 + i, f"http://only/{i}", page("Alone")) for i in range(3)]
    want = dict.fromkeys(range(4), "Copied\ntext") | {10: "Own 0", 11: "Own 1\nQuoted", 12: "Own 2\nQuoted", 13: "Own 3"}
    want |= dict.fromkeys(range(20, 23), "Site name\nAlone\nAll rights reserved")  # nothing to difference with
    assert page_texts(spark, rows) == want


def test_page_articles_that_copies_share_stay(spark):
    html = PAGE.replace("{body}", "<article><p>Same text</p></article>")
    df = spark.createDataFrame([(i, f"http://h/{i // 2}", html) for i in range(5)], "page_id long, url string, html string")
    assert {r["text"] for r in page_text.main_text(df).collect()} == {"Same text"}
    assert page_text.main_text(df.limit(0)).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_common_lines_is_a_longest_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    got = sorted(page_text.common_lines(a, b))
    rest = iter(b)
    assert len(got) == best[-1][-1] and all(any(a[i] == y for y in rest) for i in got)


# -- quality -----------------------------------------------------------------------------
def test_quality_fits_the_same_rows_of_repeated_ids_in_any_order(spark):
    rows = [(i % 2, ("Word %d! " % i) * (1 + i % 7)) for i in range(40)]
    labels = spark.createDataFrame([(0, 0), (1, 1)], "doc_id long, quality int")
    fits = []
    for part in (rows, rows[::-1]):
        weights, base = quality.fit(spark.createDataFrame(part, "doc_id long, text string").coalesce(1), labels, "doc_id", "text", "quality", 12)
        fits.append((weights.tolist(), base))
    assert fits[0] == fits[1]


# -- pieces ------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"ab e  \n\t▁éß日😀<>s/01\x00.,", "the", "ing"]), max_size=60).map("".join), max_size=4))
def test_pieces_equal_the_library(texts):
    model = sentence_pieces.merger(vocabulary("piece_bpe_32k.model"))
    want = model.library.encode(texts, add_eos=True)
    assert [ids.tolist() for ids in model.encode(texts)] == want
    for text in texts:  # the agenda on its own, too
        assert [i for u in (model.cut(model.library.normalize(text)) if text else []) for i in model.encode_unit(u)] == model.library.encode(text)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.sampled_from("▁abehilnorst"), min_size=1, max_size=40), min_size=1, max_size=8, unique=True))
def test_rounds_over_many_units_are_their_agendas(units):
    model = sentence_pieces.merger(vocabulary("piece_bpe_32k.model"))
    units = [u for u in units if model.usual(u)]
    if units:
        assert [np.frombuffer(x, np.int32).tolist() for x in model.merge_many(units)] == [model.encode_unit(u) for u in units]


def test_other_ids_than_the_library_are_an_error(monkeypatch):
    model = sentence_pieces.Merger(vocabulary("piece_bpe_32k.model"))
    monkeypatch.setattr(model, "merge_many", lambda units: [np.array([5], np.int32).tobytes() for _ in units])
    with pytest.raises(ValueError, match="by the library"):
        model.encode(["hello there"])


def test_memory_of_units_keeps_those_met_again(monkeypatch):
    model = sentence_pieces.Merger(vocabulary("piece_bpe_32k.model"))
    monkeypatch.setattr(sentence_pieces, "UNITS", 4)
    monkeypatch.setattr(sentence_pieces, "TOGETHER", 2)
    learned, learn = [], model.learn
    monkeypatch.setattr(model, "learn", lambda units: (learned.extend(units), learn(units)))
    for i in range(6):
        texts = [f"often word{i} other{i} last{i}", "often " + "é" * 60]
        assert [x.tolist() for x in model.encode(texts)] == model.library.encode(texts, add_eos=True)
    assert learned.count("▁often") == 1 and len(model.known) < 12 and len(model.older) < 12


def test_memory_of_units_is_that_of_those_met_again(monkeypatch):
    """Units met once are forgotten, and the library checks a few at a time."""
    model = sentence_pieces.Merger(vocabulary("piece_bpe_32k.model"))
    monkeypatch.setattr(sentence_pieces, "UNITS", 30)
    monkeypatch.setattr(sentence_pieces, "TOGETHER", 8)
    asked, learn = [], model.learn
    monkeypatch.setattr(model, "learn", lambda units: (asked.append(len(units)), learn(units)))
    for i in range(20):
        texts = [" ".join(["often", *(f"word{i}x{j}" for j in range(10))]), "often again"]
        assert [x.tolist() for x in model.encode(texts)] == model.library.encode(texts, add_eos=True)
    assert max(asked) <= 8 and sum(asked) == 20 * 10 + 2
    assert set(model.older) == {"▁often", "▁again"} and len(model.known) <= 30 + 12


def test_pairs_are_looked_up_once_and_where_a_symbol_merged(monkeypatch):
    model = sentence_pieces.merger(vocabulary("piece_bpe_32k.model"))
    asked = []
    searched = np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda keys, values: (asked.append(len(values)), searched(keys, values))[1])
    made = model.merge_many(["▁transformation" * 3] * 50)
    merges = 50 * 45 - sum(len(x) // 4 for x in made)
    assert sum(asked) <= 50 * 45 + 2 * merges


def test_pieces_clashing_columns_and_empty_table(spark):
    df = docs(spark, ["a b", None], [None, 3]).selectExpr("*", "1 as ids", "2 as decoded", "4 as _sp_x")
    got = sentence_pieces.encode_texts(df, vocabulary("piece_bpe_32k.model"))
    assert got.columns == ["doc_id", "lang", "source", "_sp_x", "ids", "decoded"] and {r["decoded"] for r in got.collect()} == {"a b", ""}
    assert sentence_pieces.encode_texts(df.limit(0), vocabulary("piece_bpe_32k.model")).count() == 0


def test_piece_query(spark):
    texts = ["Hello  world\n", None, "", "x" * 500, "日本\x00"]
    library = sentence_pieces.merger(vocabulary("piece_bpe_32k.model")).library
    for r in piece_digests(docs(spark, texts)).collect():
        ids = library.encode(texts[r["doc_id"]] or "", add_eos=True)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == digest(" ".join(map(str, ids))) and r["decoded_sha256"] == digest(library.decode(ids))


# -- media -------------------------------------------------------------------------------
@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=300))
def test_png_round_trip(data):
    payload = media_store.padded(data)
    assert len(payload) % 64 == 0 and len(payload) > 0 and payload.startswith(data)
    image = media_store.png(payload)
    assert media_store.samples(image) == payload
    broken = bytearray(image)
    broken[len(image) // 2] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media_store.samples(bytes(broken))


def test_media_query(spark):
    texts = ["abc", None, "", "é" * 100, "abc"]
    got = {r["doc_id"]: r for r in media_store.store_and_describe(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        payload = media_store.padded((t or "").encode())
        assert got[i]["n_bytes"] == len((t or "").encode()) and got[i]["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert got[i]["tail_crc32"] == zlib.crc32(payload[-64:])
    assert got[0].asDict() | {"doc_id": 4} == got[4].asDict()
    assert media_store.store_and_describe(docs(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("range_bytes", [700, 1 << 24])
def test_media_ranges_repeated_ids_and_clashing_columns(spark, range_bytes):
    r = random.Random(3)
    texts = ["".join(r.choices("abcdef é", k=r.randrange(3000))) for _ in range(40)] + [None, "long " * 200_000]
    ids = [None if i % 7 == 0 else i % 11 for i in range(len(texts))]
    df = docs(spark, texts, ids).selectExpr("*", "1 as archive", "2 as bytes", "3 as share").repartition(3)
    made = media_store.write_archives(df.selectExpr("doc_id", "coalesce(text, '')"), media_store.fresh_path(spark, "t"))
    got = media_store.media_features(media_store.read_archives(media_store.written(made, "t"), range_bytes)).collect()
    want = [(i, len((t or "").encode()), hashlib.sha256(media_store.padded((t or "").encode())).hexdigest()) for i, t in zip(ids, texts, strict=True)]
    assert sorted(map(repr, want)) == sorted(repr((x["doc_id"], x["n_bytes"], x["payload_sha256"])) for x in got)


def test_member_is_read_again_by_offset():
    class File:
        def __init__(self, data):
            self.data = data

        def read_at(self, n, at):
            return self.data[at : at + n]

    good = b"h" * 33 + b"payload"
    tries = []
    opener = lambda k: tries.append(k) or File(b"x" * 40 if k < 2 else good)
    assert media_store.read_member(opener, b"abc", 0, 7, zlib.crc32(b"payload"), 0.0) == b"payload" and tries == [0, 1, 2]
    with pytest.raises(OSError):
        media_store.read_member(lambda k: File(b""), b"abc", 0, 7, 1, 0.0)


# -- tokens ------------------------------------------------------------------------------
@pytest.mark.parametrize("block", [2, 14, 4096])
def test_token_counts(spark, block):
    texts = ["hello world", None, "", "a b c d e f g " * 20, "é"]
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    want = {i: len(token_counts.encoder(path).encode_ordinary(t or "")) for i, t in enumerate(texts)}
    got = token_counts.count_tokens(docs(spark, texts), path, 50256, block_bytes=block)
    assert {r["doc_id"]: r["n_tokens"] for r in got.collect()} == want


def test_token_file_without_last_separator(spark, tmp_path):
    np.array([5, 6, 9, 9, 7], "<u2").tofile(tmp_path / "f.tokens")
    files = spark.createDataFrame([(f"file://{tmp_path}/f.tokens",)], "file string")
    assert sorted((r["ordinal"], r["n_tokens"]) for r in token_counts.scan_token_files(files, 9, 4).collect()) == [(0, 2), (1, 0), (2, 1)]


# -- quality -----------------------------------------------------------------------------
def test_quality_held_out(spark):
    r = random.Random(5)
    good = [" ".join(f"w{r.randrange(500)}" for _ in range(60)) + "." for _ in range(60)]
    bad = [" ".join(f"w{r.randrange(500)}###" for _ in range(60)) for _ in range(60)]
    texts = [t for pair in zip(good, bad, strict=True) for t in pair]
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(60)], "doc_id long, quality int")
    out = quality.classify(docs(spark, [*texts, None, ""]), labels).collect()
    held = [r["keep"] == (r["doc_id"] % 2 == 0) for r in out if 60 <= r["doc_id"] < 120]
    assert sum(held) / len(held) > 0.95 and len(out) == 122


def test_quality_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    df = docs(spark, ["a", None])
    assert [r["keep"] for r in quality.classify(df, labels).collect()] == [True, True]
    assert quality.classify(df.limit(0), labels).count() == 0


# -- pipeline ----------------------------------------------------------------------------
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    texts = [" ".join(f"w{r.randrange(900)}" for _ in range(80)) + f".\nline {i} of this text" for i in range(30)]
    texts += [texts[0], texts[1] + " more"] + [" ".join(f"w{r.randrange(900)}###" for _ in range(80)) for _ in range(30)]
    df = docs(spark, texts).selectExpr("*", "cast(length(text) as long) as n_chars")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 32)) for i in range(0, 62, 2)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(corpus_pipeline.STAGES)
    one = stage["quality_classifier"](spark, df, str(tmp_path))
    assert {x["doc_id"] for x in one.collect()} == set(range(32)) and one.columns == df.columns
    two = stage["line_dedup"](spark, one, str(tmp_path))
    assert two.columns == df.columns and {x["doc_id"]: x["text"] for x in two.collect()}[30] == ""
    three = stage["jaccard_join"](spark, one, str(tmp_path))
    assert {x["doc_id"] for x in three.collect()} == set(range(30))
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert "ids_sha256" in final.columns and final.count() > 0


# -- the whole pipeline in plain Python --------------------------------------------------------
def plain_quality(rows, labels, threshold=0.5):
    """Rows that the classifier keeps, from the definitions of its docstrings."""
    def features(text):
        text = text or ""
        n, words, lines = max(len(text), 1), re.split(r"[\x20\x09-\x0D]+", text), text.split("\n")
        share = lambda letters: sum(c in letters for c in text) / n
        return [math.log(n), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("0123456789"), share(set(quality.SYMBOLS)), share("!"), len(set(words)) / len(words),
                len(set(lines)) / len(lines), min(n / len(words), 100.0), math.log(len(lines))]

    known = [(features(t), y) for i, t, *_ in rows for j, y in labels if i == j]
    x, y = np.array([f for f, _ in known]), np.array([v for _, v in known], float)
    mean, deviation = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([np.ones(len(x)), (x - mean) / deviation])
    w, ridge = np.zeros(z.shape[1]), np.diag([1e-6] + [0.5] * x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (p - y) + ridge @ w)
    evidence = [float(np.clip(w[0] + w[1:] @ ((np.array(features(t)) - mean) / deviation), -30, 30)) for _, t, *_ in rows]
    p = [1 / (1 + math.exp(-e)) for e in evidence]
    site = [(r[3], r[2]) for r in rows]
    rate = min(max(sum(p) / len(p), 1e-6), 1 - 1e-6)
    total = lambda keep: (sum(1 for s in site if keep(s)), sum(q for q, s in zip(p, site, strict=True) if keep(s)))
    hosts = {h: total(lambda s, h=h: s[0] == h) for h, _ in site}
    paths = {s: total(lambda o, s=s: o == s) for s in site}

    def strength(parts):
        noise = rate * (1 - rate)
        squares = sum(n * (s / n - m) ** 2 for n, s, m in parts)
        return min(max(noise / max((squares - noise * (len(parts) - 1)) / len(p), 1e-9) - 1, 1.0), 1e4)

    k = strength([(n, s, rate) for n, s in hosts.values()])
    host_mean = {h: (s + k * rate) / (n + k) for h, (n, s) in hosts.items()}
    k = strength([(n, s, host_mean[h]) for (h, _), (n, s) in paths.items()])
    kept = []
    for row, e, q, s in zip(rows, evidence, p, site, strict=True):
        n, total_p = paths[s]
        prior = min(max((total_p - q + k * host_mean[s[0]]) / (n - 1 + k), 1e-9), 1 - 1e-9)
        odds = e - math.log(y.mean() / (1 - y.mean())) + math.log(prior / (1 - prior))
        if 1 / (1 + math.exp(-min(max(odds, -30), 30))) >= threshold:
            kept.append(row)
    return kept


def plain_lines(rows):
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))
    order = lambda i: (i is None, i or 0)
    holders = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(order(i))
    gone = lambda line, i: len(key(line)) >= 10 and min(holders[key(line)]) < order(i)
    return [(r[0], "\n".join(x for x in (r[1] or "").split("\n") if not gone(x, r[0])), *r[2:]) for r in rows]


def plain_mix(rows):
    """{(doc_id, text): copies} of the mix."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    own = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in sources}
    target, left = {}, float(sum(own.values()))
    while len(target) < len(sources):
        level = left / sum(weight[s] for s in sources if s not in target)
        full = [s for s in sources if s not in target and weight[s] * level > 3 * own[s]]
        for s in full or [s for s in sources if s not in target]:
            target[s] = 3.0 * own[s] if full else weight[s] * level
        left -= sum(target[s] for s in full)
    out = {}
    for s in sources:
        mine = sorted((hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), -1 if r[0] is None else r[0], size(r[1]), r[1]) for r in rows if r[3] == s)
        passes = int(target[s] // own[s]) if own[s] else 0
        rest, start, taken, missed = target[s] - passes * own[s], 0, 0, []
        for _, i, n, t in mine:
            more = n > 0 and start + n <= rest
            taken += n * more
            out[i, t] = out.get((i, t), 0) + (passes + more) * (n > 0)
            if n and not more:
                missed.append((start, i, n, t))
            start += n
        gap = rest - taken
        near = sorted((abs(n - gap), start, i, t) for start, i, n, t in missed if abs(n - gap) < gap)
        if near:
            out[near[0][2], near[0][3]] += 1
    return {k: v for k, v in out.items() if v}


def test_pipeline_equals_plain_python(spark, tmp_path):
    """All rows of run() on nulls, empty and very long texts, copies, repeated rows and lines."""
    import corpus_pipeline

    r = random.Random(21)
    good = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n)) + "."
    texts = [good(40 + i) + "\nA line that many hold, again\n" * (i % 3 == 0) + f"own line {i}" for i in range(40)]
    texts += [texts[3], texts[4] + " more", texts[5].replace("w1", "v1", 1), good(9000)]
    texts += [" ".join(f"w{r.randrange(900)}###" for _ in range(60)) for _ in range(30)] + [None, "", "\n"]
    rows = [(i, t, "en" if i % 4 else "de", ["a", "b", None, "c"][i % 4 if i % 9 else 3]) for i, t in enumerate(texts)]
    rows += [rows[7], rows[8], (9, "another text of the ninth, good as it is " + good(50), "en", "a"), (None, texts[10], "en", "a"), (None, good(30), "en", None)]
    labels = [(i, int(i < 44)) for i in range(0, len(texts) - 3, 2)]
    df = spark.createDataFrame([(*x, len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")

    kept = plain_lines(plain_quality(rows, labels))
    first = {i: c for i, _, c in brute_components([(x[0], x[1]) for x in kept if x[0] is not None and [y[0] for y in kept].count(x[0]) == 1])}
    several = {x[0] for x in kept if [y[0] for y in kept].count(x[0]) > 1} - {None}
    assert several == {7, 8, 9}
    stage = dict(corpus_pipeline.STAGES)
    docs_ = df
    for name in ("quality_classifier", "line_dedup", "jaccard_join"):
        docs_ = corpus_pipeline.written(stage[name](spark, docs_, str(tmp_path)), "test")
        if name == "line_dedup":
            assert sorted(map(repr, kept)) == sorted(repr(tuple(x)[:4]) for x in docs_.collect())
    left = [tuple(x)[:4] for x in docs_.collect()]
    assert sorted(map(repr, (x for x in left if x[0] not in several))) == sorted(repr(x) for x in kept if x[0] is None or (x[0] not in several and first[x[0]] == x[0]))
    assert sorted(x[0] for x in left if x[0] in several) == sorted(several) and all(x in kept for x in left)

    library = sentence_pieces.merger(vocabulary("piece_bpe_32k.model")).library
    digest = lambda t: hashlib.sha256(" ".join(map(str, library.encode(t or "", add_eos=True))).encode()).hexdigest()
    want = {}
    for (i, t), n in plain_mix(left).items():
        want[i, digest(t)] = want.get((i, digest(t)), 0) + n
    got = {}
    for x in corpus_pipeline.run(spark, str(tmp_path)).collect():
        k = (-1 if x["doc_id"] is None else x["doc_id"], x["ids_sha256"])
        got[k] = got.get(k, 0) + 1
    assert got == want


def test_pipeline_stages_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, extra int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        assert out.count() == 0 and (name == "sentence_pieces" or out.columns == df.columns)
