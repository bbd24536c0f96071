"""Importance resampling against plain Python, with whole texts and with texts in pieces."""

import hashlib
import math
import random
import re
import zlib

import pytest

from weftspark.llm import importance
from weftspark.llm.registry import op12_importance

RAW = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return RAW.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def counts(text, buckets):
    w, out = words_of(text), [0] * buckets
    for k in (1, 2, 3):
        for i in range(len(w) - k + 1):
            out[zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets] += 1
    return out


def plain(rows, target, percent=5, least_words=20, buckets=10_000, seed=42):
    s, t = [0] * buckets, [0] * buckets
    for held, texts in ((s, [x for _, x in rows]), (t, target)):
        for x in texts:
            for b, n in enumerate(counts(x, buckets)):
                held[b] += n
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for i, x in rows:
        m = len(words_of(x))
        weight = sum(n * gain[b] for b, n in enumerate(counts(x, buckets)) if n)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, m + max(m - 1, 0) + max(m - 2, 0), weight, score, None, m])
    drawn = sorted((r for r in out if r[5] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    for k, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def corpus(seed=3, n=120):
    rng = random.Random(seed)
    vocabulary = ["alpha", "Beta", "GAMMA", "école", "x1", "ÉTÉ", "中文", "42", "don't", "a-b"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary) + rng.choice(["", ",", "."]) for _ in range(rng.choice([0, 1, 2, 19, 20, 21, 80])))) for i in range(n)]
    rows += [(7, "alpha beta " * 15), (7, "alpha beta " * 15), (None, "w1 w2 w3 " * 10), (500, None), (501, ""), (502, "... !!"), (503, "one"), (504, "long word " * 3000)]
    return rows


TARGET = ["alpha beta gamma " * 8, "x1 42 don't", None, "", "中文 école"]


def frames(spark, rows, target=TARGET):
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id int, text string")


@pytest.mark.parametrize(("slice_bytes", "piece_words", "buckets"), [(1 << 19, 50_000, 512), (300, 7, 512), (1, 2, 64)])
def test_equals_plain_python(spark, slice_bytes, piece_words, buckets):
    rows = corpus()
    docs, target = frames(spark, rows)
    got = importance.resample(docs.repartition(3), target, 30, 20, buckets, slice_bytes=slice_bytes, piece_words=piece_words)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, TARGET, 30, 20, buckets)


def test_query(spark, tmp_path):
    rows = corpus(5, 60)
    docs, target = frames(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    target.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = op12_importance(spark, str(tmp_path))
    assert {k for _, k in got.dtypes} == {"bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, TARGET)


def test_pieces_hold_all_words():
    for n in range(12):
        text = ", ".join(f"W{i}" * (1 + i % 3) for i in range(n)) + " ."
        for size, chars in ((2, 99), (3, 99), (5, 99), (5, 6), (9, 1)):
            parts, at = importance.cut(text, size, chars), 0
            for piece, own in parts:
                assert words_of(piece) == words_of(text)[at : at + own + 2] and own <= size
                at += own
            assert at == n


def test_ties_empty_tables_and_clashing_columns(spark):
    rows = [(i // 2, "same words here " * 10) for i in range(40)]
    docs, target = frames(spark, rows)
    odd = docs.selectExpr("*", "1 as n_words", "2 as score", "3 as bucket", "4 as rank", "5 as sums")
    assert sorted((tuple(r) for r in importance.resample(odd, target, 50, 20, 64).collect()), key=repr) == plain(rows, TARGET, 50, 20, 64)
    assert importance.resample(odd.limit(0), target).count() == 0
    got = importance.resample(docs, target.limit(0), 50, 20, 64)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, [], 50, 20, 64)
