"""SimHash components against all pairs in plain Python."""

import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from weftspark.llm import simhash
from weftspark.llm.registry import op11_simhash
from weftspark.llm.shared import Scratch


def plain_print(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    """rows: (id, fingerprint) with ids; links of any pair, and of rows that repeat an id."""
    label = {i: i for i, _ in rows}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, (i, x) in enumerate(rows):
        for j, y in rows[:k]:
            if (x ^ y).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: root(i) for i in label}


def expected(rows):
    prints = [(i, plain_print(t)) for i, t in rows]
    comp = plain_components([(i, p) for i, p in prints if i is not None])
    return sorted(((i, f"{p:016x}", comp.get(i)) for i, p in prints), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "two words"), (7, "a b c"), (8, "a\x0bb\x1cc"), (9, "É b c d"), (None, "a b c"), (None, None)]
    for i in range(20, 70):
        base = [f"w{rng.randrange(40)}" for _ in range(rng.choice([3, 12, 300]))]
        rows.append((i, " ".join(base)))
        for j in range(rng.choice([0, 0, 1, 5])):
            other = list(base)
            other[rng.randrange(len(other))] = "Edit"
            rows.append((1000 + 10 * i + j, "  ".join(other)))
    rows += [(30, "another text of a known id"), (30, "a b c"), (31, rows[-1][1]), (31, rows[-1][1]), (400, "very long " * 30_000)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "most"), [(1, simhash.MOST), (2, 1), (3, 3)])
def test_equals_plain_python(spark, tmp_path, seed, most, monkeypatch):
    rows = corpus(seed)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(simhash.simhash_components, "__defaults__", (*simhash.simhash_components.__defaults__[:-1], most))
    assert sorted((tuple(r) for r in op11_simhash(spark, str(tmp_path)).collect()), key=repr) == expected(rows)


def near_prints(seed, groups, size):
    """Groups of fingerprints that walk away from their first one bit by bit, and lone ones."""
    rng, out = random.Random(seed), set()
    for _ in range(groups):
        x = rng.getrandbits(64)
        for _ in range(size):
            out.add(x)
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                x ^= 1 << b
    return sorted(out)


@pytest.mark.parametrize(("most", "groups", "size"), [(simhash.MOST, 60, 12), (2, 60, 12), (simhash.MOST, 1, 700), (16, 1, 300)])
def test_links_join_what_is_close(spark, most, groups, size):
    fps = near_prints(groups * size + most, groups, size)
    if groups == 1:  # a crowd about one fingerprint, nearly all of one block in many tables
        fps = sorted({fps[0] ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(40)})[:size] + [2**64 - 1, 2**63, 0]
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in sorted(set(fps))], "fp long").repartition(3)
    links = [(a % 2**64, b % 2**64) for a, b in simhash.fingerprint_links(Scratch(spark, "test"), df, most).collect()]
    want = plain_components([(x, x) for x in fps])
    label = {x: x for x in fps}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    assert {x: root(x) for x in fps} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=4)), min_size=1, max_size=150), st.integers(1, 40))
def test_blocks_and_carry_save_counts(found, at_once):
    rows = sorted({(key, (fp & ~0xFF | 0x55) ^ sum(1 << b for b in set(bits))) for key, fp, bits in found})
    keys, fps = np.array([k for k, _ in rows]), np.array([x for _, x in rows], np.uint64)
    before, simhash.AT_ONCE = simhash.AT_ONCE, at_once
    try:
        a, b = simhash.block_links(keys, fps)
    finally:
        simhash.AT_ONCE = before
    row, word, near = simhash.close_lanes(simhash.planes_of(fps), fps, np.repeat(np.arange(len(fps)), -(-len(fps) // 64)), np.tile(np.arange(-(-len(fps) // 64)), len(fps)))
    seen = {(r, 64 * w + i) for r, w, m in zip(row.tolist(), word.tolist(), near.tolist(), strict=True) for i in range(64) if m >> i & 1 and 64 * w + i < len(fps)}
    assert seen == {(i, j) for i, x in enumerate(fps.tolist()) for j, y in enumerate(fps.tolist()) if (x ^ y).bit_count() <= 2}
    # Each block's own links are joined, and nothing that no links join.
    whole, label = plain_components([(x, x) for x in fps.tolist()]), {x: x for x in fps.tolist()}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        assert whole[x] == whole[y]
        x, y = sorted((root(x), root(y)))
        label[y] = x
    for k in set(keys.tolist()):
        inside = [(x, x) for kk, x in zip(keys.tolist(), fps.tolist(), strict=True) if kk == k]
        for x, y in plain_components(inside).items():
            assert root(x) == root(y)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 700), max_size=6), st.integers(0, 2**32))
def test_majority_counts_all(counts, seed):
    values = np.random.default_rng(seed).integers(0, 2**64, sum(counts), np.uint64)
    got, at = simhash.majority(values, np.array(counts, np.int64)).tolist(), 0
    for n, bits in zip(counts, got, strict=True):
        held = values[at : at + n].tolist()
        assert bits == sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in held) > n)
        at += n


def test_band_masks_cover_every_two_bits():
    masks = simhash.band_masks()
    assert len(masks) == 6 and all(any(not m & (1 << a | 1 << b) for m in masks) for a in range(64) for b in range(64))


def test_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "A b c d")], "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id", "3 as rep", "4 as tab")
    assert {r["component_id"] for r in simhash.simhash_components(df).collect()} == {1}
    assert simhash.simhash_components(df.limit(0)).count() == 0
