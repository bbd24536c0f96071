"""SimHash near-duplicates by bit-sliced comparison.

1. Every text gets a 64-bit fingerprint. Rows of one fingerprint are one class, held by the least
   id, so copies are compared once.
2. The 64 bits are ``BANDS`` bands. Fingerprints within the radius differ in no more bands than
   it has bits, so they are equal in all others: each fingerprint enters one table for each choice
   of these, keyed by the bits of its bands, and rows of one key are a block.
3. In a task, sorted rows lie 64 to a machine word, one word for each bit position (a bit plane).
   A fingerprint is compared with 64 others by one XOR a plane; their distances are counted in
   carry-save counters, of which four states matter: 0, 1, 2 and over the radius. A word whose
   lanes are all over it is abandoned. Each block hands on a tree of the links it found, not pairs.
4. A block over ``most`` fingerprints, which would be too long a job for one task, is left out of
   the tables. Its members enter, for each bit, the cell of the fingerprint that differs in this
   bit, and their own: two are within 2 bits if and only if they share a cell, and a cell can hold
   65 at most. So no block is unbounded and no link is lost.
5. Connected components of the links, on written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.llm.jaccard_join import components
from weftspark.llm.shared import LOWER, UPPER, Scratch

BITS, RADIUS, BANDS, SEED = 64, 2, 4, 42
#: Fingerprints of a block that tables compare. Larger blocks go by cells.
MOST = 4096
#: Bytes of texts whose shingles are hashed at once; a longer text alone.
SLICE_BYTES = 1 << 19
#: Planes that are added between two looks at what can be abandoned, and pairs (fingerprint, word)
#: compared at once.
STEP, AT_ONCE = 8, 1 << 15
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_LANES = np.uint64(0x0101010101010101)
_ALL = np.uint64(2**64 - 1)


def hashes(text: bytes, words: int) -> list[int]:
    """XXH64 of every run of ``words`` words, repeats included; of all words if there are fewer."""
    found = text.translate(_LOWER).split()
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(found), SEED)] if found else []
    line, size = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(size)
    starts, stops = (ends - size)[: len(found) - words + 1].tolist(), (ends - 1)[words - 1 :].tolist()
    return [xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)]


def majority(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per run of ``counts`` values (uint64) the bits that over half of them have.

    Eight bits at a time are counted in the bytes of one word, over at most 255 values, and these
    sums in full width.
    """
    out = np.zeros(len(counts), np.uint64)
    live = np.flatnonzero(counts)
    if not len(live):
        return out
    n = counts[live]
    starts = np.r_[0, np.cumsum(n)[:-1]]
    parts = -(-n // 255)
    first = np.r_[0, np.cumsum(parts)[:-1]]
    inside = np.arange(int(parts.sum())) - np.repeat(first, parts)
    cuts = np.repeat(starts, parts) + 255 * inside
    bits = np.zeros(len(live), np.uint64)
    for k in range(8):
        sums = np.add.reduceat((values >> np.uint64(k)) & _LANES, cuts)
        for lane in range(8):
            of_part = ((sums >> np.uint64(8 * lane)) & np.uint64(255)).astype(np.int64)
            bits |= (2 * np.add.reduceat(of_part, first) > n).astype(np.uint64) << np.uint64(8 * lane + k)
    out[live] = bits
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp) of every row, ``fp`` as a signed number; 0 for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, start = batch.column(1).cast(pa.binary()), 0
            ends = np.r_[0, np.cumsum(pc.binary_length(texts).to_numpy())]
            while start < len(texts):
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + SLICE_BYTES, "right")) - 1)
                found = [hashes(t, words) for t in texts.slice(start, stop - start).to_pylist()]
                flat = np.fromiter((h for f in found for h in f), np.uint64)
                fp = majority(flat, np.array([len(f) for f in found], np.int64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(fp)], names=["doc_id", "fp"])
                start = stop

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, fp long")


def band_masks(bands: int = BANDS, radius: int = RADIUS) -> list[int]:
    """The bits that each table's key takes: all choices of ``bands`` - ``radius`` bands."""
    edges = [BITS * i // bands for i in range(bands + 1)]
    of = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(of, bands - radius)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit b of fingerprint 64 * w + i is bit i of plane b's word w; padded with the last."""
    padded = np.r_[fps, np.full(-len(fps) % 64, fps[-1], np.uint64)]
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # (fingerprint, bit)
    packed = np.packbits(bits.reshape(-1, 64, 64).transpose(2, 0, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64)[:, :, 0]


def close_lanes(planes: np.ndarray, fps: np.ndarray, row: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs (fingerprint ``row``, ``word`` of 64 lanes) those with lanes within 2 bits, and the lanes.

    ``ones`` and ``twos`` are the two low bits of 64 distances, ``over`` is set for good once a
    distance has been 3: 3 itself moves there at once, so a count cannot run through it.
    """
    ones, twos, over = np.zeros((3, len(row)), np.uint64)
    mine = fps[row]
    for b in range(BITS):
        if b and b % STEP == 0:
            live = np.flatnonzero(over != _ALL)
            if len(live) < len(row):
                row, word, mine, ones, twos, over = (x[live] for x in (row, word, mine, ones, twos, over))
            if not len(row):
                break
        # 0 or all ones, by the fingerprint's own bit.
        differs = planes[b][word] ^ (np.uint64(0) - ((mine >> np.uint64(b)) & np.uint64(1)))
        carry = ones & differs
        ones ^= differs
        over |= twos & carry
        twos ^= carry
        over |= ones & twos
    near = ~over
    hit = np.flatnonzero(near)
    return row[hit], word[hit], near[hit]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives the ends of links the least label among what they join, in place."""
    while True:
        x, y = label[a], label[b]
        if np.array_equal(x, y):
            return
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while not np.array_equal(further := label[label], label):
            label[:] = further


def block_links(keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that join the linked fingerprints of every block, one less than each tree has nodes.

    ``keys`` (ascending) are the blocks of distinct ``fps``. A word may hold lanes of other blocks
    too: these are compared as well, and links found so are links.
    """
    n = len(fps)
    if n < 2:
        return fps[:0], fps[:0]
    planes, label = planes_of(fps), np.arange(n)
    last = np.searchsorted(keys, keys, "right") - 1  # of the block of each row
    rows = np.arange(n)
    rows = rows[last > rows]
    count = last[rows] // 64 - rows // 64 + 1
    ends = np.cumsum(count)
    start = 0
    while start < len(rows):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + AT_ONCE, "right")))
        some, times = rows[start:stop], count[start:stop]
        row = np.repeat(some, times)
        word = row // 64 + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        row, word, near = close_lanes(planes, fps, row, word)
        lanes = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at, lane = np.nonzero(lanes)
        a, b = row[at], 64 * word[at] + lane
        ahead = (b > a) & (b < n)
        _joined(label, a[ahead], b[ahead])
        start = stop
    moved = np.flatnonzero(label != np.arange(n))
    return fps[moved], fps[label[moved]]


def _table_links(entries: DataFrame, masks: list[int]) -> DataFrame:
    """(a, b): links of the blocks of (tab, fp), compared block by block in sorted partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def compare(whole: pa.Table, final: bool) -> tuple[pa.RecordBatch, pa.Table]:
            tab, fps = whole.column("tab").to_numpy(), whole.column("fp").to_numpy().view(np.uint64)
            keys = fps & np.array(masks, np.uint64)[tab]
            begins = np.flatnonzero(np.r_[True, (tab[1:] != tab[:-1]) | (keys[1:] != keys[:-1])])
            stop = len(fps) if final else int(begins[-1])  # the last block may go on
            block = np.zeros(len(fps), np.int64)
            block[begins[1:]] = 1
            a, b = block_links(np.cumsum(block)[:stop], fps[:stop])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"]), whole.slice(stop)

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 4 * MOST:
                links, rest = compare(pa.Table.from_batches(held), False)
                yield links
                held, size = rest.to_batches(), rest.num_rows
        if size:
            yield compare(pa.Table.from_batches(held), True)[0]

    return entries.mapInArrow(run, "a long, b long")


def _key(masks: list[int]) -> Column:
    """The bits of a row's table: its key."""
    return F.col("fp").bitwiseAND(F.element_at(F.array(*[F.lit(signed(m)) for m in masks]), F.col("tab") + 1))


def fingerprint_links(scratch: Scratch, fps: DataFrame, most: int = MOST) -> DataFrame:
    """(a, b): links that join the distinct ``fp`` within RADIUS bits, some of them repeated."""
    masks = band_masks()
    tables = F.explode(F.array(*[F.lit(i) for i in range(len(masks))])).alias("tab")
    entries = fps.select(tables, "fp").withColumn("key", _key(masks))
    sizes = entries.groupBy("tab", "key").agg(F.count("*").alias("m")).where("m > 1")
    crowded = scratch.keep(sizes.where(F.col("m") > most).select("tab", "key"), "crowded")
    fitting = entries
    links = None
    if crowded.limit(1).count():
        inside = entries.join(crowded, ["tab", "key"], "left_semi").select("fp").distinct()
        fitting = entries.join(crowded, ["tab", "key"], "left_anti")
        flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(signed(1 << b))) for b in range(BITS)]
        cells = inside.select("fp", F.explode(F.array(*flips)).alias("cell"))
        least = scratch.keep(cells.groupBy("cell").agg(F.min("fp").alias("b"), F.count("*").alias("m")).where("m > 1").select("cell", "b"), "cells")
        links = scratch.keep(cells.join(least, "cell").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct(), "links")
    dealt = fitting.repartition("tab", "key").sortWithinPartitions("tab", "key", "fp").select("tab", "fp")
    found = scratch.keep(_table_links(dealt, masks), "links")
    return found if links is None else found.union(links)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, most: int = MOST) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    Rows are linked when their fingerprints differ in at most RADIUS bits; ``component_id`` is the
    least id that links reach, the own one included. ``most`` chooses a way, not a result.

    * A null text counts as empty. A text without words has fingerprint 0 and is linked like any
      other; one of fewer than ``words`` words is a single shingle.
    * A bit that exactly half the shingles have is 0.
    * A null id has a fingerprint, component null, and takes no part in links. Rows that repeat an
      id share a component, whatever their texts.
    * Very long texts are hashed whole. Other columns, whatever their names, are not looked at.
      An empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(docs, id_col, text_col, words), "rows")
    has = rows.where("doc_id is not null")
    classes = scratch.keep(has.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    links = fingerprint_links(scratch, classes.select("fp"), most)
    # Rows of one id with different texts belong together.
    several = has.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id", F.col("lo").alias("b"))
    ties = rows.join(several, "doc_id").select(F.col("fp").alias("a"), "b").where("a <> b")
    joined = scratch.keep(components(links.union(ties), scratch), "components")
    least = joined.join(classes, joined["id"] == classes["fp"]).groupBy("component").agg(F.min("rep").alias("least"))
    moved = joined.join(least, "component").select(F.col("id").alias("fp"), "least")
    of_class = scratch.keep(classes.join(moved, "fp", "left").select("fp", F.coalesce("least", "rep").alias("least")), "of-class")
    scratch.drop("classes", "crowded", "cells", "links", "cc", "cc-large", "cc-small", "components")
    out = rows.join(of_class, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("least")).alias("component_id"))
