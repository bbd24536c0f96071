"""Exact Jaccard self-join in a metric space: pivots, Voronoi regions, windows, recursion.

Jaccard distance is a metric: with r the greatest distance of a link, a document x whose
nearest pivot is p can only be linked to documents y with d(y, p) <= d(y, nearest of y) + 2r.
So regions about pivots can be joined on their own once such boundary documents are copied
into them. What texts are like shapes the operator.

1. Documents with equal sets are one class, joined by the row of least id.
2. Unrelated texts have distance 1, so no document is a useful first pivot for them; single
   shingles are. A set without links has many shingles of its own: ``crowded_sets`` finds the
   others, and looks only as far into the sets as that takes.
3. ``clusters``: these lie in the cells of their rarest shingles, and cells that share a set
   are one region. Linked sets meet in a cell, so links stay inside regions.
4. ``region_links``: small regions are joined in one task each. In a larger one a few documents
   become pivots, which all others are measured against; these go to the Voronoi region of their
   nearest pivot and, within the window, to neighbours; documents far from all pivots share one
   far region. So it goes on until all regions are small. Documents linked to one pivot have one
   label, documents of one label are not compared, and a region of one label is done.
   Where windows copy so much that the regions' squares do not halve (edits of one text scatter
   like that), the region is cut into blocks, and each pair of blocks is joined in a task.

A task hands on as few links as it takes to join its documents, so near copies never become all
their pairs. Sets are copied only from step 4 on, for the few documents that come so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.llm.shared import SPACE, Scratch

_M = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xB4E35F8D2C6A9713)
_SPACE = np.isin(np.arange(256), list(SPACE.encode()))
#: Bytes of text hashed at once.
SLICE_BYTES = 1 << 20
#: Up to so many rows (some 20 MB), those whose texts are to be read again are broadcast.
SENT_ROWS = 300_000
#: Share by which sets look further at first than they need to without anything shared.
SLACK = 0.1
#: Factor on the guess of how far to look next.
AHEAD = 1.15
#: Documents and shingles of a region that one task joins, and distances it keeps per document.
TASK_DOCS, TASK_HASHES, MOST_PIVOTS = 512, 1 << 20, 8


def _byte_values() -> np.ndarray:
    """A fixed 64-bit value per byte; A-Z have those of a-z, white space has 0."""
    x = np.arange(1, 257, dtype=np.uint64) * _M
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    x[ord("A") : ord("Z") + 1] = x[ord("a") : ord("z") + 1]
    x[_SPACE] = 0
    return x


class Shingler:
    """63-bit hashes of texts' distinct shingles, sorted: a polynomial hash of each word's bytes,
    from one prefix sum over all texts of a slice, and a mix of the hashes of ``words`` words."""

    def __init__(self, words: int) -> None:
        self.words, self.value = words, _byte_values()
        self.power = self.inverse = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, SLICE_BYTES + 1)
            inverse = np.uint64(pow(int(_BASE), -1, 2**64))
            for name, base in (("power", _BASE), ("inverse", inverse)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, texts: pa.StringArray) -> list[np.ndarray]:
        ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        out, i = [], 0
        while i < len(texts):
            j = i + 1
            while j < len(texts) and ends[j + 1] - ends[i] <= SLICE_BYTES:
                j += 1
            out += self._slice(data[ends[i] : ends[j]], ends[i : j + 1] - ends[i])
            i = j
        return out

    def _slice(self, data: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        none = np.empty(0, np.int64)
        if not len(data):
            return [none] * (len(ends) - 1)
        self._powers(len(data))
        word = ~_SPACE[data]
        edge = np.zeros(len(data) + 1, bool)  # a text begins here
        edge[ends] = True
        begins = np.flatnonzero(word & (edge[:-1] | ~np.r_[False, word[:-1]]))
        stops = np.flatnonzero(word & (edge[1:] | ~np.r_[word[1:], False])) + 1
        if not len(begins):
            return [none] * (len(ends) - 1)
        upto = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.value[data] * self.power[: len(data)], out=upto[1:])
        h = (upto[stops] - upto[begins]) * self.inverse[begins]
        h = (h ^ (h >> np.uint64(32))) * _M
        h ^= h >> np.uint64(29)
        at = np.searchsorted(begins, ends)  # first word of each text
        k = self.words
        mixed = self._mix([h[d : len(h) - k + 1 + d] for d in range(k)], 0) if len(h) >= k else h[:0]
        out = []
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(mixed[a : b - k + 1]))
            elif b > a:
                out.append(self._mix([h[d : d + 1] for d in range(a, b)], b - a))
            else:
                out.append(none)
        return out

    @staticmethod
    def _mix(columns: list[np.ndarray], seed: int) -> np.ndarray:
        out = np.full(len(columns[0]), seed, np.uint64)
        for c in columns:
            out = (out ^ c) * _M
            out ^= out >> np.uint64(29)
        return (out >> np.uint64(1)).view(np.int64)


def _over(total: int, percent: int) -> int:
    """How many shingles of a set of ``total`` no linked set can lack: total - ceil(limit * total) + 1."""
    return total - -(-percent * total // 100) + 1 if total else 0


def _over_column(n: Column, percent: int) -> Column:
    return n - F.ceil(n * percent / F.lit(100.0) - 1e-9) + 1


def _map_texts(docs: DataFrame, words: int, schema: str, make) -> DataFrame:
    """``make(batch columns before the text, sets)`` over Arrow batches of ``docs``, text last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                yield make(part, shingles(part.column(part.num_columns - 1)))

    return docs.mapInArrow(run, schema)


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    at = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=at[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(flat))


def _signature(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, component): the least id that the links (a, b) reach, for every id in a link.

    Alternates large-star and small-star steps (Kiveris et al., 2014) on written tables.
    """
    scratch = scratch or Scratch(links.sparkSession, "components")
    edges = scratch.keep(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large, "cc-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.keep(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "cc-small")
        # Stars at last: no node has two edges, and no centre has one upward.
        ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)).distinct())
        if not ends.groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").limit(1).count():
            break
    stars = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("id"), "component").distinct())


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc, n, sig, heads): id, set size, 128-bit signature (null for an empty set) and the least
    hashes, SLACK more than no linked set can lack."""

    def make(part, sets):
        sig = [_signature(s) if len(s) else None for s in sets]
        heads = _lists([s[: math.ceil((1 + SLACK) * _over(len(s), percent))] for s in sets])
        columns = [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary()), heads]
        return pa.RecordBatch.from_arrays(columns, names=["doc", "n", "sig", "heads"])

    return _map_texts(_texts(docs, id_col, text_col), words, "doc long, n long, sig binary, heads array<long>", make)


def _whole_sets(scratch: Scratch, texts: DataFrame, asked: DataFrame, words: int) -> DataFrame:
    """(cid, upto, reach, set): the sets of the asked (cid, doc, sig, upto, reach), made again from the texts.

    The asked rows are broadcast while they are few; beyond, texts and rows meet in a shuffle.
    The sets are bucketed by cid, so they are not moved again to meet later rows.
    """
    asked = asked.select("doc", "sig", "cid", "upto", "reach")
    asked = F.broadcast(asked) if asked.count() <= SENT_ROWS else asked

    def make(part, sets):
        same = pa.array([_signature(s) == sig if len(s) else False for s, sig in zip(sets, part.column(1).to_pylist(), strict=True)], pa.bool_())
        return pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), _lists(sets)], names=["cid", "upto", "reach", "set"]).filter(same)

    met = texts.join(asked, "doc").select("cid", "sig", "upto", "reach", "text")
    return scratch.keep_dealt(_map_texts(met, words, "cid long, upto long, reach long, set array<long>", make).repartition("cid"), "whole", "cid")


def _counted(cells: DataFrame) -> DataFrame:
    """(cell, n, lo): how many hold a cell, and the least of them."""
    return cells.groupBy("cell").agg(F.count("*").alias("n"), F.min("cid").alias("lo"))


def _shared_in(cells: DataFrame, hot: DataFrame) -> DataFrame:
    """(cid, more): how many of its cells are hot."""
    return cells.join(hot.select("cell"), "cell", "left_semi").groupBy("cid").agg(F.count("*").alias("more"))


def crowded_sets(scratch: Scratch, reps: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(cid, n, set): the sets that may have links.

    A set looks at its shingles in the order of their hashes until it has found so many that no
    other set has looked at, that every linked set would have to hold one of them, and to have
    looked at it. Then it has no links. A set that finds fewer among all its shingles stays.
    What one set looks at may be what another one thought its own, so this goes on, round by
    round, until every set has enough of its own or has looked at all it has. The counts of every
    round are bucketed by shingle, so a later round, which looks at little, moves only that.
    """
    k = _over_column(F.col("n"), percent).cast("long")
    cells = reps.select("cid", F.explode("heads").alias("cell"))
    layers = [scratch.keep_dealt(_counted(cells), "layer", "cell")]
    more = _shared_in(cells, layers[0].where("n > 1"))
    state = reps.select("cid", "doc", "sig", "n", F.size("heads").cast("long").alias("upto"))
    state = scratch.keep(state.join(more, "cid", "left").select("cid", "doc", "sig", "n", "upto", F.coalesce("more", F.lit(0)).alias("shared")), "state")
    whole, made = [], None
    while True:
        own = F.col("upto") - F.col("shared")
        lacking = state.where((own < k) & (F.col("upto") < F.col("n")))
        # At first as far as the share found till now makes likely to be enough; after that, to the end.
        guess = F.ceil(AHEAD * k * F.col("upto") / F.greatest(own, F.lit(1)))
        reach = F.col("n") if made is not None else F.least(F.col("n"), F.greatest(guess, 2 * F.col("upto")))
        asked = scratch.keep(lacking.withColumn("reach", reach.cast("long")), "asked")
        if not asked.limit(1).count():
            break
        new = asked if made is None else scratch.keep(asked.join(made, "cid", "left_anti"), "asked")
        fresh = _whole_sets(scratch, texts, new, words)
        part = F.explode(F.slice("set", (F.col("upto") + 1).cast("int"), (F.col("reach") - F.col("upto")).cast("int"))).alias("cell")
        ranges = asked.select("cid", "upto", "reach")
        cells = [w.select("cid", "set").join(ranges, "cid").select("cid", part) for w in whole]
        cells = scratch.keep(reduce(DataFrame.union, [*cells, fresh.select("cid", part)]), "cells")
        whole.append(fresh)
        made = fresh.select("cid") if made is None else made.union(fresh.select("cid"))
        layer = scratch.keep_dealt(_counted(cells), "layer", "cell")
        mine = layer.select("cell", F.col("n").alias("n_here"))
        before = [old.join(mine.select("cell"), "cell") for old in layers]
        before = reduce(DataFrame.union, before).groupBy("cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"))
        hot = mine.join(before, "cell", "left").where("n_here + coalesce(n, 0) > 1").select("cell", "n", "lo")
        hot = scratch.keep(hot, "hot")
        layers.append(layer)
        # The new cells that are shared, and the older ones that one set alone held until now.
        more = _shared_in(cells, hot).union(hot.where("n = 1").groupBy(F.col("lo").alias("cid")).agg(F.count("*").alias("more")))
        more = more.groupBy("cid").agg(F.sum("more").alias("more"))
        state = state.join(asked.select("cid", "reach"), "cid", "left").join(more, "cid", "left")
        state = state.select("cid", "doc", "sig", "n", F.coalesce("reach", "upto").alias("upto"), (F.col("shared") + F.coalesce("more", F.lit(0))).alias("shared"))
        state = scratch.keep(state, "state")
    scratch.drop("layer", "cells", "hot")
    full = state.where((F.col("upto") == F.col("n")) & (F.col("upto") - F.col("shared") < k)).select("cid", "n")
    # Sets that are in ``heads`` as a whole are those of a few words.
    whole.append(reps.where(F.size("heads") == F.col("n")).select("cid", F.col("heads").alias("set")).repartition("cid"))
    full = scratch.keep_dealt(reduce(DataFrame.union, [w.select("cid", "set").join(full, "cid").select("cid", "n", "set") for w in whole]), "full", "cid")
    scratch.drop("whole", "state", "asked")
    return full


def clusters(scratch: Scratch, full: DataFrame, percent: int) -> DataFrame:
    """(cid, region): sets that share one of their rarest shingles, directly or through others.

    Each set enters the cells of its first n - ceil(limit * n) + 1 shingles, rarest first; cells
    of one set are left out. Linked sets meet in a cell, so no link joins two regions.
    """
    cells = full.select("cid", F.explode("set").alias("cell"))
    counts = scratch.keep(_counted(cells).where("n > 1").select("cell", F.col("n").alias("df")), "df")
    held = cells.join(counts, "cell").groupBy("cid").agg(F.sort_array(F.collect_list(F.struct("df", "cell"))).alias("held"))
    enters = _over_column(F.col("n"), percent) - (F.col("n") - F.size("held"))
    held = held.join(full.select("cid", "n"), "cid").where(enters > 0)
    members = scratch.keep(held.select("cid", F.explode(F.slice("held", F.lit(1), enters.cast("int"))).alias("s")).select("cid", "s.cell"), "members")
    first = _counted(members).where("n > 1").select("cell", "lo")
    edges = members.join(first, "cell").where("cid <> lo").select(F.col("cid").alias("a"), F.col("lo").alias("b"))
    return components(edges.distinct(), scratch).select(F.col("id").alias("cid"), F.col("component").alias("region"))


def link_region(sets: list[np.ndarray], label: np.ndarray, part: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that join what has different labels, as few as there are joins.

    Rows already measured are pivots: another row is measured only against rows whose distances
    to all of them differ by no more than a link's. Rows of one ``part`` above 0 are not compared.
    """
    m, r = len(sets), (100 - percent) / 100 + 1e-9
    n = np.array([len(s) for s in sets], np.int64)
    starts = np.r_[0, np.cumsum(n)[:-1]]
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    comp = np.unique(label, return_inverse=True)[1].reshape(-1)
    held = np.zeros(int(flat.max()) + 1, bool)
    pivots: list[np.ndarray] = []
    out: list[tuple[int, int]] = []
    for i in range(m - 1):
        near = (comp[i + 1 :] != comp[i]) & (100 * np.minimum(n[i + 1 :], n[i]) >= percent * np.maximum(n[i + 1 :], n[i]))
        if part[i]:
            near &= part[i + 1 :] != part[i]
        near = np.flatnonzero(near) + i + 1
        for d in pivots:
            near = near[np.abs(d[near] - d[i]) <= r]
        if not len(near):
            continue
        mine = flat[starts[i] : starts[i] + n[i]]
        held[mine] = True
        if len(pivots) < MOST_PIVOTS or 2 * len(near) > m:
            common = np.add.reduceat(held[flat], starts, dtype=np.int64)
            if len(pivots) < MOST_PIVOTS:
                pivots.append(1 - common / (n + n[i] - common))
            common = common[near]
        else:
            common = np.array([np.count_nonzero(held[flat[starts[j] : starts[j] + n[j]]]) for j in near.tolist()], np.int64)
        held[mine] = False
        for j in near[100 * common >= percent * (n[near] + n[i] - common)].tolist():
            if comp[i] != comp[j]:
                comp[comp == comp[j]] = comp[i]
                out.append((i, j))
    return out


def _region_links(regions: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of regions (region, cid, label, part, set), each joined in one task."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("cid")
        lists = table.column("set").combine_chunks()
        flat, at = lists.flatten().to_numpy(), lists.offsets.to_numpy()
        at = at - at[0]
        cid = table.column("cid").to_numpy()
        sets = [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        found = link_region(sets, table.column("label").to_numpy(), table.column("part").to_numpy(), percent)
        i, j = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": cid[i], "b": cid[j]})

    return regions.select("region", "cid", "label", "part", "set").groupBy("region").applyInArrow(run, "a long, b long")


def _pivot_level(scratch: Scratch, big: DataFrame, level: int, percent: int, pivots: int, docs: int, hashes: int):
    """One level of the recursion over regions too large for a task: (links, blocks, regions).

    ``blocks`` are pairs of blocks of the regions that Voronoi regions would not make smaller.
    """
    r = (100 - percent) / 100 + 1e-9
    slot = F.pmod(F.xxhash64(F.lit(level), "cid"), F.lit(pivots))
    chosen = big.groupBy("region", slot.alias("slot")).agg(F.min(F.struct("cid", "n", "set")).alias("s"))
    chosen = scratch.keep(chosen.select("region", F.col("s.cid").alias("p"), F.col("s.n").alias("pn"), F.col("s.set").alias("pset")), "pivots")
    both = big.join(chosen, "region").where("cid <> p").withColumn("common", F.size(F.array_intersect("set", "pset")).cast("long"))
    union = F.col("n") + F.col("pn") - F.col("common")
    met = both.select("region", "cid", "label", "p", (1 - F.col("common") / union).alias("d"), (100 * F.col("common") >= percent * union).alias("linked"))
    met = scratch.keep(met, "met")
    links = met.where("linked").select(F.col("cid").alias("a"), F.col("p").alias("b"))

    per = met.groupBy("region", "cid", "label").agg(
        F.min("d").alias("near"), F.min(F.when(F.col("linked"), F.col("p"))).alias("linked"), F.collect_list(F.struct("p", "d")).alias("to")
    )
    # A pivot has met all others. What is linked to one has its label from now on.
    rest = per.join(chosen.select("region", F.col("p").alias("cid")), ["region", "cid"], "left_anti")
    rest = scratch.keep(rest.select("region", "cid", F.coalesce("linked", "label").alias("label"), "near", "to"), "rest")
    far = rest.where(F.col("near") >= 2 * r).select("region", "cid", "label", F.xxhash64("region", F.lit("far")).alias("child"), F.lit(True).alias("home"))
    window = F.filter("to", lambda t: (t["d"] <= F.col("near") + 2 * r) & (t["d"] < 3 * r))
    close = rest.select("region", "cid", "label", "near", F.explode(window).alias("t"))
    close = close.select("region", "cid", "label", F.xxhash64("region", "t.p").alias("child"), (F.col("near") < 2 * r).alias("home"))
    children = scratch.keep(far.union(close), "children")

    sizes = children.groupBy("region", "child").agg(F.count("*").alias("m"), F.max("home").alias("home")).where("home")
    sizes = scratch.keep(sizes, "child-sizes")
    split = sizes.groupBy("region").agg(F.sum(F.col("m") * F.col("m")).alias("after"))
    parents = big.groupBy("region").agg(F.count("*").alias("m"), F.sum("n").alias("h")).join(split, "region", "left")
    parents = parents.withColumn("pays", F.coalesce(2 * F.col("after") <= F.col("m") * F.col("m"), F.lit(True)))
    parents = scratch.keep(parents, "parents")
    sets = big.select("region", "cid", "n", "set")
    kids = children.join(sizes.select("region", "child"), ["region", "child"]).join(parents.where("pays").select("region"), "region")
    kids = kids.join(sets, ["region", "cid"]).select(F.col("child").alias("region"), "cid", "label", F.lit(0).alias("part"), "n", "set")
    kids = scratch.keep(kids, "regions")

    count = F.ceil(F.greatest(2 * F.col("m") / docs, 2 * F.col("h") / hashes)).cast("long")
    stuck = rest.select("region", "cid", "label").join(parents.where("not pays").select("region", count.alias("count")), "region")
    stuck = stuck.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("count"))).join(sets, ["region", "cid"])
    stuck = stuck.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("other"))
    pair = F.xxhash64("region", F.least("block", "other"), F.greatest("block", "other"))
    part = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    return links, stuck.select(pair.alias("region"), "cid", "label", part.alias("part"), "n", "set"), kids


def region_links(scratch: Scratch, regions: DataFrame, percent: int, docs: int, hashes: int, pivots: int) -> DataFrame:
    """(a, b): links that join what regions (region, cid, label, part, n, set) hold, by recursion."""
    found, level = [], 1
    while True:
        sizes = regions.groupBy("region").agg(F.count("*").alias("m"), F.sum("n").alias("h"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        sizes = scratch.keep(sizes.where("lo < hi").select("region", "m", "h"), "sizes")
        fits = (F.col("m") <= 2) | ((F.col("m") <= docs) & (F.col("h") <= hashes))
        small = regions.join(sizes.where(fits).select("region"), "region")
        found.append(scratch.keep(_region_links(small, percent), "links"))
        if not sizes.where(~fits).limit(1).count():
            return reduce(DataFrame.union, found)
        big = scratch.keep(regions.join(sizes.where(~fits).select("region"), "region"), "big")
        links, blocks, regions = _pivot_level(scratch, big, level, percent, pivots, docs, hashes)
        found += [scratch.keep(links, "links"), scratch.keep(_region_links(blocks, percent), "links")]
        level += 1


def jaccard_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 80,
    task_docs: int = TASK_DOCS,
    task_hashes: int = TASK_HASHES,
    pivots: int = 16,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets;
    ``component_id`` is the least id that links reach, the own one included. Regions of at most
    ``task_docs`` documents and ``task_hashes`` shingles (or of two documents) are joined in one
    task; larger ones get ``pivots``. Links do not depend on these three.

    * Null or empty texts, and texts without words, have an empty set and no links.
    * Fewer than ``words`` words make one shingle of the whole sequence.
    * A null id has component null and takes no part in links. Rows that repeat an id share a
      component, whatever their texts.
    * Very long texts have long sets and are handled whole. Other columns are not looked at.
    * Sets hold 63-bit hashes of shingles, and sets are equal where their 128-bit signatures are:
      a result is exact but for collisions of these. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    texts = _texts(docs, id_col, text_col)
    sets = shingle_sets(docs, id_col, text_col, words, percent).withColumn("uid", F.monotonically_increasing_id())
    sets = scratch.keep(sets, "sets")
    has = sets.where("n > 0 and doc is not null")
    # Equal sets are one class, held by one row of least id: its uid is the class's cid.
    classes = scratch.keep(has.groupBy("sig").agg(F.min(F.struct("doc", "uid")).alias("s")).select("sig", F.col("s.doc").alias("rep"), F.col("s.uid").alias("cid")), "classes")
    held = F.when(F.col("doc").isNotNull(), F.col("cid")).alias("cid")
    rows = scratch.keep(sets.join(classes.select("sig", "cid"), "sig", "left").select("uid", "doc", "n", held), "rows")
    copies = scratch.keep(rows.where("uid <> cid").select("uid"), "copies")
    reps = scratch.keep(has.join(copies, "uid", "left_anti").select(F.col("uid").alias("cid"), "doc", "sig", "n", "heads"), "reps")
    scratch.drop("sets")

    full = crowded_sets(scratch, reps, texts.where("doc is not null"), words, percent)
    scratch.drop("reps")
    regions = clusters(scratch, full, percent).join(full, "cid")
    regions = scratch.keep(regions.select("region", "cid", F.col("cid").alias("label"), F.lit(0).alias("part"), "n", "set"), "regions")
    scratch.drop("full", "df", "members")
    links = region_links(scratch, regions, percent, task_docs, task_hashes, pivots)

    # Rows of one id with different texts belong together.
    several = rows.groupBy("doc").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.count("*").alias("m")).where("m > 1 and doc is not null")
    several = scratch.keep(several, "several")
    ties = rows.join(several.where("lo < hi").select("doc", "lo"), "doc").where("cid <> lo").select(F.col("cid").alias("a"), F.col("lo").alias("b"))
    comp = scratch.keep(components(links.union(ties), scratch), "components")
    least = comp.join(classes.select(F.col("cid").alias("id"), "rep"), "id").groupBy("component").agg(F.min("rep").alias("least"))
    joined = comp.join(least, "component").select(F.col("id").alias("cid"), "least")
    of_class = classes.select("cid", "rep").join(joined, "cid", "left").select("cid", F.coalesce("least", "rep").alias("least"))
    of_class = scratch.keep(of_class, "of-class")
    of_id = several.join(of_class.select(F.col("cid").alias("lo"), F.col("least").alias("tied")), "lo").select("doc", "tied")
    scratch.drop("regions", "big", "pivots", "met", "rest", "children", "child-sizes", "parents", "sizes", "links", "cc", "cc-large", "cc-small", "components")
    out = rows.join(of_class, "cid", "left").join(of_id, "doc", "left")
    own = F.when(F.col("doc").isNotNull(), F.coalesce("tied", "least", "doc"))
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"))
