"""Functional dependencies and candidate keys."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a task of dependency discovery, about.
TASK_ROWS = 250_000
#: A value in more rows than these is frequent: no task takes them all.
FREQUENT = 250_000
#: Left sides that are looked at together.
SETS = 200


def itemset_support(df: DataFrame, sets: list[tuple[str, ...]]) -> DataFrame:
    """(columns, n, n_distinct, support): distinct combinations by rows; a grouping a set, so that tasks
    hand on each combination once and no row is copied for a set.

    Rows with a NULL in a set do not count for it.
    """
    n = df.agg(F.count("*").alias("n"))
    each = [df.na.drop(subset=list(s)).groupBy(*s).agg(F.lit(1).alias("_g")).agg(F.lit(",".join(s)).alias("columns"), F.count("*").alias("n_distinct")) for s in sets]
    out = reduce(DataFrame.union, each).join(F.broadcast(n))  # one row
    return out.select("columns", "n", "n_distinct", F.try_divide(F.col("n_distinct").cast("double"), F.col("n")).alias("support"))


def fd_confidences(df: DataFrame, lhs: list[str], rhs: list[str]) -> DataFrame:
    """(lhs, rhs, n, confidence) for several right sides of one left side, which is grouped once.

    Confidence: share of the rows (without NULLs) whose lhs group has a single rhs value.
    """
    groups = df.na.drop(subset=lhs).groupBy(*lhs).agg(
        *[F.count(F.col(c)).alias(f"n{i}") for i, c in enumerate(rhs)], *[(F.min(c) == F.max(c)).alias(f"one{i}") for i, c in enumerate(rhs)]
    )
    row = groups.agg(
        *[F.coalesce(F.sum(f"n{i}"), F.lit(0)).alias(f"n{i}") for i in range(len(rhs))],
        *[F.coalesce(F.sum(F.when(F.col(f"one{i}"), F.col(f"n{i}"))), F.lit(0)).alias(f"held{i}") for i in range(len(rhs))],
    )
    stacked = ", ".join(f"'{c}', n{i}, held{i}" for i, c in enumerate(rhs))
    out = row.selectExpr(f"stack({len(rhs)}, {stacked}) as (rhs, n, held)")
    return out.select(F.lit(",".join(lhs)).alias("lhs"), "rhs", "n", F.try_divide(F.col("held").cast("double"), F.col("n")).alias("confidence"))


def fd_confidence(df: DataFrame, lhs: list[str], rhs: str) -> DataFrame:
    """One row of ``fd_confidences``."""
    return fd_confidences(df, lhs, [rhs])


def null_patterns(df: DataFrame, columns: list[str]) -> dict[frozenset[str], int]:
    """Numbers of rows by which of the columns are null; patterns are few, however many rows there are."""
    absent = [F.col(f"`{c}`").isNull() for c in columns]
    mask = sum((F.shiftleft(a.cast("long"), i) for i, a in enumerate(absent)), F.lit(0).cast("long"))
    rows = df.groupBy(mask.alias("m")).agg(F.count("*").alias("n")).collect()
    return {frozenset(c for i, c in enumerate(columns) if r["m"] >> i & 1): r["n"] for r in rows}


def _level(sources: dict[tuple[str, ...], DataFrame], asked: dict[tuple[str, ...], list[str]], often: bool = False) -> dict[tuple[str, ...], dict]:
    """Per left side of ``asked``, over the rows of its source: groups, rows, and per right side rows
    with a value (``n``) and those of groups with one value (``held``).

    One grouping a left side, all in one job; a row a left side comes back. If combinations come
    ``often``, texts are grouped by first, as the least and greatest text of a group would have all
    rows sorted.
    """
    parts = []
    for lhs, rhs in asked.items():
        rows = sources[lhs].na.drop(subset=list(lhs))
        at = {c: i for i, c in enumerate(rhs)}
        texts = [c for c in rhs if often and isinstance(rows.schema[c].dataType, (T.StringType, T.BinaryType))]
        first = [x for c in rhs if c not in texts for x in (F.count(F.col(f"`{c}`")).alias(f"n{at[c]}"), F.min(f"`{c}`").alias(f"lo{at[c]}"), F.max(f"`{c}`").alias(f"hi{at[c]}"))]
        pre = rows.groupBy(*lhs, *texts).agg(F.count("*").alias("_c"), *first)
        pre = pre.withColumns({f"n{at[c]}": F.when(F.col(f"`{c}`").isNotNull(), F.col("_c")).otherwise(0) for c in texts})
        ends = {c: (F.col(f"`{c}`"), F.col(f"`{c}`")) if c in texts else (F.col(f"lo{at[c]}"), F.col(f"hi{at[c]}")) for c in rhs}
        groups = pre.groupBy(*lhs).agg(F.sum("_c").alias("_c"), *[x for c in rhs for x in (F.sum(f"n{at[c]}").alias(f"n{at[c]}"), (F.min(ends[c][0]) == F.max(ends[c][1])).alias(f"one{at[c]}"))])
        zero = F.lit(0).cast("long")
        per_rhs = [F.coalesce(F.sum(f"n{i}"), zero) for i in range(len(rhs))], [F.coalesce(F.sum(F.when(F.col(f"one{i}"), F.col(f"n{i}"))), zero) for i in range(len(rhs))]
        parts.append(groups.agg(
            F.lit(",".join(lhs)).alias("lhs"), F.count("*").alias("groups"), F.coalesce(F.sum("_c"), zero).alias("rows"),
            F.array(*per_rhs[0]).cast("array<bigint>").alias("n"), F.array(*per_rhs[1]).cast("array<bigint>").alias("held"),
        ))
    found = reduce(DataFrame.union, parts).collect() if parts else []
    return {tuple(r["lhs"].split(",")): r.asDict() for r in found}


def _together(df: DataFrame, columns: list[str], asked: dict[tuple[str, ...], list[str]], pays: float) -> dict[tuple[str, ...], dict]:
    """The figures of ``_level``, of left sides of any size, by one shuffle of the rows for each column that leads some.

    A left side is led by its column with the most values. Rows are dealt by that column's value, so
    all groups of all left sides that it leads are whole in one task. Rows whose value is frequent
    would make a task too large: groupings take these, whose tasks hand on each combination once.
    """
    counts = [
        df.groupBy(F.col(f"`{c}`").alias("v")).agg(F.count("*").alias("n")).where("v is not null").agg(
            F.lit(i).alias("i"), F.count("*").alias("d"), F.coalesce(F.sum(F.when(F.col("n") <= FREQUENT, F.col("n"))), F.lit(0)).alias("light"),
            F.to_json(F.collect_list(F.when(F.col("n") > FREQUENT, F.xxhash64("v")))).alias("often"),
        )
        for i, c in enumerate(columns)
    ]
    seen = {columns[r["i"]]: r for r in reduce(DataFrame.union, counts).collect()}
    often = {c: json.loads(r["often"]) for c, r in seen.items()}
    led: dict[str, dict[tuple[str, ...], list[str]]] = {}
    for lhs, rhs in asked.items():
        led.setdefault(max(lhs, key=lambda c: seen[c]["d"]), {})[lhs] = rhs
    out = {s: {"groups": 0, "rows": 0, "n": [0] * len(rhs), "held": [0] * len(rhs)} for s, rhs in asked.items()}
    numbers, parts, heavy = {s: i for i, s in enumerate(asked)}, [], {}
    for leader, sets in led.items():
        # By hash: what shares one with a frequent value goes the same way, so groups stay whole.
        frequent = F.xxhash64(f"`{leader}`").isin(often[leader]) if often[leader] else F.lit(False)
        rows = df.where(F.col(f"`{leader}`").isNotNull())
        if often[leader]:
            heavy |= {s: rows.where(frequent) for s in sets}
        if seen[leader]["light"]:
            tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-seen[leader]["light"] // TASK_ROWS))
            dealt = rows.where(~frequent).select(*columns).repartition(tasks, F.xxhash64(f"`{leader}`"))
            parts.append(dealt.mapInArrow(_in_task(columns, sets, [numbers[s] for s in sets], pays), "at int, rhs int, a long, b long"))
    if parts:
        for r in reduce(DataFrame.union, parts).groupBy("at", "rhs").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect():
            figures = out[list(asked)[r["at"]]]
            if r["rhs"] < 0:
                figures["groups"], figures["rows"] = r["a"], r["b"]
            else:
                figures["n"][r["rhs"]], figures["held"][r["rhs"]] = r["a"], r["b"]
    for s, r in _level(heavy, {s: asked[s] for s in heavy}, often=True).items():
        for k in ("groups", "rows"):
            out[s][k] += r[k]
        for k in ("n", "held"):
            out[s][k] = [x + y for x, y in zip(out[s][k], r[k], strict=True)]
    return out


def _in_task(columns: list[str], sets: dict[tuple[str, ...], list[str]], numbers: list[int], pays: float):
    """The task of ``_together``. It is whole in itself, so workers need no file of this library."""

    def group_figures(codes: dict[str, np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(left side, right side, n, held) of all left sides over rows whose groups are whole here; right side -1: (groups, rows).

        ``codes``: numbers of values, -1 for null. A left side is grouped over the stripped partition of a
        smaller one: rows alone in their group are alone in every finer one.
        """
        length = len(next(iter(codes.values())))
        sizes = {c: int(v.max(initial=-1)) + 2 for c, v in codes.items()}
        kept: dict[tuple[str, ...], np.ndarray] = {}
        for at, (lhs, rhs) in sorted(enumerate(sets.items()), key=lambda x: len(x[1][0])):
            rows = min((kept[t] for t in combinations(lhs, len(lhs) - 1) if t in kept), key=len, default=np.arange(length, dtype=np.int32))
            parent = len(rows)
            for c in lhs:
                rows = rows[codes[c][rows] >= 0]
            key, span = codes[lhs[0]][rows], sizes[lhs[0]]
            for c in lhs[1:]:
                if span * sizes[c] >= 2**62:
                    values, key = np.unique(key, return_inverse=True)
                    span = len(values) + 1
                key, span = key * sizes[c] + codes[c][rows], span * sizes[c]
            order = np.argsort(key, kind="stable")
            key = key[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            counts = np.diff(np.r_[starts, len(key)])
            yield at, -1, len(starts), len(rows)
            shared = rows[order[np.repeat(counts > 1, counts)]]
            counts = counts[counts > 1]
            starts = np.r_[0, np.cumsum(counts)[:-1]].astype(np.int64)
            for i, c in enumerate(rhs):
                n, value = int((codes[c][rows] >= 0).sum()), codes[c][shared]
                held = n - int((value >= 0).sum())  # rows alone in their group
                if len(shared):
                    there = value >= 0
                    one = np.minimum.reduceat(np.where(there, value, sizes[c]), starts) == np.maximum.reduceat(value, starts)
                    held += int(np.add.reduceat(there.astype(np.int64), starts)[one].sum())
                yield at, i, n, held
            if len(shared) <= pays * parent:
                kept[lhs] = shared
            else:
                kept[lhs] = min((kept[t] for t in combinations(lhs, len(lhs) - 1) if t in kept), key=len, default=np.arange(length, dtype=np.int32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        coded = (rows.column(i).combine_chunks().dictionary_encode() for i in range(len(columns)))
        codes = {c: x.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c, x in zip(columns, coded, strict=True)}
        found = [(numbers[at], *rest) for at, *rest in group_figures(codes)]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["at", "rhs", "a", "b"])

    return run


def _plain_values(df: DataFrame, columns: list[str]) -> DataFrame | None:
    """The columns with one zero and one NaN each, if all have types that Arrow numbers by value."""
    kinds = {c: df.schema[c].dataType for c in columns}
    if not all(isinstance(k, (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)) for k in kinds.values()):
        return None
    one = lambda c: F.when(F.col(f"`{c}`") == 0, F.lit(0.0)).when(F.isnan(f"`{c}`"), F.lit(float("nan"))).otherwise(F.col(f"`{c}`")).cast(kinds[c]).alias(c)
    return df.select(*[one(c) if isinstance(kinds[c], T.FractionalType) and not isinstance(kinds[c], T.DecimalType) else F.col(f"`{c}`") for c in columns])


def discover_fds(df: DataFrame, columns: list[str], size: int = 3, support: float = 0.0, confidence: float = 0.95, pays: float = 0.5) -> DataFrame:
    """(lhs, rhs, n, confidence): dependencies whose lhs, of up to ``size`` columns, reaches ``support``.

    ``n``: rows with values in all columns; confidence: the share of these whose lhs group has one rhs
    value; support: distinct lhs combinations by all rows. An lhs that has a dependency is not
    extended for the same rhs. Left sides of one column are grouped. Those of more come with the
    smaller ones in one pass for each column that leads some (``_together``), where tasks work over
    stripped partitions: rows that are alone in their group are left out of the finer ones, if at
    most the share ``pays`` is left; more than ``SETS`` left sides go by levels, whose findings
    spare later ones.
    """
    nulls = null_patterns(df, columns)
    valued = lambda s: sum(n for absent, n in nulls.items() if not absent & set(s))
    total, base = sum(nulls.values()), df.select(*columns)
    plain = _plain_values(df, columns) if size > 1 else None
    found, parts = set(), []
    levels = [(k,) for k in range(1, size + 1)]
    if sum(len(list(combinations(columns, k))) for k in range(1, size + 1)) <= SETS:
        levels = [tuple(range(1, size + 1))]
    for ks in levels:
        open_ = lambda s: [c for c in columns if c not in s and not any((t, c) in found for j in range(1, len(s)) for t in combinations(s, j))]
        asked = {s: rhs for k in ks for s in combinations(columns, k) if (rhs := open_(s))}
        if not total or not asked:
            continue
        figures = _together(plain, columns, asked, pays) if plain is not None else _level(dict.fromkeys(asked, base), asked)
        for s, rhs in asked.items():
            r, still = figures[s], set(open_(s))
            if (r["groups"] + valued(s) - r["rows"]) / total < support:
                continue
            for c, n_in, held in zip(rhs, r["n"], r["held"], strict=True):
                n = valued((*s, c))
                share = (held + n - n_in) / n if n else None
                if c in still and share is not None and share >= confidence:
                    found.add((s, c))
                    parts.append((",".join(s), c, n, share))
    return df.sparkSession.createDataFrame(parts, "lhs string, rhs string, n long, confidence double")


def closure(start: set[str], fds: list[tuple[set[str], set[str]]]) -> set[str]:
    """All columns that ``start`` determines."""
    out, grew = set(start), True
    while grew:
        new = set().union(*[r for lhs, r in fds if lhs <= out]) - out
        grew = bool(new)
        out |= new
    return out


def candidate_keys(columns: list[str], fds: list[tuple[set[str], set[str]]], unique: list[str] = (), size: int = 3) -> list[tuple[str, ...]]:
    """Minimal sets of up to ``size`` columns that determine all, unique columns first."""
    keys: list[set[str]] = [{u} for u in unique]
    for k in range(1, size + 1):
        for s in combinations(columns, k):
            if not any(key <= set(s) for key in keys) and closure(set(s), fds) >= set(columns):
                keys.append(set(s))
    return sorted((tuple(sorted(k)) for k in keys), key=lambda k: (len(k), k))


def split_key_fds(fds: list[tuple[set[str], set[str]]], keys: list[tuple[str, ...]]):
    """(dependencies of keys, others): others have an lhs that neither holds nor is part of a key."""
    of_keys = [f for f in fds if any(set(k) <= f[0] for k in keys)]
    others = [f for f in fds if not any(set(k) <= f[0] or f[0] <= set(k) for k in keys)]
    return of_keys, others


def unique_columns(df: DataFrame) -> DataFrame:
    """(column, n, n_distinct, is_unique) of all columns."""
    row = df.agg(F.count("*").alias("n"), *[F.count_distinct(F.col(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(df.columns)])
    stacked = ", ".join(f"'{c}', d{i}" for i, c in enumerate(df.columns))
    out = row.selectExpr("n", f"stack({len(df.columns)}, {stacked}) as (column, n_distinct)")
    return out.select("column", "n", "n_distinct", (F.col("n") == F.col("n_distinct")).alias("is_unique"))
