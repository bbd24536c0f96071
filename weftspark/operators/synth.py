"""Seeded synthesis: keys, samplers, foreign keys and event effects, all from hashes of row ids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftspark.functions import rng
from weftspark.operators.ordered import numbered

MONTHS = "January February March April May June July August September October November December".split()


def key_range(spark: SparkSession, n: int, name: str = "id") -> DataFrame:
    """A table of keys 1 to n."""
    return spark.range(1, n + 1).withColumnRenamed("id", name)


def walk_step(m: int, seed: int) -> int:
    """The step of a walk that meets each of m places once: coprime to m, near its golden section."""
    return next(a for a in range(max(int(m * 0.6180339887) + seed % 97, 1), 2 * m + 2) if math.gcd(a, m) == 1)


def shuffled_keys(spark: SparkSession, n: int, low: int, high: int, name: str = "id", seed: int = 7) -> DataFrame:
    """n different keys in [low, high]: an affine walk through the range, coprime to its length."""
    m = high - low + 1
    if m < n:
        raise ValueError(f"only {m} keys for {n} rows")
    step = walk_step(m, seed)
    at = F.pmod(F.col("id") * F.lit(step).cast("decimal(38,0)") + F.lit(seed).cast("decimal(38,0)"), F.lit(m).cast("decimal(38,0)"))
    return spark.range(n).select((at + low).cast("long").alias(name))


def poisson_marks(lam: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... as far as doubles tell it from 1."""
    upto, p, k = math.exp(-lam), math.exp(-lam), 0
    marks = []
    while upto < 1 - 1e-15 and k < lam + 40 + 12 * math.sqrt(lam):
        marks.append(upto)
        k += 1
        p *= lam / k
        upto += p
    return marks


def poisson(u: Column, lam: float) -> Column:
    """Inverse CDF, for means of up to 200."""
    if lam > 200:
        raise ValueError("beyond a mean of 200 take the normal approximation")
    return F.size(F.filter(F.array(*map(F.lit, poisson_marks(lam))), lambda x: x <= u)).cast("long")


def zipf_shares(n: int, s: float) -> list[float]:
    weights = [r ** -s for r in range(1, n + 1)]
    total = sum(weights)
    return [w / total for w in weights]


def zipf_rank(u: Column, n: int, s: float) -> Column:
    """Rank 1 to n with p(r) proportional to r^-s, by inverting the continuous bound and one exact step.

    Up to 4096 ranks the CDF is a literal array; beyond, the rank comes from the integral of
    x^-s between r - 1/2 and r + 1/2, which needs no table.
    """
    if n <= 4096:
        marks, upto = [], 0.0
        for p in zipf_shares(n, s)[:-1]:
            upto += p
            marks.append(upto)
        return (F.size(F.filter(F.array(*map(F.lit, marks)), lambda x: x <= u)) + 1).cast("long") if marks else F.lit(1).cast("long")
    low, high = 0.5, n + 0.5
    if abs(s - 1) < 1e-9:
        x = F.exp(F.lit(math.log(low)) + u * math.log(high / low))
    else:
        a, b = low ** (1 - s), high ** (1 - s)
        x = F.pow(F.lit(a) + u * (b - a), F.lit(1 / (1 - s)))
    return F.least(F.greatest(F.round(x), F.lit(1)), F.lit(n)).cast("long")


def seasonal(seed: int, stream: str, key: Column, kind: str, weights: dict, years: tuple[int, int] = (2020, 2023), draw: rng.Draw = rng.uniform01) -> Column:
    """A time by weighted month, ISO-like week (1-53) or hour range ("07:00-09:00", end hour included)."""
    u = lambda part: draw(seed, f"{stream}/{part}", key)
    year = F.lit(years[0]) + F.floor(u("year") * (years[1] - years[0] + 1)).cast("int")
    names, shares = list(weights), [float(v) for v in weights.values()]
    if kind == "month":
        month = rng.pick(u("part"), [MONTHS.index(n) + 1 for n in names], shares)
        first = F.make_date(year, month, F.lit(1))
        return F.date_add(first, F.floor(u("day") * F.dayofmonth(F.last_day(first))).cast("int")).cast("timestamp_ntz")
    if kind == "week":
        week = rng.pick(u("part"), [int(n) for n in names], shares)
        first = F.make_date(year, F.lit(1), F.lit(1))
        monday = F.date_add(first, F.pmod(F.lit(7) - F.weekday(first), F.lit(7)))
        day = F.date_add(monday, (week - 1) * 7 + F.floor(u("day") * 7).cast("int"))
        return F.least(day, F.make_date(year, F.lit(12), F.lit(31))).cast("timestamp_ntz")
    if kind == "hour":
        spans = [tuple(int(p.split(":")[0]) for p in n.split("-")) for n in names]
        at = rng.pick(u("part"), [a for a, _ in spans], shares)
        width = rng.pick(u("part"), [b - a + 1 for a, b in spans], shares)
        hour = at + F.floor(u("hour") * width).cast("int")
        day = F.date_add(F.make_date(year, F.lit(1), F.lit(1)), F.floor(u("day") * 365).cast("int"))
        return F.make_timestamp_ntz(F.year(day), F.month(day), F.dayofmonth(day), hour, F.floor(u("minute") * 60).cast("int"), F.lit(0).cast("decimal(16,6)"))
    raise ValueError(f"seasonal by month, week or hour, not {kind!r}")


def sampler(spec: dict, seed: int, stream: str, key: Column, draw: rng.Draw = rng.uniform01) -> Column:
    """The Column of a distribution spec ({"kind": ..., parameters}) over row key ``key``.

    ``draw`` makes the uniform numbers: ``rng.uniform01``, or ``rng.digest01`` for values that other
    engines can draw too.
    """
    kind, u = spec["kind"], draw(seed, stream, key)
    z = lambda: rng.normal01(seed, stream, key, draw=draw)
    if kind == "uniform":
        return spec.get("low", 0.0) + (spec.get("high", 1.0) - spec.get("low", 0.0)) * u
    if kind == "normal":
        return spec.get("mean", 0.0) + spec.get("std", 1.0) * z()
    if kind == "lognormal":
        return F.exp(spec.get("mean", 0.0) + spec.get("sigma", 1.0) * z())
    if kind == "pareto":
        return spec.get("xm", 1.0) * F.pow(1 - u, F.lit(-1.0 / spec["alpha"]))
    if kind == "exponential":
        return -spec.get("scale", 1.0) * F.log(1 - u)
    if kind == "poisson":
        lam = float(spec["lam"])
        return poisson(u, lam) if lam <= 200 else F.greatest(F.round(lam + math.sqrt(lam) * z()), F.lit(0)).cast("long")
    if kind == "zipf":
        values = spec.get("support")
        rank = zipf_rank(u, len(values) if values else spec["n"], spec.get("s", 1.2))
        return F.element_at(F.array(*map(F.lit, values)), rank.cast("int")) if values else rank
    if kind == "categorical":
        values = [str(v) for v in spec["values"]]
        return rng.pick(u, values, spec.get("probs"))
    if kind == "seasonal":
        return seasonal(seed, stream, key, spec["by"], spec["weights"], tuple(spec.get("years", (2020, 2023))), draw)
    if kind == "mixture":
        from weftspark.operators.predicates import condition

        parts = [sampler(c["dist"], seed, f"{stream}/{i}", key, draw) for i, c in enumerate(spec["components"])]
        shares = [float(c.get("weight", 1.0)) for c in spec["components"]]
        upto, out = 0.0, None
        for part, share in zip(parts[:-1], shares[:-1], strict=True):
            upto += share / sum(shares)
            out = F.when(u < upto, part) if out is None else out.when(u < upto, part)
        out = parts[-1] if out is None else out.otherwise(parts[-1])
        for c, part in reversed(list(zip(spec["components"], parts, strict=True))):
            if c.get("when"):
                out = F.when(condition(c["when"]), part).otherwise(out)
        return out
    raise ValueError(f"no distribution {kind!r}")


def fallback(sql_type: str, name: str, seed: int, key: Column) -> Column:
    """What a column of a type holds where nothing else is said."""
    u = rng.uniform01(seed, name, key)
    match sql_type:
        case "INT":
            return (1 + F.floor(u * 999_999)).cast("long")
        case "FLOAT":
            return rng.normal01(seed, name, key)
        case "BOOL":
            return u < 0.5
        case "DATE" | "DATETIME":
            day = F.date_add(F.lit("2020-01-01").cast("date"), F.floor(u * 1095).cast("int"))
            return day if sql_type == "DATE" else day.cast("timestamp_ntz")
    return F.concat(F.lit(f"{name}_"), key.cast("string"))


def fk_counts(parent: DataFrame, pk: str, n: int, s: float = 1.2, lacking: bool = False) -> DataFrame:
    """(key, children): every key once, and the rest by Zipf shares of the keys' order, largest remainder.

    Fewer rows than keys are an error. If ``lacking`` is set, the rows that are missing are taken off by
    the same shares instead, so that counts always sum to ``n``: a key's may be 0 or less then, which
    says how many rows short it is. The keys are numbered without a global window; the remainders'
    order is a second numbering.
    """
    keys, k = numbered(parent.select(F.col(pk).alias("key")).distinct(), ["key"])
    if n < k and not lacking:
        raise ValueError(f"{n} rows can't cover {k} keys")
    weight = F.pow((F.col("number") + 1).cast("double"), F.lit(-float(s)))
    shares = keys.withColumn("_w", F.round(weight, 12))
    total = shares.agg(F.sum(F.col("_w").cast("decimal(28,12)")).cast("double").alias("_t"))
    want = shares.join(F.broadcast(total)).withColumn("_x", F.col("_w") / F.col("_t") * (n - k))
    want = want.withColumn("_whole", F.floor("_x")).withColumn("_rest", F.round(F.col("_x") - F.col("_whole"), 9))
    left = want.agg((F.lit(n - k) - F.sum("_whole")).alias("_left"))
    order = want.select("key", "_whole", (-F.col("_rest")).alias("_r"))
    ranked, _ = numbered(order, ["_r", "key"])
    out = ranked.join(F.broadcast(left))
    return out.select("key", (1 + F.col("_whole") + (F.col("number") < F.col("_left")).cast("long")).alias("children"))


def expand_counts(counts: DataFrame) -> DataFrame:
    """(key, lack): a row for each child of ``counts``; a key without one has one row that says in ``lack`` what its count is.

    The explosion is lazy, so nothing large is held.
    """
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("children"), F.lit(1).cast("long"))))
    return counts.select("key", F.when(F.col("children") < 1, F.col("children")).alias("lack"), copies.alias("copy")).drop("copy")


def allocate_fk(parent: DataFrame, pk: str, n: int, s: float = 1.2) -> DataFrame:
    """n rows (key), each key as often as ``fk_counts`` says."""
    return expand_counts(fk_counts(parent, pk, n, s)).select("key")


def apply_effect(df: DataFrame, column: str, effect: str, value, when: Column, probability: float = 1.0, seed: int = 7, key: str | None = None) -> DataFrame:
    """multiply, add or set the values of active rows; with a probability, of a seeded share of them."""
    old = F.col(column)
    if probability < 1:
        when = when & (rng.uniform01(seed, f"event/{column}", F.col(key)) < probability)
    new = {"multiply": lambda: old * value, "add": lambda: old + value, "set": lambda: F.lit(value)}[effect]()
    return df.withColumn(column, F.when(when, new).otherwise(old))


def make_unique(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """One row per value of ``column``: the first in ``order``."""
    from weftspark.operators.constraints import dedup_first

    return dedup_first(df, [column], order)


def hash_sample(df: DataFrame, n: int, key: list[str], seed: int = 42, draw: rng.Draw | None = None) -> DataFrame:
    """n rows without replacement: those of least seeded hash of the key, or of least ``draw``."""
    by = draw(seed, "sample", *map(F.col, key)) if draw else F.xxhash64(F.lit(seed), *key)
    return df.orderBy(by, *key).limit(n)


def weighted_sample(spark: SparkSession, n: int, values: list, weights: list[float], seed: int = 7) -> DataFrame:
    """n draws (row, value) with replacement."""
    return spark.range(n).select(F.col("id").alias("row"), rng.pick(rng.uniform01(seed, "weighted", F.col("id")), values, weights).alias("value"))
