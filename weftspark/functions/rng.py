"""Seeded randomness that does not depend on partitioning.

Every draw is a hash of (seed, stream, key): a row gets the same value however the data are
split, on every rerun, and two streams are independent of each other.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_53 = float(2**53)
#: Draws of (seed, stream, key columns).
Draw = Callable[..., Column]


def uniform01(seed: int, stream: str, *key: Column) -> Column:
    """A double in [0, 1) per row."""
    bits = F.xxhash64(F.lit(seed).cast("long"), F.lit(stream), *key)
    return F.shiftrightunsigned(bits, 11).cast("double") / TWO_53


def digest01(seed: int, stream: str, *key: Column) -> Column:
    """A double in [0, 1) from MD5 of ``seed/stream/key``: 52 bits, the same in any engine."""
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.lit(stream), *[k.cast("string") for k in key]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def normal01(seed: int, stream: str, *key: Column, draw: Draw = uniform01) -> Column:
    """Box-Muller on two independent streams."""
    radius = F.sqrt(-2.0 * F.log(1.0 - draw(seed, f"{stream}/r", *key)))
    return radius * F.cos(2.0 * math.pi * draw(seed, f"{stream}/a", *key))


def pick(u: Column, values: list, weights: list[float] | None = None) -> Column:
    """The value whose share of the unit interval holds ``u``."""
    weights = weights or [1.0] * len(values)
    total, upto, out = float(sum(weights)), 0.0, None
    for value, weight in list(zip(values, weights, strict=True))[:-1]:
        upto += weight / total
        out = F.when(u < upto, F.lit(value)) if out is None else out.when(u < upto, F.lit(value))
    return F.lit(values[-1]) if out is None else out.otherwise(F.lit(values[-1]))
