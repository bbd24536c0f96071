"""Distribution functions: as Columns where rows need them, as floats for a final p-value."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_cdf(z: Column) -> Column:
    """Standard normal CDF to 7.5e-8 (Abramowitz and Stegun 26.2.17)."""
    a = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2.0) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1.0 - tail).otherwise(tail)


def chi_square_tail(statistic: float, freedom: int) -> float:
    """P(X > statistic): the upper regularised gamma function at (freedom / 2, statistic / 2)."""
    if statistic <= 0 or freedom <= 0:
        return 1.0
    if math.isinf(statistic):
        return 0.0
    a, x = freedom / 2.0, statistic / 2.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + an / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def kolmogorov_tail(distance: float, n: float) -> float:
    """Asymptotic p-value of a KS distance for an effective sample size ``n``."""
    if n <= 0:
        return 1.0
    root = math.sqrt(n)
    lam = (root + 0.12 + 0.11 / root) * distance
    if lam < 0.2:
        return 1.0
    total = 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * lam) ** 2) for k in range(1, 101))
    return min(max(total, 0.0), 1.0)
