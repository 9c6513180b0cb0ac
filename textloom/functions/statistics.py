"""Intervals and tail probabilities that Spark has no function for, as column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Z = 1.96


def wilson(k: Column, n: Column, z: float = Z) -> tuple[Column, Column]:
    """(low, high), clamped to [0, 1]; null for n = 0."""
    m = F.nullif(n.cast("double"), F.lit(0.0))
    p = k / m
    mid, d = p + z * z / (2 * m), 1 + z * z / m
    half = z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    return F.when(n > 0, F.greatest(F.lit(0.0), (mid - half) / d)), F.when(n > 0, F.least(F.lit(1.0), (mid + half) / d))


def beta_fraction(x: float, a: float, b: float) -> float:
    """The continued fraction of the regularised incomplete beta function, for x under (a + 1) / (a + b + 2); it takes about the root of the larger of a and b steps."""
    tiny = 1e-300
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or tiny)
    found = d
    for m in range(1, 10_000 + 10 * math.isqrt(int(max(a, b)))):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d = 1.0 / (1.0 + step * d or tiny)
            c = 1.0 + step / c or tiny
            found *= c * d
        if abs(c * d - 1.0) < 1e-14:
            break
    return found


def beta_share(x: float, a: float, b: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    log = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1) / (a + b + 2):
        return math.exp(log) * beta_fraction(x, a, b) / a
    return 1 - math.exp(log) * beta_fraction(1 - x, b, a) / b


def upper_bound(k: int, n: int, alpha: float) -> float | None:
    """The p at which a binomial number of n is k at most with probability alpha."""
    if n <= 0:
        return None
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if 1 - beta_share(middle, k + 1, n - k) > alpha else (low, middle)
        if high - low < 1e-15:
            break
    return (low + high) / 2


def clopper_pearson_upper(k: Column, n: Column, alpha: float = 0.05) -> Column:
    """One-sided upper bound: the p at which P(X <= k) is alpha; 1 for k >= n, null for n = 0. Its work and memory do not grow with k but for the steps of a fraction."""

    @F.arrow_udf(T.DoubleType())
    def bound(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ks, ns in batches:
            known: dict[tuple, float | None] = {}
            pairs = list(zip(ks.to_pylist(), ns.to_pylist()))
            for pair in set(pairs):
                known[pair] = None if None in pair else upper_bound(*pair, alpha)
            yield pa.array([known[p] for p in pairs], pa.float64())

    return bound(k.cast("long"), n.cast("long"))


@F.arrow_udf(T.DoubleType())
def upper_tail(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """One-sided p of a standard normal z."""
    for z in batches:
        yield pa.array([None if x is None else 0.5 * math.erfc(x / math.sqrt(2)) for x in z.to_pylist()], pa.float64())


def kappa(both: Column, only_a: Column, only_b: Column, neither: Column) -> Column:
    n = F.nullif((both + only_a + only_b + neither).cast("double"), F.lit(0.0))
    agree = (both + neither) / n
    a, b = (both + only_a) / n, (both + only_b) / n
    chance = a * b + (1 - a) * (1 - b)
    return F.when(chance >= 1, F.lit(1.0)).otherwise(F.try_divide(agree - chance, 1 - chance))
