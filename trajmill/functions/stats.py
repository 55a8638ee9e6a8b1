"""Closed-form statistics as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def binomial_two_sided(a: Column, b: Column) -> Column:
    """Exact two-sided p of a fair binomial for the counts a and b (1 if both are 0), summed in log space."""
    n, x = (a + b).cast("double"), F.least(a, b)
    start = F.struct((-n * F.log(F.lit(2.0))).alias("log"), F.exp(-n * F.log(F.lit(2.0))).alias("sum"))

    def step(acc: Column, k: Column) -> Column:
        term = acc["log"] + F.log(n - k + 1) - F.log(k.cast("double"))
        return F.struct(term.alias("log"), (acc["sum"] + F.exp(term)).alias("sum"))

    ks = F.when(x >= 1, F.sequence(F.lit(1).cast("long"), x.cast("long"))).otherwise(F.array().cast("array<bigint>"))
    tail = F.aggregate(ks, start, step, lambda acc: acc["sum"])
    return F.when(a + b == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2.0 * tail))


def log_gamma(x: Column) -> Column:
    """log of the gamma function for x >= 1: Stirling's series at x + 8, less the factors in between."""
    y = x.cast("double") + 8
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    factors = x.cast("double")
    for i in range(1, 8):
        factors = factors * (x + i)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(factors)


#: Up to so many factors pass_hat multiplies; beyond, it takes as long for every k.
_FACTORS = 32


def pass_hat(n: Column, s: Column, k: Column) -> Column:
    """C(s, k) / C(n, k); null if k > n."""
    few = F.aggregate(F.sequence(F.lit(0).cast("long"), k.cast("long") - 1), F.lit(1.0), lambda acc, i: acc * (s - i) / (n - i))
    many = F.exp(log_gamma(s + 1) - log_gamma(s - k + 1) + log_gamma(n - k + 1) - log_gamma(n + 1))
    return F.when(k <= n, F.when(s < k, 0.0).when(s == n, 1.0).when(k <= _FACTORS, few).otherwise(many))


def nearest_rank(sorted_values: Column, q: float) -> Column:
    """The value at round((n - 1) * q), halves to even; 0 if there is none."""
    at = F.bround((F.size(sorted_values) - 1) * F.lit(q), 0).cast("int")
    return F.when(F.size(sorted_values) == 0, 0).otherwise(F.get(sorted_values, at))
