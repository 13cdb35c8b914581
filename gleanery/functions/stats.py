"""Statistics: column expressions where Spark can express them, small driver functions for the p-values it can't."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """0.0 where the denominator is 0."""
    return F.when(bottom == 0, F.lit(0.0)).otherwise(top / bottom)


def log_factorial(n: Column, terms: int = 64) -> Column:
    """ln n! by a sum for small n and Stirling's series beyond."""
    x = (n + 1).cast("double")
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    exact = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(n, F.lit(terms)), F.lit(1)).cast("int")), F.lit(0.0), lambda a, k: a + F.log(k.cast("double")))
    return F.when(n <= terms, exact).otherwise(series)


def mcnemar_p(only_a: Column, only_b: Column) -> Column:
    """Two-sided exact binomial p of the smaller discordant count; 1 without discordant rows. Terms are summed by their ratio in log space."""
    n, k = only_a + only_b, F.least(only_a, only_b)
    # C(n, i) / 2^n for i = k, k-1, ...: each term is the one before times i / (n - i + 1)
    first = log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * math.log(2)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    fold = F.aggregate(
        F.sequence(F.lit(0), F.greatest(k - 1, F.lit(0)).cast("int")),
        start,
        lambda a, j: F.struct(
            (a["term"] * F.greatest(k - j, F.lit(0)) / (n - k + j + 1)).alias("term"),
            (a["total"] + a["term"] * F.greatest(k - j, F.lit(0)) / (n - k + j + 1)).alias("total"),
        ),
        lambda a: a["total"],
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * F.exp(first) * fold))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(powers, lambda x: x / F.aggregate(powers, F.lit(0.0), lambda a, y: a + y))


def argmax(values: Column) -> Column:
    """Place of the first largest entry, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def cross_entropy(probability_of_truth: Column) -> Column:
    return F.avg(-F.log(probability_of_truth))


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - incomplete_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or 1e-300)
    total = d
    for m in range(1, 1000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 / (1.0 + top * d or 1e-300)
            c = 1.0 + top / c or 1e-300
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * total


def t_test_p(t: float | None, n: int) -> float | None:
    """Two-sided p of a paired t statistic over n pairs."""
    if t is None or n < 2:
        return None
    df = n - 1
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def normal_p(z: Column, terms: int = 150) -> Column:
    """Two-sided p of a standard normal deviate, by a series without cancellation; 0 from 8.4 on, where p is below 1e-16."""
    x = F.abs(z) / math.sqrt(2)
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.struct(x.alias("term"), x.alias("total")),
        lambda a, k: F.struct((a["term"] * 2 * x * x / (2 * k + 1)).alias("term"), (a["total"] + a["term"] * 2 * x * x / (2 * k + 1)).alias("total")),
        lambda a: a["total"],
    )
    return F.when(x >= 6, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * total))


def student_p(t: Column, n: Column, exact: int = 2000) -> Column:
    """``t_test_p`` as a column: for whole degrees of freedom the tail is a finite sum; beyond ``exact`` pairs, however many, a normal
    deviate of the same tail stands for t. Null where t is null or n < 2."""
    v = (n - 1).cast("double")
    deviate = F.sqrt((v - 0.5) * F.log1p(t * t / v))
    deviate = deviate + (deviate**3 + 3 * deviate) / (48 * (v - 0.5) ** 2)
    cos2, sin = v / (v + t * t), F.abs(t) / F.sqrt(v + t * t)
    odd = (n - 1) % 2 == 1
    half = F.floor(v / 2).cast("int")
    # each term is the one before times cos2 and (2k - 1) / 2k or, for odd v, 2k / (2k + 1)
    ratio = lambda k: cos2 * F.when(odd, 2 * k / (2 * k + 1)).otherwise((2 * k - 1) / (2 * k))
    total = F.aggregate(
        F.when((half > 1) & (n <= exact), F.sequence(F.lit(1), F.greatest(half - 1, F.lit(1)))).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total")),
        lambda a, k: F.struct((a["term"] * ratio(k)).alias("term"), (a["total"] + a["term"] * ratio(k)).alias("total")),
        lambda a: a["total"],
    )
    inside = F.when(odd, 2 / math.pi * (F.asin(sin) + sin * F.sqrt(cos2) * F.when(half > 0, total).otherwise(0.0))).otherwise(sin * total)
    return F.when(t.isNull() | (n < 2), F.lit(None).cast("double")).when(n > exact, normal_p(deviate)).otherwise(F.greatest(F.lit(0.0), 1 - inside))


def wilcoxon_p(w: float | None, n: int, ties: bool = False) -> float | None:
    """Two-sided p of the smaller signed-rank sum: by counting for up to 50 pairs without ties, else by the normal approximation."""
    if w is None or n == 0:
        return None
    if n <= 50 and not ties:
        ways = [1] + [0] * (n * (n + 1) // 2)
        for k in range(1, n + 1):
            for s in range(len(ways) - 1, k - 1, -1):
                ways[s] += ways[s - k]
        return min(1.0, 2 * sum(ways[: int(w) + 1]) / 2**n)
    mean, deviation = n * (n + 1) / 4, math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return math.erfc(abs((w - mean) / deviation) / math.sqrt(2))
