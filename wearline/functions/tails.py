"""Tail probabilities for already aggregated statistics.

These run on one row per contrast. The distributions have no built-in SQL
function, so they are small vectorised helpers over Arrow batches.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors get these helpers with the plan; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz scheme)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1.0
            term *= x / n
            total += term
        return 1.0 - total * scale
    b = x + 1.0 - a
    c, d = 1e300, 1.0 / b
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2.0
        d = an * d + b
        d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return scale * h


def _rowwise(fn, *series: pd.Series) -> pd.Series:
    values = zip(*[s.astype("float64") for s in series])
    return pd.Series([fn(*v) if not any(np.isnan(v)) else None for v in values], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _student_two_sided(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _rowwise(lambda x, v: incomplete_beta(v / 2.0, 0.5, v / (v + x * x)) if v > 0 else float("nan"), t, dof)


@F.pandas_udf(T.DoubleType())
def _chi_square_upper(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _rowwise(lambda s, v: upper_gamma(v / 2.0, s / 2.0), x, dof)


@F.pandas_udf(T.DoubleType())
def _normal_two_sided(z: pd.Series) -> pd.Series:
    return _rowwise(lambda s: math.erfc(abs(s) / math.sqrt(2.0)), z)


def student_two_sided(t: Column, dof: Column) -> Column:
    return _student_two_sided(t.cast("double"), dof.cast("double"))


def chi_square_upper(x: Column, dof: Column) -> Column:
    return _chi_square_upper(x.cast("double"), dof.cast("double"))


def normal_two_sided(z: Column) -> Column:
    return _normal_two_sided(z.cast("double"))


def correlation_t(r: Column, n: Column) -> Column:
    """t statistic of a correlation on n pairs; null where |r| = 1 or n < 3."""
    dof = n.cast("double") - 2.0
    rest = F.lit(1.0) - r * r
    return F.when((dof > 0) & (rest > 0), r * F.sqrt(dof / rest))


def correlation_p(r: Column, n: Column) -> Column:
    exact = (F.abs(r) >= 1.0) & (n > 2)
    return F.when(exact, F.lit(0.0)).otherwise(student_two_sided(correlation_t(r, n), n - 2))


def kendall_exact(n: int, net: int) -> float:
    """Two-sided p of concordant minus discordant pairs among n untied rows: permutations by inversions."""
    counts = [1]
    for k in range(2, n + 1):
        grown = [0] * (len(counts) + k - 1)
        for i, c in enumerate(counts):
            for j in range(k):
                grown[i + j] += c
        counts = grown
    pairs = n * (n - 1) // 2
    least = (pairs - abs(net)) // 2
    return min(1.0, 2.0 * sum(counts[: least + 1]) / math.factorial(n))


#: Rows up to which tau without ties is tested exactly.
EXACT_ROWS = 33


@F.pandas_udf(T.DoubleType())
def _kendall(n: pd.Series, net: pd.Series, tied: pd.Series, z: pd.Series) -> pd.Series:
    out = []
    for rows, pairs, ties, score in zip(n, net, tied, z, strict=True):
        if score is None or score != score:
            out.append(None)
        elif not ties and rows <= EXACT_ROWS:
            out.append(kendall_exact(int(rows), int(round(pairs))))
        else:
            out.append(math.erfc(abs(score) / math.sqrt(2.0)))
    return pd.Series(out, dtype="float64")


def kendall_two_sided(n: Column, net: Column, tied: Column, z: Column) -> Column:
    """p of tau: exact for few rows without ties, else normal with the tie-corrected variance."""
    return _kendall(n.cast("double"), net.cast("double"), tied, z)


#: Rows of the smaller sample, and pairs of both, up to which untied samples are tested exactly (the first is a fixed value).
EXACT_SMALLER = 8
EXACT_PAIRS = 100_000


def mann_whitney_counts(n1: int, n2: int) -> list[int]:
    """Orders of two untied samples by U: the coefficients of the Gaussian binomial of n1 + n2 over n1."""
    small, large = sorted((n1, n2))
    counts = [1] + [0] * (small * large)
    for i in range(1, small + 1):
        # times 1 - q^(large + i), then divided by 1 - q^i
        for u in range(len(counts) - 1, large + i - 1, -1):
            counts[u] -= counts[u - large - i]
        for u in range(i, len(counts)):
            counts[u] += counts[u - i]
    return counts


def mann_whitney_exact(u: float, n1: int, n2: int, alternative: str) -> float:
    """p of U of the first sample without ties."""
    counts = mann_whitney_counts(n1, n2)
    total = sum(counts)
    below = sum(counts[: int(u) + 1]) / total
    above = sum(counts[math.ceil(u) :]) / total
    return {"less": below, "greater": above}.get(alternative, min(1.0, 2 * min(below, above)))


def mann_whitney_p(u: Column, n1: Column, n2: Column, tied: Column, z: Column, alternative: str) -> Column:
    """p of a rank sum test: exact for a small untied sample, else normal.

    `z` is the score towards the alternative; two-sided scores are never below zero.
    """

    @F.pandas_udf(T.DoubleType())
    def p(u: pd.Series, n1: pd.Series, n2: pd.Series, tied: pd.Series, z: pd.Series) -> pd.Series:
        out = []
        for value, a, b, ties, score in zip(u, n1, n2, tied, z, strict=True):
            if not (a > 0 and b > 0):
                out.append(None)
            elif not ties and min(a, b) <= EXACT_SMALLER and a * b <= EXACT_PAIRS:
                out.append(mann_whitney_exact(value, int(a), int(b), alternative))
            elif score is None or score != score:
                out.append(None)
            else:
                tail = math.erfc(score / math.sqrt(2.0)) / 2
                out.append(min(1.0, 2 * tail) if alternative == "two-sided" else tail)
        return pd.Series(out, dtype="float64")

    return p(u.cast("double"), n1.cast("double"), n2.cast("double"), tied, z.cast("double"))
