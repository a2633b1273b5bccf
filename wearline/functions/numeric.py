"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The asymmetric score's time constants for early and late predictions.
EARLY_SCALE = 13.0
LATE_SCALE = 10.0
# Cap of the piecewise label, label tiers and their wording.
RUL_CAP = 125
RUL_EDGES = (0, 40, 80, 125)
TIER_HEALTHY = "stable operation; sensors near baseline"
TIER_MIDDLE = "progressive degradation; moderate drift in key sensors"
TIER_WORN = "advanced wear; significant deviation in efficiency sensors"
# Fixed value: two-sided 95 % normal quantile used by the Wilson interval.
Z95 = 1.959963985
# Fixed value: a window whose net change is below this is called stable.
FLAT_EPS = 0.01


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def clip(x, low: float, high: float) -> Column:
    x = col(x)
    return F.when(x.isNotNull(), F.greatest(F.lit(low).cast("double"), F.least(F.lit(high).cast("double"), x.cast("double"))))


def asymmetric_penalty(error) -> Column:
    """Late predictions (error > 0) cost more than early ones."""
    e = col(error)
    return F.when(e < 0, F.exp(-e / EARLY_SCALE) - 1).otherwise(F.exp(e / LATE_SCALE) - 1)


def ratio(num, den) -> Column:
    """num / den as double, null when the denominator is zero."""
    den = col(den).cast("double")
    return F.when(den != 0, col(num).cast("double") / den)


def percent(num, den) -> Column:
    return ratio(num, den) * 100.0


def bin_rul(x, edges=RUL_EDGES) -> Column:
    """0-based bin of right-closed edges; the lowest edge belongs to the first bin."""
    x = col(x)
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        low = x >= edges[i] if i == 0 else x > edges[i]
        out = F.when(low & (x <= edges[i + 1]), F.lit(i)).otherwise(out)
    return out


def describe_rul(x) -> Column:
    x = col(x)
    return F.when(x > RUL_EDGES[2], TIER_HEALTHY).when(x > RUL_EDGES[1], TIER_MIDDLE).otherwise(TIER_WORN)


def to_grid(x, step: float = 1.0) -> Column:
    """Nearest multiple of step, ties to even."""
    return F.rint(col(x) / F.lit(float(step))) * F.lit(float(step))


def direction_of(net, eps: float = FLAT_EPS) -> Column:
    net = col(net)
    e = eps if isinstance(eps, Column) else F.lit(float(eps))
    return F.when(F.abs(net) < e, "stable").when(net > 0, "increase").when(net.isNotNull(), "decrease")


def opposite(direction) -> Column:
    d = col(direction)
    return F.when(d == "increase", "decrease").when(d == "decrease", "increase")


def is_directional(label) -> Column:
    return col(label).isin("increase", "decrease")


def mean_flag(flag) -> Column:
    """Share of true rows; null flags leave the denominator."""
    return F.avg(col(flag).cast("double"))


def wilson(hits, n, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval of hits / n."""
    n = col(n).cast("double")
    p = ratio(hits, n)
    z2 = z * z
    centre = (p + F.lit(z2) / (n * 2.0)) / (F.lit(z2) / n + 1.0)
    half = F.sqrt(p * (F.lit(1.0) - p) / n + F.lit(z2) / (n * n * 4.0)) * z / (F.lit(z2) / n + 1.0)
    return centre - half, centre + half


def entropy_bits(count, total) -> Column:
    """Aggregate: Shannon entropy in bits of a count column within one group."""
    p = col(count).cast("double") / col(total)
    return F.abs(F.sum(p * F.log2(p)))


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient as a double."""
    n, k = col(n), col(k)
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k.cast("long"))).otherwise(F.array().cast("array<long>"))
    return F.round(F.aggregate(steps, F.lit(1.0), lambda acc, i: acc * (n - k + i) / i))
