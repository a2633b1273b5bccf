"""Rank statistics per group, for groups of any size.

Rows are first counted by distinct value (or value pair); ranks come from
running totals over those counts, so ties cost nothing and no group has to fit
into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from ..functions.numeric import ratio
from ..session import shared
from .ordering import average_ranks, busy_groups, cut_points_of, match, running_total, with_bucket


def value_cells(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Complete pairs counted by distinct (x, y)."""
    whole = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return whole.groupBy(*by, x, y).agg(F.count(F.lit(1)).alias("_w"))


def _ranked_cells(cells: DataFrame, by: Sequence[str], x: str, y: str, cuts=None) -> DataFrame:
    if cuts is None:
        both = cut_points_of(cells, [x, y])
        cuts = both[x], both[y]
    cx, cy = cuts
    rx = average_ranks(cells, by, x, "rx", "_w", cx).select(*by, x, "rx", F.col("n").alias("nx"), "total")
    ry = average_ranks(cells, by, y, "ry", "_w", cy).select(*by, y, "ry", F.col("n").alias("ny"))
    return match(match(cells, rx, [*by, x]), ry, [*by, y])


def spearman(df: DataFrame, by: Sequence[str], x: str, y: str, cuts=None) -> DataFrame:
    """n and Spearman's rho with mean ranks on ties; null where either side is constant."""
    return spearman_of_cells(shared(value_cells(df, by, x, y)), by, x, y, cuts)


def spearman_of_cells(cells: DataFrame, by: Sequence[str], x: str, y: str, cuts=None) -> DataFrame:
    ranked = _ranked_cells(cells, by, x, y, cuts)
    mid = (F.col("total") + 1) / 2.0
    dx, dy = F.col("rx") - mid, F.col("ry") - mid
    sums = ranked.groupBy(*by).agg(
        F.sum("_w").alias("n"),
        F.sum(F.col("_w") * dx * dy).alias("_xy"),
        F.sum(F.col("_w") * dx * dx).alias("_xx"),
        F.sum(F.col("_w") * dy * dy).alias("_yy"),
    )
    return sums.select(*by, "n", ratio("_xy", F.sqrt(F.col("_xx")) * F.sqrt(F.col("_yy"))).alias("rho"))


def spearman_of_many(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """`spearman` where groups are many and most of them small: these are ranked by windows, after one shuffle for both sides.

    Groups of more than BUSY rows, which are few, are ranked from counts and running totals.
    """
    by = list(by)
    rows = shared(df.select(*by, x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull()))
    busy = shared(busy_groups(rows, by))
    small = match(rows, busy, by, "left_anti") if busy.limit(1).count() else rows

    def rank(c: str) -> Column:
        # rows below and tied ones, from both ends of the ties
        order = Window.partitionBy(*by).orderBy(c)
        return (F.rank().over(order) + F.count(F.lit(1)).over(order.rangeBetween(Window.unboundedPreceding, 0))) / 2.0

    mid = (F.count(F.lit(1)).over(Window.partitionBy(*by)) + 1) / 2.0
    ranked = small.select(*by, x, y, rank(x).alias("_rx")).select(*by, "_rx", rank(y).alias("_ry"), mid.alias("_mid"))
    dx, dy = F.col("_rx") - F.col("_mid"), F.col("_ry") - F.col("_mid")
    sums = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(dx * dy).alias("_xy"), F.sum(dx * dx).alias("_xx"), F.sum(dy * dy).alias("_yy")
    )
    found = sums.select(*by, "n", ratio("_xy", F.sqrt(F.col("_xx")) * F.sqrt(F.col("_yy"))).alias("rho"))
    if small is rows:
        return found
    return found.unionByName(spearman(match(rows, busy, by, "left_semi"), by, x, y))


def correlation(x: str, y: str) -> Column:
    """Aggregate: Pearson's r, null where a side is constant (`corr` fails there under ANSI division)."""
    varies = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(varies, ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def pearson(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.where(both).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), correlation(x, y).alias("r"))


def linear_fit(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")
    )


def kendall(df: DataFrame, by: Sequence[str], x: str, y: str, parts: bool = False) -> DataFrame:
    """Kendall's tau-b without forming pairs.

    Two values of x differ first at exactly one bit of their dense rank. So for
    every bit level the cells are grouped by the higher bits; inside such a
    group each cell with the bit set is compared, by a running total along y, with
    all cells that have it clear. One cell meets each other cell on one level only:
    n log n work, and the running totals split large groups.
    """
    if not by:
        return kendall(df.withColumn("_one", F.lit(1)), ["_one"], x, y, parts).drop("_one")
    by = list(by)
    cells = shared(value_cells(df, by, x, y))
    cuts = cut_points_of(cells, [x, y])
    xs = cells.groupBy(*by, x).agg(F.sum("_w").alias("nx"))
    dense = running_total(
        with_bucket(xs, x, cuts[x]), by, "_bucket", [x], F.lit(1).cast("long"), "dx", "levels"
    ).select(*by, x, "dx", "levels")
    bits = F.length(F.bin(F.greatest(F.col("levels") - 1, F.lit(1).cast("long"))))
    spread = match(cells, dense, [*by, x]).withColumn("_level", F.explode(F.sequence(F.lit(0), bits - 1)))
    prefix = F.expr("shiftright(dx, _level + 1)")
    bit = F.expr("shiftright(dx, _level) & 1")
    keys = [*by, "_level", "_prefix"]
    zeros = F.sum(F.when(bit == 0, F.col("_w")).otherwise(0))
    ones = F.sum(F.when(bit == 1, F.col("_w")).otherwise(0))
    along = (
        spread.withColumn("_prefix", prefix).groupBy(*keys, y).agg(zeros.alias("_zero"), ones.alias("_one"))
    )
    along = with_bucket(along, y, cuts[y])
    ran = running_total(along, keys, "_bucket", [y], F.col("_zero"), "_below", "_all")
    above = F.col("_all") - F.col("_below") - F.col("_zero")
    net = ran.groupBy(*by).agg(F.sum((F.col("_one") * (F.col("_below") - above)).cast("double")).alias("_net"))
    pairs = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2.0


    def ties(c: str, side: str) -> list[Column]:
        t = F.col(c).cast("double")
        return [
            F.sum(pairs(c)).alias(f"_t{side}"),
            F.sum(t * (t - 1) * (t - 2)).alias(f"_u{side}"),
            F.sum(t * (t - 1) * (t * 2 + 5)).alias(f"_v{side}"),
        ]

    tx = xs.groupBy(*by).agg(F.sum("nx").alias("n"), *ties("nx", "x"))
    ty = cells.groupBy(*by, y).agg(F.sum("_w").alias("ny")).groupBy(*by).agg(*ties("ny", "y"))
    out = match(match(net, tx, by), ty, by)
    every = pairs("n")
    tau = ratio("_net", F.sqrt(every - F.col("_tx")) * F.sqrt(every - F.col("_ty")))
    return out.select(*by, "n", tau.alias("tau"), *(KENDALL_PARTS if parts else ()))


#: Net concordance and tie sums behind tau, for its test.
KENDALL_PARTS = ("_net", "_tx", "_ux", "_vx", "_ty", "_uy", "_vy")


def kendall_z() -> Column:
    """Concordant minus discordant pairs over its standard deviation, corrected for ties on both sides."""
    n = F.col("n").cast("double")
    size = n * (n - 1)
    free = (size * (n * 2 + 5) - F.col("_vx") - F.col("_vy")) / 18.0
    tied = F.col("_tx") * F.col("_ty") * 2.0 / size
    tied_three = F.when(n > 2, F.col("_ux") * F.col("_uy") / (size * (n - 2) * 9.0)).otherwise(0.0)
    return ratio("_net", F.sqrt(free + tied + tied_three))


def rank_tests(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """rho, r and tau with their test statistics and two-sided p-values, one row per group."""
    by = list(by)
    tau = kendall(df, by, x, y, parts=True).withColumn("tau_z", kendall_z())
    tau = tau.withColumn("_tied", (F.col("_tx") > 0) | (F.col("_ty") > 0))
    all3 = match(spearman(df, by, x, y), pearson(df, by, x, y).select(*by, "r"), by)
    all3 = match(all3, tau.select(*by, "tau", "tau_z", "_net", "_tied"), by)
    n = F.col("n")
    return (
        all3.withColumn("rho_t", tails.correlation_t(F.col("rho"), n))
        .withColumn("r_t", tails.correlation_t(F.col("r"), n))
        .withColumn("rho_p", tails.correlation_p(F.col("rho"), n))
        .withColumn("r_p", tails.correlation_p(F.col("r"), n))
        .withColumn("tau_p", tails.kendall_two_sided(n, F.col("_net"), F.col("_tied"), F.col("tau_z")))
        .drop("_net", "_tied")
    )


def leave_one_out(df: DataFrame, by: Sequence[str], key: str, x: str, y: str) -> DataFrame:
    """Pearson's r of the group without each row in turn, from the group's sums: no self join."""
    if not by:
        return leave_one_out(df.withColumn("_one", F.lit(1)), ["_one"], key, x, y).drop("_one")
    by = list(by)
    whole = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    centre = whole.groupBy(*by).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    c = match(whole, centre, by).withColumn("_x", F.col(x) - F.col("_mx")).withColumn("_y", F.col(y) - F.col("_my"))
    sums = c.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(F.col("_x") * F.col("_x")).alias("_sxx"),
        F.sum(F.col("_y") * F.col("_y")).alias("_syy"),
        F.sum(F.col("_x") * F.col("_y")).alias("_sxy"),
    )
    # With centred sums, removing one row (a, b) from n lowers Sab by a·b·n/(n − 1).
    grow = ratio("_n", F.col("_n") - 1)
    sxx = F.col("_sxx") - F.col("_x") * F.col("_x") * grow
    syy = F.col("_syy") - F.col("_y") * F.col("_y") * grow
    sxy = F.col("_sxy") - F.col("_x") * F.col("_y") * grow
    return match(c, sums, by).select(*by, key, (F.col("_n") - 1).alias("n"), ratio(sxy, F.sqrt(sxx) * F.sqrt(syy)).alias("r"))


def rank_sums(df: DataFrame, by: Sequence[str], group: str, value: str) -> DataFrame:
    """Rank sum of every sample among all values of its family, with the family's tie term."""
    by = list(by)
    ranks = average_ranks(df.select(*by, value), by, value).select(*by, value, "rank", F.col("n").alias("_ties"), "total")
    per_sample = df.where(F.col(value).isNotNull()).groupBy(*by, group, value).agg(F.count(F.lit(1)).alias("_k"))
    ties = F.col("_ties").cast("double")
    tie_term = ranks.groupBy(*by).agg(F.sum(ties * ties * ties - ties).alias("tie_term"))
    sums = match(per_sample, ranks, [*by, value]).groupBy(*by, group).agg(
        F.sum("_k").alias("n"), F.sum(F.col("_k") * F.col("rank")).alias("rank_sum"), F.max("total").alias("total")
    )
    return match(sums, tie_term, by)


def mann_whitney(
    df: DataFrame, by: Sequence[str], group: str, value: str, first, second, alternative: str = "two-sided"
) -> DataFrame:
    """U of the first sample, z with tie and continuity correction, p.

    The alternative is "two-sided", "less" (the first sample tends to smaller values)
    or "greater"; z is the score towards it. p is exact where there are no ties and
    the smaller sample has eight rows or fewer (and 100,000 pairs at most), else normal.
    """
    if alternative not in ("two-sided", "less", "greater"):
        raise ValueError("the alternative is two-sided, less or greater")
    by = list(by)
    two = rank_sums(df.where(F.col(group).isin(first, second)), by, group, value)
    pick = lambda c, g: F.max(F.when(F.col(group) == g, F.col(c))).cast("double")
    wide = two.groupBy(*by).agg(
        pick("n", first).alias("n1"), pick("n", second).alias("n2"), pick("rank_sum", first).alias("_r"), F.max("tie_term").alias("_t")
    )
    n1, n2 = F.col("n1"), F.col("n2")
    total = n1 + n2
    u = F.col("_r") - n1 * (n1 + 1) / 2.0
    sd = F.sqrt(n1 * n2 / 12.0 * ((total + 1) - F.col("_t") / (total * (total - 1))))
    towards = {"less": n1 * n2 - u, "greater": u}.get(alternative, F.greatest(u, n1 * n2 - u))
    z = ratio(towards - n1 * n2 / 2.0 - 0.5, sd)
    score = F.when(z < 0, F.lit(0.0)).otherwise(z) if alternative == "two-sided" else z
    p = tails.mann_whitney_p(u, n1, n2, F.col("_t") > 0, score, alternative)
    return wide.select(*by, "n1", "n2", u.alias("u"), z.alias("z"), p.alias("p"))


def kruskal_wallis(df: DataFrame, by: Sequence[str], group: str, value: str) -> DataFrame:
    """H with tie correction over all samples of a family, chi-square p."""
    sums = rank_sums(df, by, group, value)
    per = sums.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"),
        F.sum("n").alias("n"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("_s"),
        F.max("tie_term").alias("_t"),
    )
    n = F.col("n").cast("double")
    raw = F.lit(12.0) / (n * (n + 1)) * F.col("_s") - (n + 1) * 3.0
    h = ratio(raw, F.lit(1.0) - F.col("_t") / (n * n * n - n))
    return per.select(*by, "samples", "n", h.alias("h"), tails.chi_square_upper(h, F.col("samples") - 1).alias("p"))
