"""Running totals, positions, ranks and exact percentiles inside groups of any size.

A window over a group puts the whole group into one task. Here every group is
split into buckets that follow the order: the window runs inside (group,
bucket), and a total per bucket, summed over the few buckets of a group, gives
the offset. Buckets come from a time or position unit, from the high bits of a
hash, or from cut points of the whole column, which bound every (group, bucket)
cell by a fixed share of all rows however skewed the groups are.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import SPAN, hash_int
from ..session import shuffle_width


#: Most ranges that a column is cut into; quantiles are exact to a tenth of a range.
MOST_PARTS = 2_000
#: Rows of a group beyond which it is split into buckets, where groups are many and most of them small.
BUSY = 1 << 16


def cut_points(df: DataFrame, column: str, parts: int | None = None) -> list[float]:
    """Inner quantiles of the column: one row on the driver, as a range partitioner takes."""
    return cut_points_of(df, [column], parts)[column]


def cut_points_of(df: DataFrame, columns: Sequence[str], parts: int | None = None) -> dict[str, list[float]]:
    """Inner quantiles of several columns in one pass."""
    parts = min(parts or 4 * shuffle_width(df.sparkSession), MOST_PARTS)
    probs = [i / parts for i in range(1, parts)] or [0.5]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, 10 * parts).alias(c) for c in columns]).first()
    return {c: sorted(set(row[c] or [])) for c in columns}


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal keys where null equals null, as grouping has it; the keys appear once."""
    if not keys:  # two tables of one row
        one = F.lit(1).alias("_one")
        return match(left.select("*", one), right.select("*", one), ["_one"], how).drop("_one")
    other = right.select(*[F.col(k).alias(f"_m_{k}") if k in keys else F.col(k) for k in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_m_{k}")) for k in keys])
    return left.join(other, same, how).drop(*[f"_m_{k}" for k in keys])


def with_bucket(df: DataFrame, column: str, cuts: Sequence[float], out: str = "_bucket") -> DataFrame:
    """Bucket number of a value, monotone in the value (binary search in the cut points)."""
    inner = [c for c in cuts if c == c and abs(c) != float("inf")]
    if not inner:
        return df.withColumn(out, F.lit(0.0))
    splits = [-float("inf"), *inner, float("inf")]
    return (
        Bucketizer(splits=splits, inputCol="_cut_input", outputCol=out, handleInvalid="keep")
        .transform(df.withColumn("_cut_input", F.col(column).cast("double")))
        .drop("_cut_input")
    )


def hash_bucket(h: Column, buckets: int) -> Column:
    """High part of a 32-bit hash: uniform whatever the data looks like."""
    return F.floor(h * buckets / SPAN)


def running_total(
    df: DataFrame,
    by: Sequence[str],
    bucket: str,
    order: Sequence,
    amount: Column,
    out: str,
    total: str | None = None,
) -> DataFrame:
    """Sum of `amount` over the earlier rows of the group (exclusive), and the group's total.

    `bucket` names a column that is monotone in `order`. A null key is a group like any other.
    """
    by = list(by)
    keys = [*by, bucket]
    sums = df.groupBy(*keys).agg(F.sum(amount).alias("_part"))
    across = Window.partitionBy(*by).orderBy(bucket)
    head = F.coalesce(F.sum("_part").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(
        *keys,
        head.alias("_offset"),
        *([F.sum("_part").over(Window.partitionBy(*by)).alias(total)] if total else []),
    )
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.withColumn("_local", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return match(local, offsets, keys).withColumn(out, F.col("_offset") + F.col("_local")).drop("_offset", "_local")


def positions(
    df: DataFrame, by: Sequence[str], order: Sequence, bucket: Column, out: str = "pos", total: str | None = None
) -> DataFrame:
    """1-based position of every row in its group."""
    numbered = running_total(df.withColumn("_bucket", bucket), by, "_bucket", order, F.lit(1).cast("long"), out, total)
    return numbered.withColumn(out, F.col(out) + 1).drop("_bucket")


def busy_groups(df: DataFrame, by: Sequence[str], rows: int | None = None) -> DataFrame:
    """Keys of the groups with more than `rows` rows (BUSY, if not given): they are few, at most one per `rows` rows of the table."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > (BUSY if rows is None else rows)).drop("_n")


def split_busy(df: DataFrame, by: Sequence[str], bucket: Column, rows: int | None = None) -> DataFrame:
    """The table with `_bucket`: the given one in busy groups, null in all others, whose rows fit one bucket."""
    busy = busy_groups(df, by, rows).withColumn("_busy", F.lit(True))
    return match(df, busy, by, "left").withColumn("_bucket", F.when(F.col("_busy"), bucket)).drop("_busy")


def value_positions(
    df: DataFrame, by: Sequence[str], value: str, out: str = "pos", total: str | None = None
) -> DataFrame:
    """Position by a unique numeric value, split at the column's cut points."""
    cut = with_bucket(df, value, cut_points(df, value))
    numbered = running_total(cut, by, "_bucket", [value], F.lit(1).cast("long"), out, total)
    return numbered.withColumn(out, F.col(out) + 1).drop("_bucket")


def hash_positions(
    df: DataFrame, by: Sequence[str], key: Sequence[str], seed, out: str = "pos", total: str | None = None
) -> DataFrame:
    """Position in a random order: by the hash of (seed, key…), then by the key itself."""
    h = df.withColumn("_h", hash_int(seed, *[F.col(k) for k in key]))
    width = 4 * shuffle_width(df.sparkSession)
    return positions(h, by, ["_h", *key], hash_bucket(F.col("_h"), width), out, total).drop("_h")


def average_ranks(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    out: str = "rank",
    weight: str | None = None,
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """One row per (group, distinct value): count `n`, mean rank of its ties, group size `total`."""
    df = df.where(F.col(value).isNotNull())
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.groupBy(*by, value).agg(n.alias("n"))
    if cuts is None:
        cuts = cut_points(df.select(value), value)
    cut = with_bucket(counts, value, cuts)
    ran = running_total(cut, by, "_bucket", [value], F.col("n"), "_before", "total")
    return ran.withColumn(out, F.col("_before") + (F.col("n") + 1) / 2.0).drop("_bucket", "_before")


def exact_percentile(
    df: DataFrame, by: Sequence[str], value: str, quantiles: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Linear-interpolation percentiles per group, without holding a group's values in one task."""
    df = df.where(F.col(value).isNotNull())
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.groupBy(*by, value).agg(n.alias("n"))
    cut = with_bucket(counts, value, cut_points(df.select(value), value))
    ran = running_total(cut, by, "_bucket", [value], F.col("n"), "_before", "_total")
    first, last = F.col("_before"), F.col("_before") + F.col("n") - 1
    parts, outs = [], []
    for name, q in quantiles.items():
        target = (F.col("_total") - 1) * F.lit(float(q))
        for side, at in (("lo", F.floor(target)), ("hi", F.ceil(target))):
            hit = (first <= at) & (at <= last)
            parts.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_{name}_{side}"))
        parts.append(F.max(target - F.floor(target)).alias(f"_{name}_frac"))
        low, high = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        outs.append((low + (high - low) * F.col(f"_{name}_frac")).alias(name))
    return ran.groupBy(*by).agg(*parts).select(*by, *outs)
