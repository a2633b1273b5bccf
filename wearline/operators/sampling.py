"""Reproducible samples: by hash order, so any partitioning draws the same rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import hash_int
from ..functions.numeric import RUL_EDGES, bin_rul
from ..session import shared
from .frames import eligible_cuts
from .ordering import hash_positions, match


def _hash(df: DataFrame, seed, key: Sequence[str]) -> DataFrame:
    return df.withColumn("_h", hash_int(seed, *[F.col(k) for k in key]))


def stratified_sample(
    df: DataFrame, stratum: str, key: Sequence[str], quota: Mapping, seed="sample", shuffle_ids: bool = True
) -> DataFrame:
    """Up to quota[s] rows of every listed stratum, without replacement, then numbered in a random order.

    Positions in hash order come from buckets of the hash, so a stratum and a quota
    of any size spread over many tasks.
    """
    wanted = F.create_map(*[F.lit(x) for kv in quota.items() for x in kv])
    listed = df.where(F.col(stratum).isin(*quota))
    ranked = hash_positions(listed, [stratum], key, seed, "_rn")
    taken = ranked.where(F.col("_rn") <= F.element_at(wanted, F.col(stratum))).drop("_rn")
    if not shuffle_ids:
        return taken
    return hash_positions(shared(taken), [], [stratum, *key], f"{seed}-order", "id")


def random_examples(df: DataFrame, k: int, key: Sequence[str], n: int, seed="examples", cycle: str = "cycle") -> DataFrame:
    """k uniform cut points with enough history: a top-k by hash, no global sort."""
    return _hash(eligible_cuts(df, n, cycle), seed, key).orderBy("_h", *key).limit(k).drop("_h")


def stratified_examples(df: DataFrame, k: int, n: int, seed="examples", edges=RUL_EDGES, by=("dataset",)) -> DataFrame:
    """k // 3 cut points per label bin, the remainder to the low bins; each is moved to the
    latest eligible row of its unit with the same label."""
    by = list(by)
    pool = eligible_cuts(df, n).withColumn("bin", bin_rul("rul", edges))
    base, rest = divmod(k, 3)
    quota = {b: base + (1 if b < rest else 0) for b in range(3)}
    key = [*by, "unit", "cycle"]
    ranked = hash_positions(pool, [*by, "bin"], key, seed, "_rn")
    wanted = F.element_at(F.create_map(*[F.lit(x) for kv in quota.items() for x in kv]), F.col("bin"))
    drawn = ranked.where(F.col("_rn") <= wanted).select(*by, "unit", "rul", "bin", F.col("cycle").alias("drawn_cycle"))
    latest = eligible_cuts(df, n).groupBy(*by, "unit", "rul").agg(F.max("cycle").alias("cycle"))
    return match(drawn, latest, [*by, "unit", "rul"])


def last_cycle_pool(df: DataFrame, edges=RUL_EDGES, by=("dataset",)) -> DataFrame:
    """The original example pool: the last row of each unit, binned by label (all zero when units run to failure)."""
    last = df.groupBy(*by, "unit").agg(F.max("cycle").alias("cycle"), F.min_by("rul", -F.col("cycle")).alias("rul"))
    return last.withColumn("bin", bin_rul("rul", edges))


def first_per_bin(pool: DataFrame, k: int, by=("dataset",)) -> DataFrame:
    """First max(1, k // 3) units of every bin in ascending id, at most k."""
    per_bin = max(1, k // 3)
    w = Window.partitionBy(*by, "bin").orderBy("unit")
    few = pool.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= per_bin)
    order = Window.partitionBy(*by).orderBy("bin", "_rn")
    return few.withColumn("slot", F.row_number().over(order).cast("long")).where(F.col("slot") <= k).drop("_rn")


def effective_examples(pool: DataFrame, ks: Sequence[int], by=("dataset",)) -> DataFrame:
    """How many examples a requested k really gives with the last-cycle pool."""
    top = max(max(1, k // 3) for k in ks)
    w = Window.partitionBy(*by, "bin").orderBy("unit")
    few = pool.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top)
    asked = few.withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in ks])))
    per_bin = F.greatest(F.lit(1), F.floor(F.col("k") / 3))
    kept = asked.where(F.col("_rn") <= per_bin)
    return kept.groupBy(*by, "k").agg(F.least(F.col("k"), F.count(F.lit(1))).alias("examples"), F.max("rul").alias("largest_rul"))


def group_split(df: DataFrame, share: float = 0.15, unit: Sequence[str] = ("dataset", "unit"), seed="split") -> DataFrame:
    """Flag the rows of max(1, floor(share · units)) randomly chosen units for validation."""
    units = df.select(*unit).distinct()
    numbered = hash_positions(units, [], unit, seed, "_pos", "_units")
    held = F.greatest(F.lit(1), F.floor(F.col("_units") * share))
    flags = numbered.select(*unit, (F.col("_pos") <= held).alias("validation"))
    return match(df, flags, list(unit))


def first_units(df: DataFrame, n: int, unit: Sequence[str] = ("dataset", "unit")) -> DataFrame:
    """Rows of the first n units in id order (smoke runs)."""
    few = df.select(*unit).distinct().orderBy(*unit).limit(n)
    return df.join(few, list(unit), "left_semi")


def head_per(df: DataFrame, by: Sequence[str], order: Sequence, k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")

