"""Trajectories: labels, scaling, trailing windows and features.

A trajectory table has one row per (dataset, unit, cycle) with one double
column per setting and sensor; `cycle` counts 1, 2, 3… within a unit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import FLAT_EPS, RUL_CAP, direction_of
from .ordering import match, positions, value_positions

UNIT = ("dataset", "unit")


# ------------------------------------------------------------------ labels
def with_life(df: DataFrame, unit: Sequence[str] = UNIT, cycle: str = "cycle") -> DataFrame:
    """Last cycle of the unit next to every row.

    A partially aggregated maximum is joined back, so a very long unit is split by adaptive
    skew handling instead of filling one window task. A table that knows it already is left alone.
    """
    if "life" in df.columns:
        return df
    return match(df, df.groupBy(*unit).agg(F.max(cycle).alias("life")), list(unit))


def with_rul(
    df: DataFrame, cap: float = RUL_CAP, unit: Sequence[str] = UNIT, cycle: str = "cycle", out: str = "rul"
) -> DataFrame:
    """Piecewise label least(last cycle − cycle, cap)."""
    left = F.col("life") - F.col(cycle)
    return with_life(df, unit, cycle).withColumn(out, F.least(F.lit(cap).cast("long"), left)).drop("life")


def attach_terminal_labels(last: DataFrame, labels: DataFrame) -> DataFrame:
    """Give the n-th unit of a dataset (ascending id) the n-th terminal label."""
    numbered = value_positions(last, ["dataset"], "unit", "pos")
    return numbered.join(labels, ["dataset", "pos"], "left")


def last_observation(df: DataFrame, columns: Sequence[str], unit: Sequence[str] = UNIT, cycle: str = "cycle") -> DataFrame:
    """Last non-null value of every column, per unit."""
    picks = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(cycle))).alias(c) for c in columns]
    return df.groupBy(*unit).agg(F.max(cycle).alias(cycle), *picks)


# ------------------------------------------------------------------ scaling
def fit_minmax(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Minimum and maximum per group."""
    stats = []
    for c in columns:
        stats += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.groupBy(*by).agg(*stats)


def apply_minmax(
    df: DataFrame, scaler: DataFrame, columns: Sequence[str], by: Sequence[str] = ("dataset",), clip: bool = False
) -> DataFrame:
    """Scale with a fitted table. A constant column maps to value − min; rows without a fit get null."""
    joined = match(df, scaler, list(by), "left")
    out = {}
    for c in columns:
        low, high = F.col(f"{c}_min"), F.col(f"{c}_max")
        span = F.when(high == low, F.lit(1.0)).otherwise(high - low)
        scaled = (F.col(c) - low) / span
        out[c] = F.when(scaled.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))) if clip else scaled
    return joined.withColumns(out).drop(*[f"{c}_{s}" for c in columns for s in ("min", "max")])


def constant_columns(df: DataFrame, columns: Sequence[str], expected: Sequence[str], by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Which columns never vary, against a list that claims to name them. One pass, no distinct sets."""
    flags = [F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias(c) for c in columns]
    flat = df.groupBy(*by).agg(*flags)
    found = F.filter(F.array(*[F.when(F.col(c), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    listed = F.array(*[F.lit(c) for c in expected]).cast("array<string>")
    return (
        flat.withColumn("constant", F.sort_array(found))
        .withColumn("not_listed", F.sort_array(F.array_except("constant", listed)))
        .withColumn("not_constant", F.sort_array(F.array_except(listed, F.col("constant"))))
        .select(*by, "constant", "not_listed", "not_constant")
    )


# ------------------------------------------------------------------ windows
def tail_window(df: DataFrame, n: int, unit: Sequence[str] = UNIT, cycle: str = "cycle", out: str = "back") -> DataFrame:
    """Last n rows of each unit; `back` is 1 for the last row.

    The row limit lets Spark keep only n rows per unit on the map side
    (WindowGroupLimit), so long units are cut down before the shuffle.
    """
    w = Window.partitionBy(*unit).orderBy(F.col(cycle).desc())
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


def tail_windows(df: DataFrame, lengths: Sequence[int], unit: Sequence[str] = UNIT, cycle: str = "cycle") -> DataFrame:
    """The tails of several lengths stacked, with their length in `n`: one shuffle for all of them."""
    longest = tail_window(df, max(lengths), unit, cycle)
    sizes = F.array(*[F.lit(n).cast("long") for n in lengths])
    return longest.withColumn("n", F.explode(sizes)).where(F.col("back") <= F.col("n"))


def reverse_window(window: DataFrame, by: Sequence[str] = UNIT, back: str = "back") -> DataFrame:
    """Show a window backwards: the oldest row takes the place of the newest."""
    rows = window.groupBy(*by).agg(F.max(back).alias("_rows"))
    return match(window, rows, list(by)).withColumn(back, F.col("_rows") + 1 - F.col(back)).drop("_rows")


def long_sensors(df: DataFrame, keys: Sequence[str], sensors: Sequence[str]) -> DataFrame:
    """One row per sensor; a narrow operation."""
    cells = F.array(*[F.struct(F.lit(s).alias("sensor"), F.col(s).cast("double").alias("reading")) for s in sensors])
    return df.select(*keys, F.inline(cells))


def window_direction(
    window: DataFrame, sensors: Sequence[str], by: Sequence[str], back: str = "back", eps: float = FLAT_EPS
) -> DataFrame:
    """Direction a displayed window shows per sensor: newest − oldest of the values rounded to 3 decimals."""
    ends = []
    for s in sensors:
        shown = F.round(F.col(s), 3)
        net = F.min_by(shown, F.col(back)) - F.max_by(shown, F.col(back))
        ends.append(net.alias(s))
    nets = window.groupBy(*by).agg(*ends)
    return long_sensors(nets, by, sensors).select(
        *by, "sensor", F.col("reading").alias("net"), direction_of("reading", eps).alias("actual")
    )


# ------------------------------------------------------------------ features
def row_positions(df: DataFrame, unit: Sequence[str] = UNIT, cycle: str = "cycle", chunk: int = 8192) -> DataFrame:
    """Position of every row in its unit, whatever gaps its cycles have."""
    return positions(df, list(unit), [cycle], F.floor((F.col(cycle) - 1) / chunk), "_pos")


def _chunked(df: DataFrame, n: int, unit: Sequence[str], cycle: str, chunk: int) -> DataFrame:
    """Cut long units into chunks of rows; a row is repeated in every later chunk whose windows reach back to it."""
    placed = row_positions(df, unit, cycle, chunk)
    own = F.floor((F.col("_pos") - 1) / chunk)
    last = F.floor((F.col("_pos") - 1 + (n - 1)) / chunk)
    return placed.withColumn("_own", own).withColumn("_chunk", F.explode(F.sequence(own, last))).drop("_pos")


def sliding_features(
    df: DataFrame,
    columns: Sequence[str],
    n: int = 30,
    keep: Sequence[str] = (),
    unit: Sequence[str] = UNIT,
    cycle: str = "cycle",
    chunk: int = 8192,
) -> DataFrame:
    """Mean, population sd and net change of the last n rows, for rows with a full window.

    Windows run inside (unit, chunk of rows): a unit of any length spreads over
    many tasks, at the price of n − 1 repeated rows per chunk.
    """
    cut = _chunked(df, n, unit, cycle, chunk)
    part = Window.partitionBy(*unit, "_chunk").orderBy(cycle)
    w = part.rowsBetween(-(n - 1), 0)
    feats = []
    for c in columns:
        feats += [
            F.avg(c).over(w).alias(f"{c}_mean"),
            F.stddev_pop(c).over(w).alias(f"{c}_sd"),
            (F.col(c) - F.first(c).over(w)).alias(f"{c}_net"),
        ]
    out = cut.select(
        *unit, cycle, *keep, "_own", "_chunk", F.count(F.lit(1)).over(w).alias("_rows"), *feats
    )
    return out.where((F.col("_rows") == n) & (F.col("_own") == F.col("_chunk"))).drop("_rows", "_own", "_chunk")


def tail_features(
    df: DataFrame, columns: Sequence[str], n: int = 30, pad: bool = True, unit: Sequence[str] = UNIT, cycle: str = "cycle"
) -> DataFrame:
    """The same features of the last n rows; a shorter unit is padded in front with zeros.

    Closed form from count, sum and sum of squared deviations: the padding
    rows add (n − count) zeros to the mean, the sd and the first value.
    """
    tail = tail_window(df, n, unit, cycle)
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in columns:
        aggs += [
            F.avg(c).alias(f"_{c}_avg"),
            F.var_pop(c).alias(f"_{c}_var"),
            F.min_by(c, "back").alias(f"_{c}_last"),
            F.max_by(c, "back").alias(f"_{c}_first"),
        ]
    g = tail.groupBy(*unit).agg(*aggs)
    share = F.col("_rows") / F.lit(float(n)) if pad else F.lit(1.0)
    outs = []
    for c in columns:
        mean, var = F.col(f"_{c}_avg"), F.col(f"_{c}_var")
        first = F.when(F.col("_rows") < n, F.lit(0.0)).otherwise(F.col(f"_{c}_first")) if pad else F.col(f"_{c}_first")
        outs += [
            (mean * share).alias(f"{c}_mean"),
            F.sqrt(share * var + share * (F.lit(1.0) - share) * mean * mean).alias(f"{c}_sd"),
            (F.col(f"_{c}_last") - first).alias(f"{c}_net"),
        ]
    return g.select(*unit, F.col("_rows").alias("rows"), *outs)


def sequences(
    df: DataFrame,
    columns: Sequence[str],
    n: int = 30,
    keep: Sequence[str] = (),
    unit: Sequence[str] = UNIT,
    cycle: str = "cycle",
    chunk: int = 8192,
) -> DataFrame:
    """n × columns array ending at each row with a full window."""
    cut = _chunked(df, n, unit, cycle, chunk)
    w = Window.partitionBy(*unit, "_chunk").orderBy(cycle).rowsBetween(-(n - 1), 0)
    step = F.array(*[F.col(c).cast("double") for c in columns])
    out = cut.select(*unit, cycle, *keep, "_own", "_chunk", F.collect_list(step).over(w).alias("sequence"))
    return out.where((F.size("sequence") == n) & (F.col("_own") == F.col("_chunk"))).drop("_own", "_chunk")


def tail_sequences(
    df: DataFrame, columns: Sequence[str], n: int = 30, unit: Sequence[str] = UNIT, cycle: str = "cycle"
) -> DataFrame:
    """The last n rows of each unit as an n × columns array, zero rows in front of short units."""
    step = F.struct(F.col(cycle), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    rows = tail_window(df, n, unit, cycle).groupBy(*unit).agg(F.array_sort(F.collect_list(step)).alias("_r"))
    zero = F.array(*[F.lit(0.0) for _ in columns])
    padding = F.array_repeat(zero, F.lit(n) - F.size("_r"))
    return rows.select(*unit, F.concat(padding, F.transform("_r", lambda s: s["x"])).alias("sequence"))


def eligible_cuts(df: DataFrame, n: int, cycle: str = "cycle", unit: Sequence[str] = UNIT) -> DataFrame:
    """Rows with at least n rows of history, counting rows and not cycles."""
    return row_positions(df, unit, cycle).where(F.col("_pos") >= n).drop("_pos")


def lag_labels(window: DataFrame, n: int, by: Sequence[str] = UNIT, back: str = "back") -> DataFrame:
    """Label rows t-n, t-(n-1), … from the oldest row on, also when fewer than n rows exist."""
    rows = window.groupBy(*by).agg(F.max(back).alias("_rows"))
    lag = F.lit(n) - (F.col("_rows") - F.col(back))
    return (
        match(window, rows, list(by))
        .withColumn("lag", lag.cast("long"))
        .withColumn("label", F.concat(F.lit("t-"), F.col("lag").cast("string")))
        .drop("_rows")
    )


def engine_key(dataset: str = "dataset", unit: str = "unit") -> Column:
    return F.concat_ws("-", F.col(dataset), F.col(unit).cast("string"))


def config_key(dataset: str = "dataset", mode: str = "mode", k: str = "k", n: str = "n_cycles", run: str = "run") -> Column:
    return F.concat_ws(
        "|", dataset, mode, F.concat(F.lit("k"), F.col(k).cast("string")), F.concat(F.lit("n"), F.col(n).cast("string")), run
    )
