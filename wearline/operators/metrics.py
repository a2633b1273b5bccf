"""Error, no-skill and concentration metrics of prediction tables (one row per config and unit)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..functions.numeric import RUL_CAP, asymmetric_penalty, mean_flag, percent, ratio, to_grid
from ..functions import tails
from ..session import shared
from .ordering import match


def _errors(pred: str = "pred", truth: str = "truth", weight: str | None = None) -> list[Column]:
    e = F.col(pred) - F.col(truth)
    if weight is None:
        return [
            F.sqrt(F.avg(e * e)).alias("rmse"),
            F.avg(F.abs(e)).alias("mae"),
            F.sum(asymmetric_penalty(e)).alias("score"),
        ]
    w = F.col(weight)
    return [
        F.sqrt(F.sum(w * e * e) / F.sum(w)).alias("rmse"),
        (F.sum(w * F.abs(e)) / F.sum(w)).alias("mae"),
        F.sum(w * asymmetric_penalty(e)).alias("score"),
    ]


def error_metrics(df: DataFrame, by: Sequence[str], pred: str = "pred", truth: str = "truth") -> DataFrame:
    """RMSE, MAE and asymmetric score: one partial aggregation, no matter how skewed the groups.

    n counts the rows that have both values.
    """
    both = F.col(pred).isNotNull() & F.col(truth).isNotNull()
    return df.where(both).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *_errors(pred, truth))


def truth_counts(test: DataFrame, by: Sequence[str] = ("dataset",), truth: str = "truth") -> DataFrame:
    """Labels counted by value. Capped integer labels leave at most cap + 1 rows per group."""
    return test.groupBy(*by, F.col(truth).cast("double").alias("truth")).agg(F.count(F.lit(1)).alias("w"))


# ------------------------------------------------------------------ no-skill baselines
def constant_baselines(train: DataFrame, test: DataFrame, cap: float = RUL_CAP, fixed: float = 50.0) -> DataFrame:
    """Metrics of the constants a forecaster without skill would state.

    Train mean and median, test mean and median (an oracle), a fixed guess and half the cap.
    `train` has (dataset, rul), `test` has (dataset, truth), both capped whole numbers. Everything is
    computed from label counts: at most cap + 1 values per dataset.
    """
    tr, te = shared(truth_counts(train, truth="rul")), shared(truth_counts(test))
    by = ["dataset"]

    def mean(c: DataFrame, name: str) -> DataFrame:
        return c.groupBy(*by).agg((F.sum(F.col("truth") * F.col("w")) / F.sum("w")).alias(name))

    def median(c: DataFrame, name: str) -> DataFrame:
        return c.groupBy(*by).agg(F.percentile("truth", F.lit(0.5), F.col("w")).alias(name))

    fits = (
        mean(tr, "train_mean")
        .join(median(tr, "train_median"), by)
        .join(mean(te, "test_mean"), by)
        .join(median(te, "test_median"), by)
    )
    names = ["train_mean", "train_median", "test_mean", "test_median"]
    cells = [F.struct(F.lit(n).alias("baseline"), F.col(n).alias("constant")) for n in names]
    cells.append(F.struct(F.lit("fixed").alias("baseline"), F.lit(float(fixed)).alias("constant")))
    cells.append(F.struct(F.lit("half_cap").alias("baseline"), F.lit(cap / 2.0).alias("constant")))
    constants = fits.select(*by, F.inline(F.array(*cells)))
    return te.join(constants, by).groupBy(*by, "baseline", "constant").agg(F.sum("w").alias("n"), *_errors("constant", "truth", "w"))


def best_constant(test: DataFrame, metric: Column | str, cap: int = RUL_CAP, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Best constant of the grid 0..cap; the smallest constant wins a tie.

    `metric` is 'rmse', 'mae', 'score' or any aggregate over columns constant, truth and w.
    """
    named = {"rmse": 0, "mae": 1, "score": 2}
    value = _errors("constant", "truth", "w")[named[metric]] if isinstance(metric, str) else metric
    grid = F.explode(F.sequence(F.lit(0), F.lit(cap))).alias("c")
    tried = truth_counts(test, by).select(*by, "truth", "w", grid).withColumn("constant", F.col("c").cast("double"))
    scored = tried.groupBy(*by, "constant").agg(value.alias("value"))
    best = F.min(F.struct("value", "constant")).alias("b")
    return scored.groupBy(*by).agg(best).select(*by, F.col("b.constant").alias("constant"), F.col("b.value").alias("value"))


def random_baseline(test: DataFrame, key: Sequence[str], draws: int = 1000, cap: int = RUL_CAP, seed="random", by=("dataset",)) -> DataFrame:
    """Uniform predictions in 0..cap: the mean over draws of each draw's metrics.

    Draws are made on the fly next to each row and aggregated per draw before the shuffle.
    """
    rows = test.select(*by, *key, "truth", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    rows = rows.withColumn("pred", F.floor(uniform(seed, F.col("draw"), *[F.col(k) for k in key]) * (cap + 1)).cast("double"))
    each = rows.groupBy(*by, "draw").agg(*_errors())
    return each.groupBy(*by).agg(
        F.count(F.lit(1)).alias("draws"), F.avg("rmse").alias("rmse"), F.avg("mae").alias("mae"), F.avg("score").alias("score")
    )


def beats_constant(metrics: DataFrame, baselines: DataFrame, baseline: str = "train_mean") -> DataFrame:
    """Does a configuration beat the constant? Both tables hold one row per configuration or constant."""
    base = baselines.where(F.col("baseline") == baseline).select("dataset", F.col("rmse").alias("constant_rmse"))
    return metrics.join(base, "dataset", "left").withColumn("beats_constant", F.col("rmse") < F.col("constant_rmse"))


def constant_error_parts(test: DataFrame, constant: float, by: Sequence[str] = ("dataset",)) -> DataFrame:
    """MSE of a constant = variance of the labels + squared bias."""
    bias = F.avg("truth") - F.lit(float(constant))
    return test.groupBy(*by).agg(
        F.var_pop("truth").alias("variance"),
        (bias * bias).alias("bias2"),
        (F.var_pop("truth") + bias * bias).alias("mse"),
        F.avg((F.col("truth") - constant) * (F.col("truth") - constant)).alias("mse_direct"),
    )


# ------------------------------------------------------------------ concentration and dispersion
def value_frequencies(df: DataFrame, by: Sequence[str], value: str = "pred", grid: float | None = None) -> DataFrame:
    v = to_grid(value, grid) if grid else F.col(value)
    return df.where(F.col(value).isNotNull()).groupBy(*by, v.alias("value")).agg(F.count(F.lit(1)).alias("count"))


def concentration(df: DataFrame, by: Sequence[str], value: str = "pred", grid: float | None = None) -> DataFrame:
    """Distinct values, the most frequent one (smallest on ties), its share, entropy and its ceiling.

    Two aggregations by (group, value) and by group; neither ever holds a group's rows.
    """
    return concentration_of(value_frequencies(df, by, value, grid), by)


def concentration_of(freq: DataFrame, by: Sequence[str]) -> DataFrame:
    """The same from rows counted by value (columns `value` and `count`)."""
    per = freq.groupBy(*by).agg(
        F.sum("count").alias("n"),
        F.count(F.lit(1)).alias("distinct_values"),
        F.min(F.struct((-F.col("count")).alias("c"), F.col("value").alias("v"))).alias("_top"),
        F.sum(F.col("count") * F.log2(F.col("count").cast("double"))).alias("_clog"),
    )
    n = F.col("n").cast("double")
    # sum(-c/n log2(c/n)) = log2(n) - sum(c log2 c)/n
    entropy = F.when(F.col("distinct_values") == 1, F.lit(0.0)).otherwise(F.log2(n) - F.col("_clog") / n)
    return per.select(
        *by,
        "n",
        "distinct_values",
        F.col("_top.v").alias("modal_value"),
        percent(-F.col("_top.c"), "n").alias("modal_share_pct"),
        entropy.alias("entropy_bits"),
        F.log2(n).alias("entropy_max"),
        ratio(entropy, F.log2(n)).alias("entropy_ratio"),
    )


def top_values(df: DataFrame, by: Sequence[str], k: int, value: str = "pred") -> DataFrame:
    """The k most frequent values of each group, with their rank."""
    w = Window.partitionBy(*by).orderBy(F.col("count").desc(), "value")
    ranked = value_frequencies(df, by, value).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.withColumn("rank", F.col("rank").cast("long"))


def dispersion(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg("pred").alias("pred_mean"),
        F.stddev_samp("pred").alias("pred_sd"),
        F.avg("truth").alias("truth_mean"),
        F.stddev_samp("truth").alias("truth_sd"),
        ratio(F.stddev_samp("pred"), F.stddev_samp("truth")).alias("sd_ratio"),
    )


def is_degenerate(df: DataFrame, by: Sequence[str], value: str = "pred", tolerance: float = 1e-3) -> DataFrame:
    """A predictor whose range is below the tolerance has no rank information."""
    span = F.max(value) - F.min(value)
    return df.groupBy(*by).agg(span.alias("range"), (span < tolerance).alias("degenerate"))


def score_models(df: DataFrame, by: Sequence[str] = ("dataset", "model")) -> DataFrame:
    """Several predictors in long form: errors, range, distinct values on 3 decimals, rank correlation.

    The rank correlation is null for a degenerate predictor.
    """
    from .rank import spearman

    by = list(by)
    base = df.where(F.col("pred").isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *_errors(), (F.max("pred") - F.min("pred")).alias("range")
    )
    seen = df.groupBy(*by, F.round("pred", 3).alias("v")).agg(F.lit(1)).groupBy(*by).agg(F.count("v").alias("distinct_3dp"))
    rho = spearman(df, by, "pred", "truth").select(*by, "rho")
    out = match(match(base, seen, by), rho, by, "left")
    return out.withColumn("rho", F.when(F.col("range") >= 1e-3, F.col("rho")))


# ------------------------------------------------------------------ run-level summaries
def run_manifest(df: DataFrame, by: Sequence[str], text: str) -> DataFrame:
    """One row per run: errors, concentration, means, and how much text came with the predictions."""
    by = list(by)
    base = df.groupBy(*by).agg(
        *_errors(),
        F.avg("pred").alias("pred_mean"),
        F.avg("truth").alias("truth_mean"),
        F.count_if(F.trim(F.coalesce(F.col(text), F.lit(""))) == "").alias("empty_texts"),
        F.avg(F.length(F.coalesce(F.col(text), F.lit("")))).alias("text_chars_mean"),
    )
    return match(base, concentration(df, by), by)


def manifest_totals(manifest: DataFrame, by: str) -> DataFrame:
    """Runs and responses per experiment class, with the grand total."""
    out = manifest.rollup(by).agg(F.grouping(by).alias("_g"), F.count(F.lit(1)).alias("runs"), F.sum("n").alias("responses"))
    return out.select(F.when(F.col("_g") == 1, "ALL").otherwise(F.col(by)).alias(by), "runs", "responses")


def pool_replicates(metrics: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean and range of each metric over replicate runs."""
    outs = []
    for c in columns:
        outs += [F.avg(c).alias(f"{c}_mean"), F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("runs"), *outs)


def grid_spread(metrics: DataFrame, row: Sequence[str], column: str, levels: Sequence, value: str = "rmse") -> DataFrame:
    """One row per window length with the metric at each grid level, its spread, and the best and worst level."""
    cells = [F.max(F.when(F.col(column) == v, F.col(value))).alias(f"{column}{v}") for v in levels]
    names = [f"{column}{v}" for v in levels]
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value), F.col(column)))
    best, worst = F.min(known).alias("_b"), F.max(known).alias("_w")
    wide = metrics.groupBy(*row).agg(*cells, best, worst)
    return wide.select(
        *row,
        *names,
        (F.greatest(*names) - F.least(*names)).alias("spread"),
        F.col(f"_b.{column}").alias("best"),
        F.col(f"_w.{column}").alias("worst"),
    )


def condition_variability(runs: DataFrame, by: Sequence[str], metric: str, modal: str) -> DataFrame:
    """How a metric moves over seeds, and the distinct modal values seen."""
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("seeds"),
        F.avg(metric).alias("mean"),
        F.stddev_samp(metric).alias("sd"),
        (F.max(metric) - F.min(metric)).alias("range"),
        F.array_join(F.transform(F.sort_array(F.collect_set(modal)), lambda v: v.cast("bigint").cast("string")), ",").alias("modal_values"),
    )


def distinct_list(df: DataFrame, by: Sequence[str], value: str, out: str = "value") -> DataFrame:
    """Distinct values of each group, one row per value, in ascending order."""
    return df.select(*by, F.col(value).alias(out)).distinct().orderBy(*by, out)


def parse_quality(df: DataFrame, by: Sequence[str], ok: str = "parse_ok", pred: str = "pred") -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        (mean_flag(ok) * 100).alias("parse_ok_pct"),
        F.count_if(F.col(pred).isNull()).alias("unparsed"),
    )


def select_best(metrics: DataFrame, by: Sequence[str], names: Sequence[str], key: str) -> DataFrame:
    """Best configuration per group and metric, chosen on the test set and flagged as such."""
    cells = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    long = metrics.select(*by, key, F.inline(F.array(*cells)))
    best = F.min(F.when(F.col("value").isNotNull(), F.struct("value", key))).alias("b")
    return long.groupBy(*by, "metric").agg(best).select(
        *by, "metric", F.col(f"b.{key}").alias(key), F.col("b.value").alias("value"), F.lit(True).alias("chosen_on_test")
    )


def partial_runs(metrics: DataFrame, expected: DataFrame) -> DataFrame:
    """Runs that cover fewer units than their dataset has."""
    return metrics.join(expected, "dataset").where(F.col("n") < F.col("expected")).withColumn("missing", F.col("expected") - F.col("n"))


def compare_models(*summaries: DataFrame) -> DataFrame:
    """Stack summaries with different columns."""
    out = summaries[0]
    for s in summaries[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def histogram(df: DataFrame, series: Sequence[str], low: float = 0.0, width: float = 10.0, bins: int = 13, by: Sequence[str] = ()) -> DataFrame:
    """Counts of several series on equal-width bins; the last bin includes its right edge."""
    top = low + width * bins
    cells = F.array(*[F.struct(F.lit(s).alias("series"), F.col(s).cast("double").alias("v")) for s in series])
    long = df.select(*by, F.inline(cells)).where((F.col("v") >= low) & (F.col("v") <= top))
    place = F.least(F.floor((F.col("v") - low) / width), F.lit(bins - 1)).cast("long")
    outs = [F.count_if(F.col("series") == s).alias(f"n_{s}") for s in series]
    return long.groupBy(*by, (place * width + low).alias("bin_start")).agg(*outs)


# ------------------------------------------------------------------ agreement of runs
def pair_runs(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("dataset", "unit")) -> DataFrame:
    return a.select(*keys, F.col("pred").alias("pred_a")).join(b.select(*keys, F.col("pred").alias("pred_b")), list(keys))


def run_pairs(df: DataFrame, runs: Sequence[str], keys: Sequence[str] = ("dataset", "unit"), by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Observed agreement of every pair of the named runs.

    Each unit becomes one wide row with a column per run; the pairs are
    conditional aggregates over it, so no pair rows are ever produced.
    """
    wide = df.groupBy(*keys).agg(*[F.max(F.when(F.col("run") == r, F.col("pred"))).alias(f"_{r}") for r in runs])
    pairs = [(a, b) for i, a in enumerate(runs) for b in runs[i + 1 :]]
    aggs = []
    for a, b in pairs:
        both = F.col(f"_{a}").isNotNull() & F.col(f"_{b}").isNotNull()
        aggs.append(
            F.struct(
                F.lit(a).alias("run_a"),
                F.lit(b).alias("run_b"),
                F.count_if(both).alias("units"),
                F.count_if(F.col(f"_{a}") == F.col(f"_{b}")).alias("same"),
            ).alias(f"{a}_{b}")
        )
    flat = wide.groupBy(*by).agg(*aggs)
    return flat.select(*by, F.inline(F.array(*[F.col(f"{a}_{b}") for a, b in pairs])))


def run_agreement(df: DataFrame, runs: Sequence[str], by: Sequence[str] = ("dataset",)) -> DataFrame:
    """Observed agreement, agreement expected from the value marginals, and the excess, in percent.

    Both are taken over the units that two runs share: each unit becomes one wide
    row, and each pair counts its own marginals.
    """
    by = list(by)
    observed = run_pairs(df, runs, [*by, "unit"], by).where("units > 0")
    wide = df.where(F.col("run").isin(*runs)).groupBy(*by, "unit").agg(
        *[F.max(F.when(F.col("run") == r, F.col("pred"))).alias(f"_{r}") for r in runs]
    )
    sides = []
    for i, x in enumerate(runs):
        for y in runs[i + 1 :]:
            both = F.col(f"_{x}").isNotNull() & F.col(f"_{y}").isNotNull()
            for value, first in ((x, 1), (y, 0)):
                one = F.struct(
                    F.lit(x).alias("run_a"),
                    F.lit(y).alias("run_b"),
                    F.col(f"_{value}").alias("value"),
                    F.lit(first).cast("long").alias("a"),
                    F.lit(1 - first).cast("long").alias("b"),
                )
                sides.append(F.when(both, one))
    stated = wide.select(*by, F.explode(F.array_compact(F.array(*sides))).alias("s")).select(*by, "s.*")
    per_value = stated.groupBy(*by, "run_a", "run_b", "value").agg(
        F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b")
    )
    chance = per_value.groupBy(*by, "run_a", "run_b").agg(
        (F.sum(F.col("a") * F.col("b")) / (F.sum("a") * F.sum("b"))).alias("c")
    )
    obs, exp = percent("same", "units"), F.col("c") * 100
    return match(observed, chance, [*by, "run_a", "run_b"]).select(
        *by, "run_a", "run_b", "units", obs.alias("observed_pct"), exp.alias("chance_pct"), (obs - exp).alias("excess_pct")
    )


def mean_agreement(agreement: DataFrame, by: Sequence[str] = ("dataset",)) -> DataFrame:
    return agreement.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg("observed_pct").alias("observed_pct"),
        F.avg("chance_pct").alias("chance_pct"),
        F.avg("excess_pct").alias("excess_pct"),
    )


def pred_vs_true(df: DataFrame, baselines: DataFrame, configs: Sequence[str], by: Sequence[str] = ("dataset", "unit")) -> DataFrame:
    """One row per unit: truth, every configuration's prediction, and the constant baselines of its dataset."""
    cells = [F.max(F.when(F.col("config") == c, F.col("pred"))).alias(c) for c in configs]
    wide = df.groupBy(*by).agg(F.max("truth").alias("truth"), *cells)
    consts = baselines.groupBy("dataset").agg(F.max(F.when(F.col("baseline") == "train_mean", F.col("constant"))).alias("const_train_mean"))
    return wide.join(consts, "dataset", "left")


# ------------------------------------------------------------------ association
def association(df: DataFrame, by: Sequence[str], a: str, b: str, min_n: int = 10) -> DataFrame:
    """Chi-square, Cramér's V and mutual information of two labels; null with fewer than 2 levels on a side.

    With s = Σ c²/(row·column), chi-square is n(s − 1): cells that do not occur need no completed grid.
    """
    by = list(by)
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*by, a, b).agg(F.count(F.lit(1)).alias("c"))
    return association_of_cells(cells, by, a, b).where(F.col("n") >= min_n).withColumn(
        "p", tails.chi_square_upper(F.col("chi2"), (F.col("rows") - 1) * (F.col("cols") - 1))
    )


def association_of_cells(cells: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """The same statistics from cell counts `c`; a group here is one small table of label pairs."""
    by = list(by)
    row = F.sum("c").over(Window.partitionBy(*by, a))
    column = F.sum("c").over(Window.partitionBy(*by, b))
    m = cells.withColumns({"_r": row.cast("double"), "_k": column.cast("double")})
    c = F.col("c").cast("double")
    per = m.groupBy(*by).agg(
        F.sum("c").alias("n"),
        F.count_distinct(a).alias("rows"),
        F.count_distinct(b).alias("cols"),
        F.sum(c * c / (F.col("_r") * F.col("_k"))).alias("_s"),
        F.sum(c * F.log2(c / (F.col("_r") * F.col("_k")))).alias("_m"),
    )
    n = F.col("n").cast("double")
    ok = (F.col("rows") >= 2) & (F.col("cols") >= 2)
    chi2 = F.when(ok, n * F.greatest(F.col("_s") - 1, F.lit(0.0)))
    return per.select(
        *by,
        "n",
        "rows",
        "cols",
        chi2.alias("chi2"),
        F.when(ok, F.sqrt(chi2 / (n * (F.least("rows", "cols") - 1)))).alias("cramers_v"),
        F.when(ok, F.col("_m") / n + F.log2(n)).alias("mi_bits"),
    )


def chi2_2x2(df: DataFrame, by: Sequence[str], a: Column, b: Column, yates: bool = True) -> DataFrame:
    """Chi-square of two yes/no columns, with continuity correction by default."""
    counts = df.groupBy(*by).agg(
        F.count_if(a & b).alias("n11"), F.count_if(a & ~b).alias("n10"), F.count_if(~a & b).alias("n01"), F.count_if(~a & ~b).alias("n00")
    )
    x = [F.col(c).cast("double") for c in ("n11", "n10", "n01", "n00")]
    n = x[0] + x[1] + x[2] + x[3]
    gap = F.abs(x[0] * x[3] - x[1] * x[2])
    # the correction never overshoots a cell's own distance from expectation
    gap = gap - F.least(n / 2.0, gap) if yates else gap
    margins = (x[0] + x[1]) * (x[2] + x[3]) * (x[0] + x[2]) * (x[1] + x[3])
    chi2 = ratio(n * gap * gap, margins)
    return counts.withColumn("chi2", chi2).withColumn("p", tails.normal_two_sided(F.sqrt("chi2")))
