"""Resampling inference on sufficient statistics.

Rows are reduced to one row of sums per cluster before anything is drawn, and
replicates only recombine those sums (`replicates`). Statistics that are no function
of sums, ranks and permuted lookups, work on arrays of replicates per group where a
group's cells fit a task, and on rows per replicate beyond that.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import ratio
from ..session import shared
from .metrics import association_of_cells
from .ordering import cut_points_of, hash_positions, match, running_total
from .rank import spearman_of_cells, value_cells
from .replicates import DEALT, LABELLED, LEAF, RANGE, SIGNED, generator, replicate_sums

# Executors get this module with the plan; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Replicates per contrast, tails of a 95 % interval, comparison tolerance.
REPLICATES = 10_000
TAILS = (0.025, 0.975)
TOLERANCE = 1e-12
#: Buckets of [0, 1] that a family of p-values is ranked in.
P_CELLS = 4096
#: Distinct pairs of a group, or cells of a dataset, up to which replicates are arrays in a task; replicates of such a task.
CELLS = 1 << 16
REPLICATE_BLOCK = 500
#: Counts of profiles that a node of permuted units holds at once.
PROFILES_HELD = 1 << 20


def interval(df: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Percentile interval over replicates; undefined replicates are left out."""
    ends = F.percentile(value, F.array(*[F.lit(t) for t in TAILS]))
    return df.groupBy(*by).agg(F.count(value).alias("replicates"), ends.alias("_e")).select(
        *by, "replicates", F.col("_e")[0].alias("lo"), F.col("_e")[1].alias("hi")
    )


def rank_replicates(x: np.ndarray, y: np.ndarray, n: np.ndarray, draw: np.random.Generator, b: int) -> np.ndarray:
    """Spearman's rho of b resamples of value pairs (sorted by x) that occur n times; 0 where a side has no variation."""
    out = np.zeros(b)
    total = int(n.sum())
    middle = (total + 1) / 2
    sides = [np.unique(v, return_inverse=True)[1] for v in (x, y)]
    orders = [np.argsort(side, kind="stable") for side in sides]
    starts = [np.flatnonzero(np.diff(side[order], prepend=-1)) for side, order in zip(sides, orders, strict=True)]
    rows = max(1, (1 << 20) // len(n))
    for at in range(0, b, rows):
        w = draw.multinomial(total, n / total, min(rows, b - at)).astype(np.float64)
        ranks = []
        for side, order, start in zip(sides, orders, starts, strict=True):
            ties = np.add.reduceat(w[:, order], start, axis=1)
            ranks.append((np.cumsum(ties, axis=1) - (ties - 1) / 2 - middle)[:, side])
        xx, yy, xy = ((w * p * q).sum(axis=1) for p, q in ((ranks[0], ranks[0]), (ranks[1], ranks[1]), ranks))
        defined = (xx > 0) & (yy > 0)
        out[at : at + len(w)][defined] = (xy / np.sqrt(np.where(defined, xx * yy, 1.0)))[defined]
    return out


def cluster_sums(df: DataFrame, by: Sequence[str], cluster: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*by, *cluster).agg(*[F.sum(c).cast("double").alias(c) for c in columns])


def cluster_bootstrap(
    df: DataFrame, by: Sequence[str], cluster: Sequence[str], columns: Sequence[str], statistic: Column, b: int = REPLICATES, seed="boot"
) -> DataFrame:
    """Interval of a statistic of sums, resampling whole clusters.

    `statistic` is an expression over the summed `columns`, e.g. hits / n.
    """
    by = list(by)
    sums = cluster_sums(df, by, cluster, columns)
    each = replicate_sums(sums, by, cluster, columns, b, seed)
    return interval(each.withColumn("value", statistic), by)


def estimate(df: DataFrame, by: Sequence[str], columns: Sequence[str], statistic: Column) -> DataFrame:
    return df.groupBy(*by).agg(*[F.sum(c).cast("double").alias(c) for c in columns]).select(*by, statistic.alias("estimate"))


def widest(first: DataFrame, second: DataFrame, by: Sequence[str]) -> DataFrame:
    """The wider of two intervals: smallest lower and largest upper end."""
    by = list(by)
    both = first.select(*by, "lo", "hi").unionByName(second.select(*by, "lo", "hi"))
    return both.groupBy(*by).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def bootstrap_association(
    df: DataFrame, by: Sequence[str], cluster: Sequence[str], a: str, c: str, b: int = REPLICATES, seed="boot"
) -> DataFrame:
    """Interval of Cramér's V, resampling clusters; a cluster's statistic is its contingency cells."""
    by, cluster = list(by), list(cluster)
    cells = df.groupBy(*by, *cluster, a, c).agg(F.count(F.lit(1)).alias("c"))
    tables = replicate_sums(cells, by, cluster, ["c"], b, seed, cells=[a, c]).where("c > 0")
    each = association_of_cells(tables, [*by, "b"], a, c)
    return interval(each.withColumn("value", F.col("cramers_v")), by)


def bootstrap_rank_ci(
    df: DataFrame, by: Sequence[str], key: Sequence[str], x: str, y: str, b: int = REPLICATES, seed="rank"
) -> DataFrame:
    """Interval of Spearman's rho under resampling of rows; a replicate without variation counts as 0.

    A row is drawn by drawing its pair of values. The order of distinct values is the
    same in every replicate, so mean ranks are running sums of multiplicities. Groups
    of more than CELLS distinct pairs are ranked anew per replicate, as tables.
    """
    by = list(by)
    cells = shared(value_cells(df, by, x, y))
    sizes = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("_cells"))
    parts = [_small_rank_replicates(match(cells, sizes.where(F.col("_cells") <= CELLS), by), by, x, y, b, seed)]
    if sizes.where(F.col("_cells") > CELLS).limit(1).count():
        large = match(df, sizes.where(F.col("_cells") > CELLS).drop("_cells"), by)
        items = shared(large.select(*dict.fromkeys([*by, *key, x, y])))
        both = cut_points_of(items, [x, y])
        drawn = replicate_sums(items.withColumn("_w", F.lit(1.0)), by, key, ["_w"], b, seed, cells=[x, y], span=64).where("_w > 0")
        drawn = drawn.withColumn("_w", F.col("_w").cast("long"))
        rho = spearman_of_cells(drawn, [*by, "b"], x, y, (both[x], both[y]))
        parts.append(rho.select(*by, F.coalesce("rho", F.lit(0.0)).alias("value")))
    return interval(reduce(DataFrame.unionByName, parts), by)


def _small_rank_replicates(cells: DataFrame, by: list[str], x: str, y: str, b: int, seed) -> DataFrame:
    """(by…, value): rho of every replicate, a block of replicates of a group at a time."""
    blocks = -(-b // REPLICATE_BLOCK)
    rows = cells.select(
        *by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), F.col("_w").cast("long").alias("_w"),
        F.xxhash64(F.lit(str(seed)), *by).alias("_key"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"),
    )
    n_by, step = len(by), REPLICATE_BLOCK

    def one_block(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["_x", "_y"])
        block = int(part["_block"].iloc[0])
        value = rank_replicates(
            part["_x"].to_numpy(), part["_y"].to_numpy(), part["_w"].to_numpy(),
            generator(int(part["_key"].iloc[0]), block, 1), min(step, b - block * step),
        )
        frame = pd.DataFrame({name: [k] * len(value) for name, k in zip(by, keys[:n_by], strict=True)}, index=range(len(value)))
        return frame.assign(value=value)

    schema = rows.select(*by, F.lit(0.0).alias("value")).schema
    return rows.groupBy(*by, "_block").applyInPandas(one_block, schema)


def bootstrap_pearson_ci(
    df: DataFrame, by: Sequence[str], key: Sequence[str], x: str, y: str, b: int = REPLICATES, seed="pearson"
) -> DataFrame:
    """Interval of Pearson's r; replicates without variation are skipped.

    Values are centred on their group's means, so sums of squares keep their digits.
    """
    by = list(by)
    whole = df.select(*dict.fromkeys([*by, *key, x, y])).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    means = whole.groupBy(*by).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"))
    u, v = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    sums = {"_n": F.lit(1.0), "_u": u, "_v": v, "_uu": u * u, "_vv": v * v, "_uv": u * v}
    rows = match(whole, means, by).select(*by, *key, *[c.alias(n) for n, c in sums.items()])
    each = replicate_sums(rows, by, key, list(sums), b, seed)

    def spread(one: str, two: str, square: str) -> Column:
        return F.col(square) - F.col(one) * F.col(two) / F.col("_n")

    varies = (spread("_u", "_u", "_uu") > F.col("_uu") * TOLERANCE) & (spread("_v", "_v", "_vv") > F.col("_vv") * TOLERANCE)
    r = spread("_u", "_v", "_uv") / F.sqrt(spread("_u", "_u", "_uu") * spread("_v", "_v", "_vv"))
    return interval(each.select(*by, F.when(varies, r).alias("value")), by)


def stratified_bootstrap(
    df: DataFrame, stratum: str, key: Sequence[str], columns: Sequence[str], statistics: dict[str, Column], b: int = REPLICATES, seed="strata"
) -> DataFrame:
    """Intervals of statistics of weighted sums, resampling rows within strata."""
    drawn = replicate_sums(df.select(stratum, *key, *columns), [stratum], key, columns, b, seed)
    sums = drawn.groupBy("b").agg(*[F.sum(c).alias(c) for c in columns])
    cells = [F.struct(F.lit(n).alias("figure"), s.cast("double").alias("value")) for n, s in statistics.items()]
    return interval(sums.select(F.inline(F.array(*cells))), ["figure"])


# ------------------------------------------------------------------ permutation
def hits_to_p(df: DataFrame, by: Sequence[str], value: str = "value", observed: str = "observed", two_sided: bool = True) -> DataFrame:
    """p = (replicates at least as extreme + 1) / (replicates + 1)."""
    v, o = F.col(value), F.col(observed)
    extreme = F.abs(v) >= F.abs(o) - TOLERANCE if two_sided else v >= o - TOLERANCE
    agg = df.groupBy(*by).agg(
        F.max(observed).alias("observed"), F.count(F.lit(1)).alias("permutations"), F.count_if(extreme).alias("hits")
    )
    return agg.withColumn("p", (F.col("hits") + 1) / (F.col("permutations") + 1))


def permute_sensors(df: DataFrame, by: Sequence[str], sensor: str, flagged: Sequence[str], every: Sequence[str], hit: str) -> DataFrame:
    """Exact test of flagged against other sensors: all relabellings with as many flagged sensors.

    `every` is the fixed list of sensors. Each group becomes one row of counts per
    sensor, and the relabellings are numbers generated next to it.
    """
    by, names = list(by), sorted(every)
    flagged = set(flagged)
    m = sum(x in flagged for x in names)
    counts = [F.count_if(F.col(sensor) == x).cast("double").alias(f"_n{i}") for i, x in enumerate(names)]
    hits = [
        F.coalesce(F.sum(F.when(F.col(sensor) == x, F.col(hit).cast("double"))), F.lit(0.0)).alias(f"_h{i}")
        for i, x in enumerate(names)
    ]
    # a relabelling is a number whose set bits are the flagged sensors; its halves are spread in turn
    low = len(names) // 2
    high = F.sequence(F.lit(0).cast("long"), F.lit((1 << (len(names) - low)) - 1).cast("long"))
    rest = F.sequence(F.lit(0).cast("long"), F.lit((1 << low) - 1).cast("long"))
    whole = df.groupBy(*by).agg(*counts, *hits).withColumn("_high", F.explode(high))
    fits = F.filter(rest, lambda x: F.bit_count(x) + F.bit_count("_high") == m)
    tried = whole.withColumn("labels", F.explode(F.transform(fits, lambda x: F.shiftleft("_high", low) + x)))

    def gap(inside: list[Column]) -> Column:
        def rate(side: list[Column]) -> Column:
            pick = lambda c: sum((F.when(x, F.col(f"_{c}{i}")).otherwise(0.0) for i, x in enumerate(side)), F.lit(0.0))
            return ratio(pick("h"), pick("n"))

        return rate(inside) - rate([~x for x in inside])

    each = tried.select(
        *by,
        gap([F.getbit("labels", F.lit(i)) == 1 for i in range(len(names))]).alias("value"),
        gap([F.lit(x in flagged) for x in names]).alias("observed"),
    )
    extreme = F.abs(F.col("value")) >= F.abs(F.col("observed")) - TOLERANCE
    return each.groupBy(*by).agg(
        F.max("observed").alias("observed"), F.count("value").alias("permutations"), F.count_if(extreme).alias("hits")
    ).withColumn("p", ratio("hits", "permutations")).withColumn("floor_p", F.lit(1.0 / math.comb(len(names), m)))


def permute_labels(
    df: DataFrame, by: Sequence[str], item: str, label: str, hit: str, b: int = REPLICATES, seed="labels"
) -> DataFrame:
    """Test of a label that belongs to whole items (a template per configuration), shuffling it between items.

    `label` is boolean. The statistic is the hit-rate gap between labelled and other rows.
    """
    by = list(by)
    items = df.groupBy(*by, item).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.col(hit).cast("double")).alias("h"), F.max(label).alias("_lab")
    )
    items = shared(items)
    sums = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0.0))
    lab = F.col("_lab")
    observed = items.groupBy(*by).agg(
        (ratio(sums("h", lab), sums("n", lab)) - ratio(sums("h", ~lab), sums("n", ~lab))).alias("observed"),
        F.sum("n").alias("_n"), F.sum("h").alias("_h"),
    )
    moved = match(replicate_sums(items, by, [item], ["n", "h"], b, seed, LABELLED, label="_lab"), observed, by)
    other = ratio(F.col("_h") - F.col("h"), F.col("_n") - F.col("n"))
    return hits_to_p(moved.withColumn("value", ratio("h", "n") - other), by)


def unit_permutations(units: DataFrame, b: int, seed, block: str = "dataset", unit: str = "unit") -> DataFrame:
    """(block, b, unit) → another unit of the same block, a permutation for every b."""
    base = shared(hash_positions(shared(units.select(block, unit).distinct()), [block], [unit], seed, "_pos"))
    rows = base.drop("_pos").withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(b))))
    shuffled = hash_positions(rows, [block, "b"], ["b", unit], seed, "_pos")
    target = base.withColumnRenamed(unit, "swapped")
    return match(shuffled, target, [block, "_pos"]).select(block, "b", unit, "swapped")


def missing_cells(claims: DataFrame, full: DataFrame, on: Sequence[str], block: str = "dataset", unit: str = "unit") -> DataFrame:
    """Cells a permutation may look up that the full table does not have; must be empty."""
    needed = claims.select(block, *on).distinct().join(full.select(block, unit).distinct(), block)
    return needed.join(full, [block, unit, *on], "left_anti")


def permute_units(
    claims: DataFrame, full: DataFrame, on: Sequence[str], by: Sequence[str], a: str, c: str, b: int = REPLICATES, seed="units"
) -> DataFrame:
    """Is the stated direction tied to the unit's own window? Units trade windows within their dataset.

    `full` has the shown direction of every (dataset, unit, *on), claim or not,
    so each permuted lookup finds its cell. Claims enter as counts.
    """
    by, on = list(by), list(on)
    cells = shared(claims.groupBy(*dict.fromkeys(["dataset", "unit", *on, *by, a])).agg(F.count(F.lit(1)).alias("k")))
    full = shared(full.select("dataset", "unit", *on, c))
    sizes = full.groupBy("dataset").agg(F.count(F.lit(1)).alias("_cells"))
    small, large = (sizes.where(w).select("dataset") for w in (F.col("_cells") <= CELLS, F.col("_cells") > CELLS))
    parts = [_small_lookups(cells.join(small, "dataset"), full.join(small, "dataset"), on, by, a, c, b, seed)]
    if large.limit(1).count():
        parts.append(_large_lookups(cells.join(large, "dataset"), full.join(large, "dataset"), on, by, a, c, b, seed))
    tables = reduce(DataFrame.unionByName, parts).groupBy(*by, "b", a, c).agg(F.sum("c").alias("c"))
    each = association_of_cells(tables, [*by, "b"], a, c).select(*by, "b", F.col("cramers_v").alias("value"))
    observed = (
        association_of_cells(claims.groupBy(*by, a, c).agg(F.count(F.lit(1)).alias("c")), by, a, c)
        .where(F.col("cramers_v").isNotNull())
        .select(*by, F.col("cramers_v").alias("observed"))
    )
    return hits_to_p(match(each, observed, by), by, two_sided=False)


def _small_lookups(cells: DataFrame, full: DataFrame, on: list[str], by: list[str], a: str, c: str, b: int, seed) -> DataFrame:
    """(by…, b, a, c, c): counts of stated and looked-up direction, a block of permutations of a dataset at a time."""
    blocks = F.explode(F.sequence(F.lit(0), F.lit(-(-b // REPLICATE_BLOCK) - 1))).alias("_block")
    step = REPLICATE_BLOCK

    def one_block(keys: tuple, claimed: pd.DataFrame, shown: pd.DataFrame) -> pd.DataFrame:
        block = int(keys[1])
        units = np.sort(shown["unit"].unique())
        place = shown.groupby(on, dropna=False).ngroup()
        kinds, looked = pd.factorize(shown[c], use_na_sentinel=True)
        grid = np.full((place.max() + 1, len(units)), -1)
        grid[place, np.searchsorted(units, shown["unit"])] = kinds
        rows = claimed.merge(shown[on].assign(_place=place).drop_duplicates(), on=on)
        rows = rows[rows["unit"].isin(units)]
        group = rows.groupby([*by, a], dropna=False, sort=False).ngroup().to_numpy()
        names = rows[[*by, a]].iloc[np.unique(group, return_index=True)[1]].reset_index(drop=True)
        own, line = np.searchsorted(units, rows["unit"]), rows["_place"].to_numpy()
        k, width = rows["k"].to_numpy(np.float64), len(looked)
        draw, out = generator(int(claimed["_key"].iloc[0]) if len(claimed) else 0, block, 2), []
        for r in range(block * step + 1, min(b, (block + 1) * step) + 1):
            seen = grid[line, draw.permutation(len(units))[own]]
            there = seen >= 0
            count = np.bincount(group[there] * width + seen[there], k[there], len(names) * width)
            full_ = np.flatnonzero(count)
            out.append(names.iloc[full_ // width].assign(b=r, **{c: looked[full_ % width]}, c=count[full_]))
        made = pd.concat(out) if out and len(names) else pd.DataFrame(columns=schema.names)
        return made[schema.names]

    of = {f.name: f for f in [*cells.schema, *full.schema]}
    schema = T.StructType([*[of[x] for x in by], T.StructField("b", T.LongType()), of[a], of[c], T.StructField("c", T.DoubleType())])
    left = cells.select("*", F.xxhash64(F.lit(str(seed)), "dataset").alias("_key"), blocks)
    right = full.select("*", blocks)
    return left.groupBy("dataset", "_block").cogroup(right.groupBy("dataset", "_block")).applyInPandas(one_block, schema)


def deal_profiles(key: int, size: int, counts: np.ndarray, b: int, first: int, last: int) -> Iterator[tuple[int, int, slice, np.ndarray]]:
    """(lo, hi, replicates, profile at each position from lo to hi - 1): `counts` profiles in random order over 0 to size - 1.

    The tree of `replicates.nodes` for several labels: a node knows how many of each
    profile fall into its range, a small one deals them. Only nodes that meet first to last - 1 are shown.
    """
    step = max(1, PROFILES_HELD // len(counts))
    for at in range(0, b, step):
        stack = [(0, size, np.tile(counts, (min(step, b - at), 1)))]
        while stack:
            lo, hi, held = stack.pop()
            if hi <= first or lo >= last:
                continue
            draw = generator(key + at, lo, hi)
            if hi - lo > LEAF:
                mid = (lo + hi) // 2
                left, need, others = np.empty_like(held), np.full(len(held), mid - lo), np.full(len(held), hi - lo)
                for i in range(held.shape[1]):
                    others = others - held[:, i]
                    left[:, i] = draw.hypergeometric(held[:, i], others, need)
                    need = need - left[:, i]
                stack += [(mid, hi, held - left), (lo, mid, left)]
                continue
            some = max(1, DEALT // (hi - lo))
            for i in range(0, len(held), some):
                part = held[i : i + some]
                one = np.repeat(np.tile(np.arange(part.shape[1]), len(part)), part.reshape(-1)).reshape(len(part), hi - lo)
                yield lo, hi, slice(at + i, at + i + len(part)), draw.permuted(one, axis=1)


def _large_lookups(cells: DataFrame, full: DataFrame, on: list[str], by: list[str], a: str, c: str, b: int, seed) -> DataFrame:
    """The same for datasets of any size, a range of units at a time.

    What a claim finds at another unit depends on that unit's profile only: its
    directions in the group's cells. A permutation of units deals the dataset's
    profiles, counted by value, over its units in random order. Groups told apart by
    columns of `on` are dealt independently, since each has its own test.
    """
    split = [x for x in by if x in on]
    rest = [x for x in on if x not in split]
    key, more = ["dataset", *split], [x for x in by if x not in on]
    units = shared(full.select("dataset", "unit").distinct())
    numbered = hash_positions(units, ["dataset"], ["unit"], seed, "_pos", "_size")
    at = (F.col("_pos") - 1).cast("long")
    placed = match(cells, numbered, ["dataset", "unit"]).select(
        *key, *[x for x in more if x not in key], *rest, a, "k", at.alias("_at"),
        F.col("_size").cast("long").alias("_size"), F.floor(at / RANGE).cast("long").alias("_range"),
    )
    placed = shared(placed)
    shown = full.groupBy(*key, "unit").agg(F.array_sort(F.collect_list(F.struct(*rest, c))).alias("_seen"))
    every = match(units, full.select(*key).distinct(), ["dataset"])
    classes = match(every, shown, [*key, "unit"], "left").groupBy(*key, "_seen").agg(F.count(F.lit(1)).alias("_n"))
    name = F.coalesce(F.to_json("_seen", {"ignoreNullFields": "false"}), F.lit("")).alias("_class")
    flat = classes.select(*key, "_n", name, F.explode_outer("_seen").alias("_s"))
    flat = flat.select(*key, "_n", "_class", F.col("_s").isNotNull().alias("_there"), *[F.col("_s")[x].alias(x) for x in [*rest, c]])
    ranges = placed.select(*[F.col(x).alias(x) for x in (*key, "_range", "_size")]).distinct()
    right = match(ranges, flat, key).withColumn("_key", F.xxhash64(F.lit(str(seed)), *key))

    def one_range(keys: tuple, claimed: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(claimed) or not len(known):
            return pd.DataFrame(columns=schema.names)
        first = int(keys[-1]) * RANGE
        size, seeded = int(known["_size"].iloc[0]), int(known["_key"].iloc[0])
        profile, names = pd.factorize(known["_class"], sort=True)
        counts = np.zeros(len(names), np.int64)
        counts[profile] = known["_n"]
        known, profile = known[known["_there"]], profile[known["_there"].to_numpy(bool)]
        kinds, looked = pd.factorize(known[c], use_na_sentinel=True)
        place = known.groupby(rest, dropna=False).ngroup().to_numpy() if rest else np.zeros(len(known), np.int64)
        if not len(looked):
            return pd.DataFrame(columns=schema.names)
        grid = np.full((len(counts), place.max() + 1), -1)
        grid[profile, place] = kinds
        if rest:
            rows = claimed.merge(known[rest].assign(_place=place).drop_duplicates(), on=rest)
        else:
            rows = claimed.assign(_place=0)
        if not len(rows):
            return pd.DataFrame(columns=schema.names)
        rows = rows.sort_values("_at", kind="stable").reset_index(drop=True)
        group = rows.groupby([*by, a], dropna=False, sort=False).ngroup().to_numpy()
        labels = rows[[*by, a]].iloc[np.unique(group, return_index=True)[1]].reset_index(drop=True)
        own, line, k = rows["_at"].to_numpy(), rows["_place"].to_numpy(), rows["k"].to_numpy(np.float64)
        total, width = np.zeros((b, len(labels) * len(looked))), len(labels) * len(looked)
        for lo, hi, replicates, dealt in deal_profiles(seeded, size, counts, b, first, min(size, first + RANGE)):
            mine = slice(*np.searchsorted(own, [lo, hi]))
            seen = grid[dealt[:, own[mine] - lo], line[mine]]
            cell = np.arange(len(seen))[:, None] * width + group[mine] * len(looked) + seen
            there = seen >= 0
            amount = np.broadcast_to(k[mine], seen.shape)[there]
            total[replicates] += np.bincount(cell[there], amount, len(seen) * width).reshape(-1, width)
        replicate, cell = np.nonzero(total)
        out = labels.iloc[cell // len(looked)].assign(b=replicate + 1, **{c: np.asarray(looked)[cell % len(looked)]}, c=total[replicate, cell])
        return out[schema.names]

    of = {f.name: f for f in [*cells.schema, *full.schema]}
    schema = T.StructType([*[of[x] for x in by], T.StructField("b", T.LongType()), of[a], of[c], T.StructField("c", T.DoubleType())])
    left = placed.drop("_size")
    return left.groupBy(*key, "_range").cogroup(right.groupBy(*key, "_range")).applyInPandas(one_range, schema)


def sign_flip(df: DataFrame, by: Sequence[str], cluster: Sequence[str], diff: str, b: int = REPLICATES, seed="flip") -> DataFrame:
    """Test that a paired difference is zero: whole clusters change sign together."""
    by, cluster = list(by), list(cluster)
    sums = shared(df.groupBy(*by, *cluster).agg(F.sum(diff).cast("double").alias("_s"), F.count(diff).alias("_n")))
    whole = sums.groupBy(*by).agg(F.sum("_n").alias("_n"), (F.sum("_s") / F.sum("_n")).alias("observed"))
    each = match(replicate_sums(sums, by, cluster, ["_s"], b, seed, SIGNED), whole, by)
    return hits_to_p(each.withColumn("value", F.col("_s") / F.col("_n")), by)


# ------------------------------------------------------------------ multiplicity
def adjust_pvalues(df: DataFrame, by: Sequence[str], p: str, alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg and Bonferroni p-values within a family; undefined p-values stay outside the family.

    Everything depends on the p-value only, so a family is first counted by value.
    Ranks are running totals over buckets of [0, 1]; the smallest later p·m/i comes
    from the values after it in its bucket and from the minima of later buckets. No
    family has to fit into one task.
    """
    by = list(by)
    values = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count(F.lit(1)).alias("_w"))
    values = values.withColumn("_cell", F.floor(F.col(p) * P_CELLS).cast("long"))
    ranked = running_total(values, by, "_cell", [p], F.col("_w"), "_before", "_m")
    ranked = ranked.withColumn("_q", F.col(p) * F.col("_m") / (F.col("_before") + F.col("_w")))
    inside = Window.partitionBy(*by, "_cell").orderBy(p).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = ranked.withColumn("_here", F.min("_q").over(inside))
    behind = Window.partitionBy(*by).orderBy("_cell").rowsBetween(1, Window.unboundedFollowing)
    later = ranked.groupBy(*by, "_cell").agg(F.min("_q").alias("_least"))
    later = later.select(*by, "_cell", F.min("_least").over(behind).alias("_later"))
    done = match(ranked, later, [*by, "_cell"]).select(
        *by, p, F.least(F.lit(1.0), "_here", "_later").alias("p_bh"), F.least(F.lit(1.0), F.col(p) * F.col("_m")).alias("p_bonferroni")
    )
    return match(df, done, [*by, p], "left").withColumns(
        {
            "significant_raw": F.col(p) < alpha,
            "significant_bh": F.col("p_bh") < alpha,
            "significant_bonferroni": F.col("p_bonferroni") < alpha,
        }
    )


def with_and_without(df: DataFrame, flag: str, out: str = "set") -> DataFrame:
    """Every row in set 'all', unflagged rows also in set 'unflagged': one pass feeds both analyses."""
    sets = F.when(F.col(flag), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("unflagged")))
    return df.withColumn(out, F.explode(sets))
