"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents are cut into blocks of words. A source's target becomes an exact quota
of its blocks: whole passes over all of them, and a prefix of their random
permutation. The quotas of all sources together are then split over the output
shards by a binary tree: a node hands half of its draws to its left child, how
many of each source being a multivariate hypergeometric draw, so every shard is a
uniform sample of the mix and the quotas stay exact. Each shard takes the next
blocks of every source's permutation, disjoint from all other shards, and orders
them at random.

All draws are hashes of ids, so reruns agree. Permutations are ranked in buckets
of the hash, never in one window per source; only one row per source, and one per
tree node, are handled together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, keep

#: Buckets of a permutation: 2^14.
BUCKET_BITS = 14
HASH_BITS = 60


def words(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def hash60(*parts: Column) -> Column:
    """60 bits of the md5 of the parts' text, as a long."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _uniform(*parts: Column) -> Column:
    return hash60(*parts) / F.lit(float(1 << HASH_BITS))


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, s, source_size, target): shares of the sum of all sizes in proportion to weights.

    Sources in code-point order, null last, take the weights in turn. No target
    exceeds `most` times its source; the excess goes to the others by weight until
    none exceeds it. One row per source: `sizes` has (source, source_size).
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.lit(None)
    for i, x in enumerate(weights):
        w = F.when((F.col("s") - 1) % len(weights) == i, F.lit(float(x))).otherwise(w)
    rows = sizes.withColumn("s", F.row_number().over(turn)).withColumn("w", w.cast("double"))
    rows = rows.withColumn("cap", F.col("source_size") * most)
    fill = Window.orderBy(F.col("cap") / F.col("w"), "s")
    earlier = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(earlier), F.lit(0.0))
    level = left.cast("double") / weight
    rows = rows.withColumn("level", F.when(level <= F.col("cap") / F.col("w"), level))
    first = F.max("level").over(everything)
    return rows.select(
        "source",
        "s",
        "source_size",
        F.least(F.col("cap").cast("double"), F.col("w") * first).alias("target"),
    )


def _bind(value: Column, then) -> Column:
    """Evaluate an expression once and use it by name."""
    return F.transform(F.array(value), then)[0]


def hypergeometric(u: Column, everyone: Column, marked: Column, drawn: Column) -> Column:
    """Inverse of the distribution of marked items among `drawn` of `everyone`, at u in [0, 1).

    Outcomes are tried from the mode upwards, then downwards, with weights relative
    to the mode; those further than twelve standard deviations are left out.
    """
    rest = everyone - marked
    low, high = F.greatest(F.lit(0), drawn - rest), F.least(drawn, marked)
    mode = F.floor((drawn + 1) * ((marked + 1) / (everyone + 2))).cast("long")
    share = F.when(everyone > 0, marked / everyone).otherwise(0.0)
    spread = F.ceil(F.sqrt(drawn * share * (1 - share)) * 12).cast("long") + 12
    given = F.struct(
        u.alias("u"),
        marked.cast("double").alias("m"),
        rest.cast("double").alias("r"),
        drawn.cast("double").alias("n"),
        F.greatest(low, F.least(high, mode)).cast("long").alias("at"),
        low.cast("long").alias("low"),
        high.cast("long").alias("high"),
        spread.alias("spread"),
    )

    def walk(g: Column, up: bool, start: Column, goal: Column) -> Column:
        """Sum of the weights on one side, starting from `start`; `x` is where it passes `goal`."""
        steps = F.least(g["spread"], g["high"] - g["at"] if up else g["at"] - g["low"])
        path = F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<bigint>"))

        def step(acc: Column, i: Column) -> Column:
            x = (g["at"] + i - 1 if up else g["at"] - i + 1).cast("double")
            if up:
                ratio = (g["m"] - x) * (g["n"] - x) / ((x + 1) * (g["r"] - g["n"] + x + 1))
            else:
                ratio = x * (g["r"] - g["n"] + x) / ((g["m"] - x + 1) * (g["n"] - x + 1))
            p = acc["p"] * ratio
            now = F.when(acc["x"].isNull() & (acc["sum"] + p > goal), g["at"] + i if up else g["at"] - i)
            return F.struct(p.alias("p"), (acc["sum"] + p).alias("sum"), F.coalesce(acc["x"], now).alias("x"))

        zero = F.struct(F.lit(1.0).alias("p"), start.alias("sum"), F.lit(None).cast("long").alias("x"))
        return F.aggregate(path, zero, step)

    nowhere = F.lit(float("inf"))

    def draw(g: Column) -> Column:
        total = walk(g, False, walk(g, True, F.lit(1.0), nowhere)["sum"], nowhere)["sum"]
        return _bind(
            g["u"] * total,
            lambda goal: F.when(goal < 1.0, g["at"]).otherwise(
                _bind(
                    walk(g, True, F.lit(1.0), goal),
                    lambda side: F.coalesce(side["x"], walk(g, False, side["sum"], goal)["x"], g["at"]),
                )
            ),
        )

    return _bind(given, draw)


def split_quotas(quotas: DataFrame, levels: int, seed: int = 0) -> DataFrame:
    """(s, shard, n): the exact quotas (s, quota) dealt over 2^levels shards.

    A node's draws are halved, the left child taking the smaller half; what it
    takes of each source is drawn conditionally on the sources before.
    """
    sources = F.sort_array(F.collect_list(F.struct("s", F.col("quota").cast("long").alias("n"))))
    nodes = quotas.agg(sources.alias("counts")).select(F.lit(0).cast("long").alias("shard"), "counts")
    for level in range(levels):
        total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c["n"])

        at = F.lit(level)

        def split(state: Column, c: Column) -> Column:
            u = _uniform(F.lit(seed), at, F.col("shard"), c["s"])  # noqa: B023
            x = F.when(
                (c["n"] > 0) & (state["draw"] > 0), hypergeometric(u, state["all"], c["n"], state["draw"])
            ).otherwise(F.lit(0).cast("long"))
            return _bind(
                x,
                lambda x: F.struct(
                    (state["all"] - c["n"]).alias("all"),
                    (state["draw"] - x).alias("draw"),
                    F.array_append(state["left"], x).alias("left"),
                ),
            )

        start = F.struct(
            F.col("total").alias("all"),
            F.floor(F.col("total") / 2).cast("long").alias("draw"),
            F.array().cast("array<bigint>").alias("left"),
        )
        halves = nodes.withColumn("total", total).withColumn(
            "left", F.aggregate("counts", start, split, lambda state: state["left"])
        )

        def side(first: bool) -> Column:
            return F.transform(
                F.arrays_zip("counts", "left"),
                lambda z: F.struct(
                    z["counts"]["s"].alias("s"),
                    (z["left"] if first else z["counts"]["n"] - z["left"]).alias("n"),
                ),
            )

        children = F.array(
            F.struct((F.col("shard") * 2).alias("shard"), side(True).alias("counts")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), side(False).alias("counts")),
        )
        nodes = halves.select(F.explode(children).alias("c")).select("c.shard", "c.counts")
    return nodes.select("shard", F.explode("counts").alias("c")).select("c.s", "shard", "c.n")


def mix(
    docs: DataFrame,
    row: str,
    size: str,
    source: str,
    block_words: int | None = 512,
    weights: Sequence[float] = (5, 2, 1),
    most: int = 3,
    levels: int = 3,
    seed: int = 0,
    tie: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Draws and targets: (row, block, words, pass, shard, place), and the table of `targets`.

    `row` identifies a row of `docs`, `size` is its number of words. A block is up
    to `block_words` consecutive words of a row (None: the whole row). A source's
    quota is the number of blocks whose middle word is within its target, counting
    whole passes and then a permutation. `place` orders a shard's draws. `tie` names
    a column that orders rows of equal `row`, if ids repeat.
    """
    spark = docs.sparkSession
    base = docs.select(
        F.col(f"`{row}`").alias("row"),
        F.col(f"`{size}`").cast("long").alias("size"),
        F.col(f"`{source}`").alias("source"),
        (F.col(f"`{tie}`") if tie else F.lit(0)).alias("tie"),
    )
    aims = keep(targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most))
    starts = F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block_words or 1).cast("long"))
    if block_words is None:
        starts = F.array(F.lit(0).cast("long"))
    cut = (
        base.where("size > 0")
        .join(aims.select("source", "s"), base["source"].eqNullSafe(aims["source"]))
        .select("row", "tie", "size", "s", F.posexplode(starts).alias("block", "start"))
    )
    here = F.col("size") if block_words is None else F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("start"))
    drawn = cut.select("row", "tie", "s", "block", here.alias("words")).withColumn(
        "h", hash60(F.lit(seed), F.col("row"), F.col("block"))
    )
    drawn = keep(drawn.withColumn("bucket", F.shiftright("h", HASH_BITS - BUCKET_BITS).cast("int")))
    parts = drawn.groupBy("s", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"))
    before = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "s",
        "bucket",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w0"),
        F.sum("n").over(Window.partitionBy("s")).alias("blocks"),
    )
    inside = Window.partitionBy("s", "bucket").orderBy("h", "row", "block", "tie")
    until = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        drawn.withColumn("n1", F.row_number().over(inside))
        .withColumn("w1", F.coalesce(F.sum("words").over(until), F.lit(0)))
        .join(offsets, ["s", "bucket"])
        .join(aims.select("s", "source_size", "target"), "s")
        .select(
            "row",
            "tie",
            "s",
            "block",
            "words",
            "h",
            "blocks",
            (F.col("n0") + F.col("n1")).alias("rank"),
            F.floor(F.col("target") / F.col("source_size")).cast("long").alias("passes"),
            (
                F.col("w0") + F.col("w1") + F.col("words") / 2.0
                <= F.col("target") - F.floor(F.col("target") / F.col("source_size")) * F.col("source_size")
            ).alias("once_more"),
        )
    )
    placed = keep(placed)
    quotas = placed.groupBy("s").agg(
        (F.first("passes") * F.first("blocks") + F.sum(F.col("once_more").cast("long"))).alias("quota")
    )
    until_shard = Window.partitionBy("s").orderBy("shard")
    dealt = split_quotas(quotas, levels, seed).withColumn("upto", F.sum("n").over(until_shard))
    bounds = keep(dealt.groupBy("s").agg(F.sort_array(F.collect_list("upto")).alias("upto")))
    times = F.col("passes") + F.col("once_more").cast("long")
    copies = placed.where(times > 0).withColumn(
        "pass", F.explode(F.sequence(F.lit(1).cast("long"), times))
    )
    at = (F.col("pass") - 1) * F.col("blocks") + F.col("rank")
    shard = F.size(F.filter("upto", lambda b: b < at))
    draws = copies.join(bounds, "s").select(
        "row",
        "tie",
        "block",
        "words",
        "pass",
        shard.alias("shard"),
        hash60(F.lit(f"{seed}/shuffle"), F.col("row"), F.col("block"), F.col("pass")).alias("place"),
    )
    return draws, aims
