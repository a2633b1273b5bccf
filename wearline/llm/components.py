"""Connected components of a link table by alternating stars.

Every round hangs the larger neighbours of a node on its smallest neighbour
("large star"), then the smaller ones ("small star"), until nothing changes.
A node of any degree is aggregated on the map side before the shuffle and its
links stay rows of a join, which adaptive execution may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    hung = both.join(least, "a").where(F.col("b") > F.col("a"))
    return hung.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where(F.col("b") > F.col("m"))
    own = least.select("a", F.col("m").alias("b"))
    return own.unionByName(moved.select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of a link; links are rows (a, b) of longs with a <> b.

    The root is the smallest node of the component. Repeated and mirrored links do
    no harm; an empty table gives an empty one.
    """
    now = keep(links.select("a", "b").distinct())
    mark = _mark(now)
    while True:
        now = keep(_small(_large(now)))
        last, mark = mark, _mark(now)
        if mark == last:
            break
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
