"""Sums of thousands of replicates without a row per draw.

A replicate gives every cluster of a group a weight: how often it is drawn with
replacement, whether it carries one of the group's labels, or a sign. Weights come
from a splitting tree over the clusters' positions: a node knows how many draws fall
into its range, and a binomial (with replacement) or hypergeometric (labels) draw
says how many of them fall into the left half. In groups of more than LEAF clusters,
the draws of a node that small go to its clusters at once, with equal chances, which is
the same distribution at a tenth of the time. Draws are seeded by group and node, so
any task finds the same weights for its own range, from the root down, and the
weights of all ranges add up to whole replicates. All replicates of a node are one
array.

A task adds weight times sums for a range of clusters and sends one row per
replicate and range. Nothing is shuffled per draw, and memory depends on neither the
number of clusters nor that of rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared
from .ordering import hash_positions, match

# Executors get this module with the plan; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Clusters of a range that one row per replicate is sent for, and clusters whose weights are held at once.
RANGE = 16_384
HELD = 256
#: Clusters that the tree of a larger group stops at, and weights of such a node that are held at once.
LEAF = 1_024
DEALT = 1 << 20
#: Cells whose sums are one matrix product.
CELLS_AT_ONCE = 64

DRAWN, LABELLED, SIGNED = "drawn", "labelled", "signed"


def generator(key: int, lo: int, hi: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=((key & (1 << 64) - 1) << 64) | (lo << 32) | hi))


def nodes(kind: str, key: int, size: int, labels: int, b: int, first: int, last: int, leaf: int) -> Iterator[tuple[int, int, np.ndarray, np.random.Generator]]:
    """(lo, hi, draws of each of b replicates, generator) of the nodes of at most `leaf` positions that meet first to last - 1."""
    stack = [(0, size, np.full(b, size if kind == DRAWN else labels, np.int64))]
    while stack:
        lo, hi, held = stack.pop()
        if hi <= first or lo >= last:
            continue
        draw = generator(key, lo, hi)
        if hi - lo <= leaf:
            yield lo, hi, held, draw
            continue
        mid = (lo + hi) // 2
        if kind == DRAWN:
            left = draw.binomial(held, (mid - lo) / (hi - lo))
        else:
            left = draw.hypergeometric(mid - lo, hi - mid, held)
        stack += [(mid, hi, held - left), (lo, mid, left)]


def weights(kind: str, key: int, size: int, labels: int, b: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
    """(position, weight in each of b replicates) for the positions first to last - 1 of 0 to size - 1."""
    if kind == SIGNED:
        for at in range(first, last):
            yield at, generator(key, at, at + 1).integers(0, 2, b) * 2 - 1
        return
    for lo, _, held, _ in nodes(kind, key, size, labels, b, first, last, 1):
        yield lo, held


def dealt(kind: str, draw: np.random.Generator, held: np.ndarray, n: int) -> Iterator[tuple[slice, np.ndarray]]:
    """(replicates, their weights of a node's n positions): the node's draws with replacement, or its labels, at random."""
    step = max(1, DEALT // n)
    for at in range(0, len(held), step):
        some = held[at : at + step]
        if kind == DRAWN:
            cell = np.repeat(np.arange(len(some)) * n, some)
            cell += draw.integers(0, n, len(cell))
            yield slice(at, at + len(some)), np.bincount(cell, minlength=len(some) * n).reshape(-1, n)
        else:
            yield slice(at, at + len(some)), draw.permuted(np.arange(n) < some[:, None], axis=1)


def replicate_sums(
    rows: DataFrame, by: Sequence[str], cluster: Sequence[str], columns: Sequence[str], b: int, seed,
    kind: str = DRAWN, cells: Sequence[str] = (), label: str | None = None, span: int | None = None,
) -> DataFrame:
    """(by…, cells…, b, columns…): weighted sums over the clusters of a group, for replicates 1 to b.

    A task holds b sums for every cell of a range of `span` clusters; where nearly every
    cluster is a cell of its own, ranges must be short.

    A cluster may have several rows, told apart by `cells`. With LABELLED, as many
    clusters of a group weigh 1 as have a true `label`, all others 0. Null sums count as zero.
    """
    by, cluster, cells, columns = list(by), list(cluster), list(cells), list(columns)
    rows = shared(rows.select(*dict.fromkeys([*by, *cluster, *cells, *columns, *([label] if label else [])])))
    items = rows.groupBy(*by, *cluster).agg(F.lit(1).alias("_one"), *([F.max(label).alias("_lab")] if label else []))
    numbered = shared(hash_positions(shared(items), by, cluster, seed, "_pos", "_size"))
    placed = match(rows, numbered.drop("_one"), [*by, *cluster])
    if label:
        counts = numbered.groupBy(*by).agg(F.count_if("_lab").alias("_labels"))
        placed = match(placed, counts, by)
    else:
        placed = placed.withColumn("_labels", F.lit(0).cast("long"))
    span = span or RANGE
    at = (F.col("_pos") - 1).cast("long")
    placed = placed.select(
        *by, *cells, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns], "_labels",
        F.col("_size").cast("long").alias("_size"), at.alias("_at"), F.floor(at / span).cast("long").alias("_range"),
        F.xxhash64(F.lit(str(seed)), *by).alias("_key"),
    )
    n_by = len(by)

    def one_range(keys: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("_at", kind="stable")
        size, labels, key, start = (int(part[c].iloc[0]) for c in ("_size", "_labels", "_key", "_range"))
        cell = part.groupby(cells, dropna=False, sort=False).ngroup().to_numpy() if cells else np.zeros(len(part), np.int64)
        first = {c: part.iloc[i] for c, i in zip(*np.unique(cell, return_index=True), strict=True)}
        place, amounts = part["_at"].to_numpy(), part[columns].to_numpy(np.float64)
        total = {c: np.zeros((b, len(columns))) for c in first}
        lo, hi = start * span, min(size, (start + 1) * span)
        leaf = min(LEAF, span)
        if kind == SIGNED or size <= leaf:
            held: list[np.ndarray] = []
            begin = lo
            for at, w in weights(kind, key, size, labels, b, lo, hi):
                held.append(w)
                if len(held) == HELD or at == hi - 1:
                    mine = slice(*np.searchsorted(place, [begin, at + 1]))
                    matrix = np.array(held, np.float64)[place[mine] - begin]
                    for c in np.unique(cell[mine]):
                        some = cell[mine] == c
                        total[c] += matrix[some].T @ amounts[mine][some]
                    held, begin = [], at + 1
        else:
            for low, high, many, draw in nodes(kind, key, size, labels, b, lo, hi, leaf):
                mine = slice(*np.searchsorted(place, [max(lo, low), min(hi, high)]))
                found, own = np.unique(cell[mine], return_inverse=True)
                tables = []
                for i in range(0, len(found), CELLS_AT_ONCE):
                    some = (own >= i) & (own < i + CELLS_AT_ONCE)
                    table = np.zeros((high - low, len(found[i : i + CELLS_AT_ONCE]), len(columns)))
                    np.add.at(table, (place[mine][some] - low, own[some] - i), amounts[mine][some])
                    tables.append((found[i : i + CELLS_AT_ONCE], table.reshape(high - low, -1)))
                for replicates, w in dealt(kind, draw, many, high - low) if tables else ():
                    w = w.astype(np.float64)
                    for cs, table in tables:
                        sums = (w @ table).reshape(len(w), len(cs), len(columns))
                        for i, c in enumerate(cs):
                            total[c][replicates] += sums[:, i]
        out = []
        for c, sums in total.items():
            frame = pd.DataFrame({name: [k] * b for name, k in zip(by, keys[:n_by], strict=True)}, index=range(b))
            for name in cells:
                frame[name] = [first[c][name]] * b
            frame["b"] = np.arange(1, b + 1)
            frame[columns] = sums
            out.append(frame)
        return pd.concat(out)

    schema = placed.select(*by, *cells, F.lit(0).cast("long").alias("b"), *columns).schema
    parts = placed.groupBy(*by, "_range").applyInPandas(one_range, schema)
    return parts.groupBy(*by, *cells, "b").agg(*[F.sum(c).alias(c) for c in columns])
