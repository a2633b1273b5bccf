"""Regression trees by histograms over binned rows: gradient boosting and random forests.

Features are binned once, at exact quantiles of all rows. A task grows trees over the
binned rows, all nodes of a level in one pass, with the node of every row kept from
level to level. It reads its rows in batches and keeps bins and labels only. Equal rows are one row with a count by then, as rows that come many times
would fill a task of any size.

Boosting trains one model on all rows. A table of up to `ALONE_ROWS` rows is boosted by
one task. A larger one is dealt by hash to blocks, some 20 bytes a row, that executors
keep; a job per tree level adds up the histograms of all blocks, and the driver, which
sees only these sums, finds the level's splits. A block is held in Python one at a time.
Residuals enter the sums as whole multiples of a power of two (about the library's single
precision), so the sums are exact, and the model does not depend on partitions.

A forest's rows are dealt by hash to shards, and its trees over the shards, each on a
bootstrap sample of its shard; where there are fewer shards than cores, a shard goes
to several tasks, which grow some of its trees each.

Where one task trains, there is no job per tree level: 600 rounds of depth 6 are 3,600
levels, which as jobs take some 8 minutes for any number of rows.
"""

from __future__ import annotations

import math
import pickle
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import astuple, dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared

# Executors get this module with the plan; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows that a shard aims at, and the most shards. Beyond their product shards have more rows.
SHARD_ROWS = 200_000
MOST_SHARDS = 64
#: The most rows that one task boosts.
ALONE_ROWS = 4_000_000
#: Rows that a block aims at: their bins stay in a core's cache. And the most blocks that a partition aims at.
BLOCK_ROWS = 1 << 16
PART_BLOCKS = 256
#: Rounds after which the blocks forget how they came about.
FORGET = 20
BINS = 64
#: Up to so many rows, quantiles come from Spark's percentile, which keeps all values in one task.
EDGE_ROWS = 50_000
#: Bits of a value that a scan for quantiles settles.
DIGITS = (16, 10, 10, 10, 10, 8)
#: Copies of equal rows are listed in shards of up to so many times the rows aimed at; above, they are counts.
LISTED = 2


@dataclass
class Settings:
    """How trees grow. Defaults are fixed values: the reference's boosting and the penalty of its library."""

    rounds: int = 600
    depth: int = 6
    rate: float = 0.05
    rows: float = 0.8
    columns: float = 0.8
    penalty: float = 1.0
    seed: int = 42


#: The reference's forest, of unpruned means over bootstrap samples.
FOREST = Settings(rounds=200, depth=12, rate=1.0, rows=1.0, columns=1.0, penalty=0.0)


@dataclass
class Trees:
    """Complete trees in heap order: split feature and bin of inner nodes (bins above go right), values of leaves."""

    base: float
    feature: np.ndarray
    bin: np.ndarray
    leaf: np.ndarray

    @staticmethod
    def empty(base: float, n: int, depth: int) -> Trees:
        inner = (n, 2**depth - 1)
        return Trees(base, np.zeros(inner, np.int32), np.full(inner, BINS, np.uint8), np.zeros((n, 2**depth)))

    def predict(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(len(codes), self.base)
        row = np.arange(len(codes))
        for feature, cut, leaf in zip(self.feature, self.bin, self.leaf, strict=True):
            node = np.zeros(len(codes), np.int64)
            for _ in range(int(math.log2(len(leaf)))):
                node = 2 * node + 1 + (codes[row, feature[node]] > cut[node])
            out += leaf[node - len(feature)]
        return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bin of every value: the number of its feature's edges below it."""
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1).astype(np.uint8)


def best_splits(codes, used, rows, at, amount, weight, sums, counts, s: Settings) -> tuple[np.ndarray, ...]:
    """Per open node the best gain, its feature and bin, and amount and weight left of it. One feature's histograms at a time."""
    n = len(sums)
    best, which, cuts, low, few = np.full(n, -np.inf), np.full(n, used[0]), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
    amount, weight, every = amount[rows], weight[rows], np.arange(n)
    for f in used:
        cell = at * BINS + codes[rows, f]
        total = np.bincount(cell, amount, n * BINS).reshape(n, BINS).cumsum(axis=1)
        count = np.bincount(cell, weight, n * BINS).reshape(n, BINS).cumsum(axis=1)
        other, rest = sums[:, None] - total, counts[:, None] - count
        both = (count > 0.5) & (rest > 0.5)
        gain = np.where(both, total**2 / np.maximum(count + s.penalty, 0.5) + other**2 / np.maximum(rest + s.penalty, 0.5), -np.inf)
        cut = gain.argmax(axis=1)
        more = np.flatnonzero(gain[every, cut] > best)
        at_cut = (more, cut[more])
        best[more], which[more], cuts[more], low[more], few[more] = gain[at_cut], f, cut[more], total[at_cut], count[at_cut]
    return best, which, cuts, low, few


def grow(codes: np.ndarray, target: np.ndarray, weight: np.ndarray, used: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One tree on weighted rows: features, bins, and leaf values. A node without a gain sends all rows left."""
    inner = 2**s.depth - 1
    feature, cut, leaf = np.zeros(inner, np.int32), np.full(inner, BINS, np.uint8), np.zeros(2**s.depth)
    rows = np.flatnonzero(weight)
    amount = target * weight
    # open nodes of the level by their number in it, and the open node of every row
    nodes, at = np.zeros(1, np.int64), np.zeros(len(rows), np.int64)
    sums, counts = np.array([amount.sum()]), np.array([float(weight.sum())])
    for level in range(s.depth):
        best, which, cuts, low, few = best_splits(codes, used, rows, at, amount, weight, sums, counts, s)
        split = best > sums**2 / (counts + s.penalty) * (1 + 1e-12) + 1e-12
        # a node that stays whole is the leftmost leaf below it
        leaf[nodes[~split] << (s.depth - level)] = s.rate * sums[~split] / (counts[~split] + s.penalty)
        place = 2**level - 1 + nodes[split]
        feature[place], cut[place] = which[split], cuts[split]
        sums, counts = (np.stack([a, b - a], axis=1).reshape(-1) for a, b in ((low[split], sums[split]), (few[split], counts[split])))
        nodes = (2 * nodes[split][:, None] + np.arange(2)).reshape(-1)
        stay = split[at]
        rows, at = rows[stay], at[stay]
        right = codes[rows, which[at]] > cuts[at]
        at = 2 * (np.cumsum(split) - 1)[at] + right
        if not len(nodes):
            break
    leaf[nodes] = s.rate * sums / (counts + s.penalty)
    return feature, cut, leaf


def boost(codes: np.ndarray, label: np.ndarray, s: Settings, copies: np.ndarray | None = None) -> Trees:
    """Rounds of trees, each on the residuals of a share of the rows and features. `copies`: how many rows each row stands for."""
    draw = np.random.default_rng(s.seed)
    n, features = codes.shape
    take = max(1, int(s.columns * features))
    trees = Trees.empty(float(np.average(label, weights=copies)), s.rounds, s.depth)
    residual = label - trees.base
    for r in range(s.rounds):
        weight = (draw.random(n) < s.rows if copies is None else draw.binomial(copies, s.rows)).astype(np.float64)
        used = np.sort(draw.choice(features, take, replace=False))
        if weight.any():
            trees.feature[r], trees.bin[r], trees.leaf[r] = grow(codes, residual, weight, used, s)
        one = Trees(0.0, trees.feature[r : r + 1], trees.bin[r : r + 1], trees.leaf[r : r + 1])
        residual = residual - one.predict(codes)
    return trees


@dataclass
class Block:
    """Binned rows (features x rows) with residuals, at first the labels, and numbers of copies (none: one each)."""

    number: int
    codes: np.ndarray
    residual: np.ndarray
    copies: np.ndarray | None
    turn: int | None = None

    def plain(self) -> tuple:
        return self.number, self.codes, self.residual, self.copies

    def begin(self, turn: int, s: Settings) -> None:
        """All rows to the root, and the round's rows drawn, unless the block is in this round."""
        if self.turn != turn:
            draw, n = np.random.default_rng([s.seed, turn, self.number]), len(self.residual)
            self.weight = None if self.copies is None else draw.binomial(self.copies, s.rows).astype(np.float64)
            self.kept = draw.random(n, np.float32) < s.rows if self.weight is None else self.weight > 0
            self.turn, self.level, self.at = turn, 0, np.zeros(n, np.uint8 if s.depth <= 8 else np.int32)

    def whole(self, scale: float) -> np.ndarray:
        """Number of rows, and the sum of their residuals as multiples of 1 / `scale`."""
        copies = np.ones(len(self.residual)) if self.copies is None else self.copies
        return np.array([copies.sum(), (np.rint(self.residual * scale) * copies).sum()])

    def descend(self, level: int, feature: np.ndarray, cut: np.ndarray) -> None:
        """Every row to its node of a level, by the features and cuts of the levels above, in heap order."""
        n = len(self.residual)
        every, flat = np.arange(n), self.codes.reshape(-1)
        for top in range(self.level, level):
            here = slice(2**top - 1, 2 ** (top + 1) - 1)
            code = flat[(feature[here].astype(np.int64) * n)[self.at] + every]
            self.at = self.at * 2 + (code > cut[here][self.at])
        self.level = level

    def add(self, cells: np.ndarray, used: np.ndarray, slot: np.ndarray, scale: float) -> None:
        """Add the round's rows in nodes with a slot to the histograms (amount and count x used features x slots and bins)."""
        rows = np.flatnonzero((slot >= 0)[self.at] & self.kept)
        if not len(rows):
            return
        first, amount = (slot * BINS)[self.at[rows]], np.rint(self.residual[rows] * scale)
        weight = None if self.weight is None else self.weight[rows]
        if weight is not None:
            amount *= weight
        for i, f in enumerate(used):
            cell = first + self.codes[f][rows]
            cells[0, i] += np.bincount(cell, amount, cells.shape[2])
            cells[1, i] += np.bincount(cell, weight, cells.shape[2])


def histograms(blocks: Iterable[Block], turn: int, used: np.ndarray, level: int, feature, cut, slot: np.ndarray, scale: float, s: Settings) -> np.ndarray:
    """Sums of the blocks' residuals and rows by feature, slot of a node and bin."""
    cells = np.zeros((2, len(used), (slot.max() + 1) * BINS))
    for b in blocks:
        b.begin(turn, s)
        b.descend(level, feature, cut)
        b.add(cells, used, slot, scale)
    return cells


def learned(blocks: Iterable[Block], turn: int, feature: np.ndarray, cut: np.ndarray, leaf: np.ndarray, s: Settings) -> Iterator[Block]:
    """The blocks with what the tree leaves of their residuals."""
    for b in blocks:
        b.begin(turn, s)
        b.descend(int(math.log2(len(leaf))), feature, cut)
        yield Block(b.number, b.codes, b.residual - leaf[b.at], b.copies)


def boost_together(whole: np.ndarray, features: int, scale: float, s: Settings, count: Callable, learn: Callable) -> Trees:
    """Boosting as in `boost` on the blocks of a table, which `count` and `learn` reach as `histograms` and `learned`.

    `whole` has their rows and the sum of their labels. Sums are of multiples of 1 / `scale`, so they are exact in any order.
    """
    draw = np.random.default_rng(s.seed)
    take = max(1, int(s.columns * features))
    trees = Trees.empty(whole[1] / scale / whole[0], s.rounds, s.depth)
    learn(0, np.zeros(0, np.int32), np.zeros(0, np.uint8), np.array([trees.base]), s)
    for r in range(s.rounds):
        used = np.sort(draw.choice(features, take, replace=False))
        tree = trees.feature[r], trees.bin[r], trees.leaf[r]
        grow_together(r + 1, used, scale, s, count, *tree)
        if r < s.rounds - 1:
            learn(r + 1, *tree, s)
    return trees


def grow_together(turn: int, used: np.ndarray, scale: float, s: Settings, count: Callable, feature, cut, leaf) -> None:
    """One tree as in `grow`, written into `feature`, `cut` and `leaf`.

    A level's histograms are counted for the smaller child of a node; its sibling has what remains of their parent's.
    """
    # open nodes of the level by their number in it, and which of them are counted
    nodes, counted = np.zeros(1, np.int64), np.zeros(1, np.int64)
    total = few = sums = counts = None
    for level in range(s.depth):
        slot = np.full(2**level, -1)
        slot[nodes[counted]] = np.arange(len(counted))
        above = 2**level - 1
        new = count(turn, used, level, feature[:above], cut[:above], slot, scale, s).reshape(2, len(used), len(counted), BINS)
        if level:
            both = np.empty((2, len(used), len(nodes), BINS))
            both[:, :, counted], both[:, :, counted ^ 1] = new, total - new
            total = both
        else:
            total = new
            sums, counts = total[0, 0].sum(axis=1) / scale, total[1, 0].sum(axis=1)
            if not counts[0]:
                return
        best, which, cuts, low, few = splits_of(total[0] / scale, total[1], sums, counts, s)
        split = best > sums**2 / (counts + s.penalty) * (1 + 1e-12) + 1e-12
        # a node that stays whole is the leftmost leaf below it
        leaf[nodes[~split] << (s.depth - level)] = s.rate * sums[~split] / (counts[~split] + s.penalty)
        place = above + nodes[split]
        feature[place], cut[place] = used[which[split]], cuts[split]
        nodes = (2 * nodes[split][:, None] + np.arange(2)).reshape(-1)
        if not len(nodes):
            return
        total, low, few, sums, counts = total[:, :, split], low[split], few[split], sums[split], counts[split]
        counted = 2 * np.arange(len(few)) + (few > counts - few)
        sums, counts = (np.stack([a, b - a], axis=1).reshape(-1) for a, b in ((low, sums), (few, counts)))
    leaf[nodes] = s.rate * sums / (counts + s.penalty)


def splits_of(total: np.ndarray, count: np.ndarray, sums: np.ndarray, counts: np.ndarray, s: Settings) -> tuple[np.ndarray, ...]:
    """Per open node the best gain, its feature's place and its bin, and amount and weight left of it; histograms are features x nodes x bins."""
    total, count = (a.cumsum(axis=2).transpose(1, 0, 2).reshape(len(sums), -1) for a in (total, count))
    other, rest = sums[:, None] - total, counts[:, None] - count
    both = (count > 0.5) & (rest > 0.5)
    gain = np.where(both, total**2 / np.maximum(count + s.penalty, 0.5) + other**2 / np.maximum(rest + s.penalty, 0.5), -np.inf)
    place = np.arange(len(sums)), gain.argmax(axis=1)
    return gain[place], place[1] // BINS, place[1] % BINS, total[place], count[place]


def bag(codes: np.ndarray, label: np.ndarray, numbers: list[int], s: Settings, copies: np.ndarray | None = None) -> Trees:
    """The trees of the given numbers, each on a bootstrap sample of the rows. `copies` as in `boost`."""
    n, features = codes.shape
    trees = Trees.empty(0.0, len(numbers), s.depth)
    for i, number in enumerate(numbers):
        draw = np.random.default_rng([s.seed, number])
        if copies is None:
            weight = np.bincount(draw.integers(0, n, n), minlength=n).astype(np.float64)
        else:
            weight = draw.multinomial(copies.sum(), copies / copies.sum()).astype(np.float64)
        trees.feature[i], trees.bin[i], trees.leaf[i] = grow(codes, label, weight, np.arange(features), s)
    return trees


def fit_boosting(
    train: DataFrame, features: Sequence[str], label: str, settings: Settings | None = None,
    shard_rows: int = SHARD_ROWS, most_shards: int = MOST_SHARDS, alone_rows: int = ALONE_ROWS,
):
    """Train boosted trees on all rows; returns a function that adds the prediction to any table with the features.

    Rows with a null or NaN feature or label are left out. One task trains on up to
    `alone_rows` rows, on more than `shard_rows` of them by blocks. More rows are kept in up to `most_shards` partitions, more only if these grow large. The driver sees
    bin edges, a level's histograms of every partition, of up to 0.2 MB, and the model.
    """
    s = settings or Settings()

    def grown(codes: np.ndarray, label: np.ndarray, copies: np.ndarray | None, group: int, groups: int) -> Trees:
        return boost(codes, label, s, copies)

    rows = _whole(train, [label, *features])
    n = rows.count()
    if n <= shard_rows:
        return _fit(train, features, label, grown, 1, shard_rows, 1, lambda models: 1.0)
    edges = bin_edges(rows, n)
    model = _fit_together(rows, edges, n, s, min(BLOCK_ROWS, shard_rows), most_shards if n > alone_rows else 0)
    rows.unpersist()
    return _predictor(train.sparkSession, features, edges, [model], 1.0)


def fit_forest(
    train: DataFrame, features: Sequence[str], label: str, settings: Settings = FOREST,
    shard_rows: int = SHARD_ROWS, most_shards: int = MOST_SHARDS,
):
    """Train a random forest; rows and result as in `fit_boosting`. The model is some 0.05 MB a tree of depth 12."""
    s = settings
    copies = min(s.rounds, train.sparkSession.sparkContext.defaultParallelism)

    def grown(codes: np.ndarray, label: np.ndarray, copies: np.ndarray | None, group: int, groups: int) -> Trees:
        return bag(codes, label, list(range(group, s.rounds, groups)), s, copies)

    return _fit(train, features, label, grown, copies, shard_rows, min(most_shards, s.rounds), lambda _: 1.0 / s.rounds)


def shard_part(batch: pa.RecordBatch, edges: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Bins, labels and numbers of copies of a batch's rows, and their group."""
    label, *x, copies, group = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
    return binned(np.stack(x, axis=1), edges), label.copy(), copies.copy(), int(group[0])


def _whole(train: DataFrame, names: Sequence[str]) -> DataFrame:
    """The label and the features as c0, c1, ..., without rows that lack one."""
    columns = [F.col(c).cast("double") for c in names]
    whole = reduce(lambda a, b: a & b, [c.isNotNull() & ~F.isnan(c) for c in columns])
    return shared(train.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).where(whole))


def ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def values_at(rows: DataFrame, names: Sequence[str], ranks: np.ndarray) -> np.ndarray:
    """Values of the given ranks (from 0) of every column, exact: a scan of the table for every few bits of them.

    A scan counts, for every start of a wanted value known so far, the values that start so by their next bits.
    """
    n = len(names)
    start, left, done = np.zeros((n, len(ranks)), np.uint64), np.tile(ranks, (n, 1)), 0
    few = rows.select(*names).coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)

    def scan(width: int) -> DataFrame:
        known, shift = [np.unique(a) for a in start], np.uint64(64 - done - width)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells = [np.zeros(len(k) << width, np.int64) for k in known]
            for batch in batches:
                for k, cell, column in zip(known, cells, batch.columns, strict=True):
                    key = ordered(column.to_numpy(zero_copy_only=False)) >> shift
                    first = key >> np.uint64(width)
                    at = np.minimum(np.searchsorted(k, first), len(k) - 1)
                    mine = k[at] == first
                    digit = (key[mine] & np.uint64((1 << width) - 1)).astype(np.int64)
                    cell += np.bincount((at[mine] << width) + digit, minlength=len(cell))
            sums = pa.array([c.tobytes() for c in cells], pa.binary())
            yield pa.record_batch({"c": pa.array(range(len(cells)), pa.int32()), "cells": sums})

        def find(parts: pd.DataFrame) -> pd.DataFrame:
            c = int(parts["c"].iloc[0])
            cells = sum(np.frombuffer(x, np.int64) for x in parts["cells"]).reshape(len(known[c]), -1).cumsum(axis=1)
            cells = cells[np.searchsorted(known[c], start[c])]
            digit = (cells <= left[c][:, None]).sum(axis=1)
            before = np.where(digit > 0, cells[np.arange(len(digit)), np.maximum(digit - 1, 0)], 0)
            return pd.DataFrame({"c": c, "t": np.arange(len(digit)), "digit": digit, "rest": left[c] - before})

        return few.mapInArrow(count, "c int, cells binary").groupBy("c").applyInPandas(find, "c int, t int, digit long, rest long")

    for width in DIGITS:
        found = scan(width).collect()
        done += width
        start <<= np.uint64(width)
        for r in found:
            start[r["c"], r["t"]] |= np.uint64(r["digit"])
            left[r["c"], r["t"]] = r["rest"]
    return np.where(start >> np.uint64(63), start & np.uint64((1 << 63) - 1), ~start).view(np.float64)


def bin_edges(rows: DataFrame, n: int, most: int = EDGE_ROWS) -> list[np.ndarray]:
    """Exact quantiles of all rows for every feature, in between two values as Spark's percentile; the same on any partitions."""
    names, probs = rows.columns[1:], [i / BINS for i in range(1, BINS)]
    if n <= most:
        shares = F.array(*[F.lit(p) for p in probs])
        cuts = rows.agg(*[F.percentile(c, shares).alias(c) for c in names]).first()
        return [np.unique(np.array(cuts[c] or [0.0])) for c in names]
    at = (n - 1) * np.array(probs)
    low, high = np.floor(at), np.ceil(at)
    ranks = np.unique([low, high]).astype(np.int64)
    values = values_at(rows, names, ranks)
    below, above = (values[:, np.searchsorted(ranks, r)] for r in (low, high))
    cuts = np.where(below == above, below, (high - at) * below + (at - low) * above)
    return [np.unique(c) for c in cuts]


def _fit_together(rows: DataFrame, edges: list[np.ndarray], n: int, s: Settings, block_rows: int, most_shards: int) -> tuple:
    """Boost one model on all rows, dealt by hash to blocks: in one task (`most_shards` 0) or by a job per tree level."""
    features, blocks = len(edges), -(-n // block_rows)
    parts = min(blocks, max(min(most_shards, rows.sparkSession.sparkContext.defaultParallelism), -(-blocks // PART_BLOCKS)))
    parts = parts if most_shards else 1
    low, high = rows.agg(F.min("c0"), F.max("c0")).first()
    reach = max(abs(low), abs(high), high - low) or 1.0
    scale = 2.0 ** (51 - math.ceil(math.log2(n)) - math.ceil(math.log2(reach)))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, *x = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            codes = pa.py_buffer(binned(np.stack(x, axis=1), edges).tobytes())
            codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(features), len(label), [None, codes])
            yield pa.record_batch({"label": pa.array(label, pa.float64()), "codes": codes.cast(pa.binary())})

    # equal rows are counted before they meet in a block
    dealt = rows.mapInArrow(coded, "label double, codes binary").groupBy("label", "codes").agg(F.count("*").alias("n"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("label", "codes"), F.lit(blocks)))
    dealt = dealt.repartitionById(parts, F.pmod("block", F.lit(parts)).cast("int")).sortWithinPartitions("block", "codes", "label")

    def block_of(number: int, pieces: list[pa.RecordBatch]) -> Block:
        table = pa.Table.from_batches(pieces)
        codes = table["codes"].combine_chunks().cast(pa.binary(features))
        codes = np.frombuffer(codes.buffers()[1], np.uint8, len(codes) * features, codes.offset * features).reshape(-1, features)
        label, copies = table["label"].to_numpy().copy(), table["n"].to_numpy().copy()
        return Block(number, np.ascontiguousarray(codes.T), label, None if copies.max() == 1 else copies)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        pieces, last = [], -1
        for batch in batches:
            number = batch.column("block").to_numpy()
            ends = [0, *(np.flatnonzero(np.diff(number)) + 1), len(number)]
            for a, b in zip(ends, ends[1:], strict=False):
                if a < b:
                    if number[a] != last and pieces:
                        yield block_of(last, pieces)
                        pieces = []
                    last = int(number[a])
                    pieces.append(batch.slice(a, b - a))
        if pieces:
            yield block_of(last, pieces)

    def boxed(x) -> pa.RecordBatch:
        return pa.record_batch({"x": pa.array([pickle.dumps(x)], pa.binary())})

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(read(batches))

        def learn_here(*tree) -> None:
            held[:] = learned(held, *tree)

        if held:
            whole = sum(b.whole(scale) for b in held)
            yield boxed(astuple(boost_together(whole, features, scale, s, lambda *by: histograms(held, *by), learn_here)))

    if not most_shards:
        return pickle.loads(bytes(dealt.mapInArrow(alone, "x binary").collect()[0]["x"]))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in read(batches):
            yield boxed(b.plain())

    # as plain tuples, since executors' pickles cannot name this module
    first = dealt.mapInArrow(pack, "x binary").rdd.map(lambda r: pickle.loads(bytes(r[0])))
    kept: list[RDD] = [first.persist(StorageLevel.MEMORY_AND_DISK)]
    rounds = 0

    def count(*by) -> np.ndarray:
        cells = sum(kept[-1].mapPartitions(lambda held: [histograms((Block(*b) for b in held), *by)]).collect())
        for old in kept[:-1]:  # the level has kept the newest
            old.unpersist()
        del kept[:-1]
        return cells

    def learn(*tree) -> None:
        nonlocal rounds
        newest = kept[-1].mapPartitions(lambda held: (b.plain() for b in learned((Block(*b) for b in held), *tree)))
        rounds += 1
        newest.persist(StorageLevel.MEMORY_AND_DISK)
        if rounds % FORGET == 0:
            newest.localCheckpoint()
        kept.append(newest)

    whole = sum(kept[0].map(lambda b: Block(*b).whole(scale)).collect())
    found = boost_together(whole, features, scale, s, count, learn)
    for old in kept:
        old.unpersist()
    return astuple(found)


def _fit(train: DataFrame, features: Sequence[str], label: str, grown, tasks: int, shard_rows: int, most_shards: int, weight):
    """Bin, deal, train `grown(codes, label, copies, group, groups)` in at least `tasks` groups, and return the predictor."""
    rows = _whole(train, [label, *features])
    names, n = rows.columns, rows.count()
    if not n:
        raise ValueError("no rows to train on")
    edges = bin_edges(rows, n)
    shards = min(most_shards, -(-n // shard_rows))
    copies = max(1, tasks // shards)
    groups = shards * copies
    shard = F.pmod(F.xxhash64("h"), F.lit(shards)) * copies
    # equal rows are counted before they meet in a shard
    dealt = rows.withColumn("h", F.xxhash64(*names))
    dealt = dealt.groupBy(shard.alias("shard"), *names).agg(F.count("*").alias("n"))
    dealt = dealt.select(*names, "n", F.explode(F.sequence("shard", F.col("shard") + copies - 1)).alias("g"))
    dealt = dealt.repartitionById(groups, F.col("g").cast("int")).sortWithinPartitions(*names)

    def train_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [shard_part(b, edges) for b in batches if b.num_rows]
        if read:
            group = read[0][3]
            codes, label, many = (np.concatenate(part) for part in zip(*[r[:3] for r in read], strict=True))
            read.clear()
            if len(many) < many.sum() <= LISTED * shard_rows:
                codes, label = codes.repeat(many, axis=0), label.repeat(many)
                many = np.ones(len(label), np.int64)
            found = grown(np.asfortranarray(codes), label, None if many.sum() == len(many) else many, group, groups)
            yield pa.record_batch({"g": pa.array([group], pa.int64()), "model": pa.array([pickle.dumps(astuple(found))], pa.binary())})

    found = dealt.mapInArrow(train_one, "g long, model binary").collect()
    models = [pickle.loads(bytes(r["model"])) for r in sorted(found, key=lambda r: r["g"])]
    rows.unpersist()
    return _predictor(train.sparkSession, features, edges, models, weight(models))


def _predictor(spark, features: Sequence[str], edges: list[np.ndarray], models: list[tuple], factor: float):
    """The function that adds the sum of the models times a factor."""
    sent = spark.sparkContext.broadcast(models)

    @F.pandas_udf("double")
    def mean(*values: pd.Series) -> pd.Series:
        x = np.stack([v.to_numpy(np.float64) for v in values], axis=1)
        codes = binned(x, edges)
        out = sum(Trees(*model).predict(codes) for model in sent.value) * factor
        return pd.Series(np.where(np.isnan(x).any(axis=1), np.nan, out))

    def predict(df: DataFrame, out: str = "pred") -> DataFrame:
        """The table with the prediction, null where a feature is null or NaN."""
        raw = mean(*[F.col(c).cast("double") for c in features])
        return df.withColumn(out, F.nanvl(raw, F.lit(None).cast("double")))

    return predict
