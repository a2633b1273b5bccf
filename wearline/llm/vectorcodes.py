"""Compression of vectors to short codes by Lloyd's rounds over cover trees.

Every block of rows of a partition gets one cover tree per part of the vectors: a
node holds a run of rows around its first one, all within its radius, and its
children are runs within half that radius around rows farther apart than that. With
cumulative sums over the rows in tree order, a subtree's size and sum are two
look-ups.

A search goes down from the root with all codebook entries. With d the distance of
an entry to the node's centre and r the node's radius, an entry with d - r beyond
the least d + r is nearest to no row of the subtree. Where one entry is left, the
whole subtree is assigned; ambiguous nodes hand the entries left to their children,
and rows of ambiguous leaves are compared exactly, in integers. The margin for
rounding is on the side of descending, so the result is that of comparing all.

A round sends one row per used entry and task; codebooks (parts x entries) meet on
the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, pack, unpack, workers_import_this
from .vectors import blocks, exact, finite, first_rows, floor_means, whole

#: Rows of a tree, rows of a leaf, and (row, entry) pairs compared at once.
BLOCK_ROWS = 2048
LEAF_ROWS = 4
PAIRS_AT_ONCE = 1 << 16
MARGIN = 1e-9


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact."""
    return ((a - b) ** 2).sum(axis=1)


def runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


@dataclass
class Tree:
    """Points in tree order and nodes as runs of them, parents first; children of a node are neighbours."""

    order: np.ndarray
    points: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    child: np.ndarray
    children: np.ndarray
    radius: np.ndarray
    sums: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        dim = self.points.shape[1]
        self.sums = np.concatenate([np.zeros((1, dim), self.points.dtype), np.cumsum(self.points, axis=0)])

    def packed(self) -> list[bytes]:
        nodes = np.concatenate([self.lo, self.hi, self.child, self.children])
        return [pack(x) for x in (self.order, self.points.astype(np.int64).reshape(-1), nodes, self.radius)]


def unpacked(blobs: list[bytes], most: int) -> Tree:
    order, points, nodes, radius = map(unpack, blobs)
    return Tree(order, exact(points.reshape(len(order), -1), most), *nodes.reshape(4, -1), radius)


def grow(points: np.ndarray) -> Tree:
    """The cover tree of rows. Rows at the same place are one leaf, however many."""
    order = np.arange(len(points))
    lo, hi, child, children, radius = [0], [len(points)], [], [], []
    for node in range(2 * len(points)):
        if node == len(lo):
            break
        rest = order[lo[node] : hi[node]].copy()
        away = squares(points[rest], points[rest[0]])
        widest = away.max()
        radius.append(float(widest) ** 0.5 * (1 + MARGIN))
        child.append(len(lo))
        children.append(0)
        if widest == 0 or len(rest) <= LEAF_ROWS:
            continue
        at = lo[node]
        while len(rest):
            near = away * 4 <= widest
            run = rest[near]
            order[at : at + len(run)] = run
            lo.append(at)
            hi.append(at + len(run))
            children[node] += 1
            at += len(run)
            rest = rest[~near]
            if len(rest):
                away = squares(points[rest], points[rest[0]])
    return Tree(order, points[order], *(np.array(x, np.int64) for x in (lo, hi, child, children)), np.array(radius))


def search(tree: Tree, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs [lo, hi) of rows in tree order and the nearest entry of each run; ties to the lower entry."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    nodes, sizes = np.array([0]), np.array([len(book)])
    entries = np.arange(len(book))
    while len(nodes):
        starts = np.cumsum(sizes) - sizes
        square = _compared(tree.points, np.repeat(tree.lo[nodes], sizes), book, entries)
        best = _least(square, starts, sizes, entries)
        # the nearest row of the subtree to an entry, against the farthest to the best entry
        away = np.sqrt(square.astype(np.float64))
        reach = np.minimum.reduceat(away, starts) + 2 * tree.radius[nodes]
        near = away <= np.repeat(reach * (1 + MARGIN) + MARGIN, sizes)
        left = np.add.reduceat(near.astype(np.int64), starts)
        settled = (left == 1) | (tree.radius[nodes] == 0)
        found.append((tree.lo[nodes[settled]], tree.hi[nodes[settled]], best[settled]))
        entries = entries[near & np.repeat(~settled, sizes)]
        nodes, sizes = nodes[~settled], left[~settled]
        starts = np.cumsum(sizes) - sizes
        leaf = tree.children[nodes] == 0
        found.append(_rows(tree, book, nodes[leaf], entries, starts[leaf], sizes[leaf]))
        count = tree.children[nodes]
        entries = entries[runs(np.repeat(starts, count), np.repeat(sizes, count))]
        sizes = np.repeat(sizes, count)
        nodes = runs(tree.child[nodes], count)
    lo, hi, best = (np.concatenate(x) for x in zip(*found, strict=True))
    return lo, hi, best


def _rows(tree: Tree, book: np.ndarray, nodes, entries, starts, sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every row of ambiguous leaves against the entries left to its leaf."""
    count = tree.hi[nodes] - tree.lo[nodes]
    rows = runs(tree.lo[nodes], count)
    sizes, starts = np.repeat(sizes, count), np.repeat(starts, count)
    if not len(rows):
        return rows, rows, rows
    some = entries[runs(starts, sizes)]
    square = _compared(tree.points, np.repeat(rows, sizes), book, some)
    return rows, rows + 1, _least(square, np.cumsum(sizes) - sizes, sizes, some)


def _compared(points: np.ndarray, rows: np.ndarray, book: np.ndarray, entries: np.ndarray) -> np.ndarray:
    step = PAIRS_AT_ONCE
    parts = [squares(points[rows[i : i + step]], book[entries[i : i + step]]) for i in range(0, len(rows), step)]
    return np.concatenate(parts)


def _least(square: np.ndarray, starts: np.ndarray, sizes: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """The first entry of each run (entries ascend) with the run's least square."""
    least = np.repeat(np.minimum.reduceat(square, starts), sizes)
    first = np.where(square == least, np.arange(len(square)), len(square))
    return entries[np.minimum.reduceat(first, starts)]


@dataclass
class Coding:
    """Codebooks, [part][entry] as integer components, and the kept blocks with their trees."""

    blocks: DataFrame
    books: list[list[list[int]]]


def fit(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 4,
    entries: int = 256, rounds: int = 4, scale: int = 1024,
) -> Coding:
    """Codebooks of every part position by Lloyd's rounds from the vectors with the smallest ids.

    Takes part: vectors without null or non-finite components, as floor(scale *
    component), of the same number of components as the one with the smallest id
    (null ids last, of equal ids the smaller vector first) among those whose number
    of components `parts` divides; others have no place in the codebooks. Repeated
    rows count each. Fewer vectors than entries give as many entries. A round that
    changes no entry is the last.
    """
    spark = vectors.sparkSession
    workers_import_this(spark)
    x = F.col(f"`{vector}`").cast("array<double>")
    whole_parts = (F.size("x") > 0) & (F.size("x") % parts == 0)
    kept = vectors.where(finite(vector)).select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").alias("label"), x.alias("x")
    )
    kept = kept.where(whole_parts)
    by_id = [F.col("vec_id").asc_nulls_last(), F.col("x")]
    dim = max((len(r["x"]) for r in first_rows(kept, 1, *by_id)), default=parts)
    kept = kept.where(F.size("x") == dim)
    first = [whole(np.array(r["x"]), scale).tolist() for r in first_rows(kept, entries, *by_id)]
    size = dim // parts

    def planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, (ids, labels) in blocks(batches, BLOCK_ROWS):
            vectors = exact(whole(values, scale), _most(size))
            trees = [blob for p in range(parts) for blob in grow(vectors[:, p * size : (p + 1) * size]).packed()]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), c) for c in (ids, labels)]
            yield pa.record_batch([*lists, pa.array([trees], pa.list_(pa.binary()))], ["ids", "labels", "trees"])

    kind = kept.schema["label"].dataType.simpleString()
    stored = keep(kept.mapInArrow(planted, f"ids array<long>, labels array<{kind}>, trees array<binary>"))
    books = [[v[p * size : (p + 1) * size] for v in first] for p in range(parts)]
    for _ in range(rounds if first else 0):
        moved = _round(stored, books)
        if moved == books:
            break
        books = moved
    return Coding(stored, books)


def _most(size: int) -> int:
    """Components up to which squared distances of this many fit 64 bits."""
    return int((2**63 / (4 * size)) ** 0.5)


def _trees(blobs: list[bytes], books: list[np.ndarray]) -> Iterator[tuple[Tree, np.ndarray]]:
    each = len(blobs) // len(books)
    for p, book in enumerate(books):
        tree = unpacked(blobs[p * each : (p + 1) * each], _most(book.shape[1]))
        yield tree, book.astype(tree.points.dtype)


def _round(stored: DataFrame, books: list[list[list[int]]]) -> list[list[list[int]]]:
    """Every used entry moved to the floor of the mean of its rows."""
    arrays = [np.array(book, np.int64) for book in books]
    size = arrays[0].shape[1]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(a.shape, object) for a in arrays]
        sizes = [np.zeros(len(a), np.int64) for a in arrays]
        for batch in batches:
            for row in batch.column(0):
                for p, (tree, book) in enumerate(_trees(row.as_py(), arrays)):
                    lo, hi, best = search(tree, book)
                    within = np.zeros(book.shape, tree.points.dtype)
                    np.add.at(within, best, tree.sums[hi] - tree.sums[lo])
                    np.add.at(sizes[p], best, hi - lo)
                    sums[p] += within.astype(object)
        for p, count in enumerate(sizes):
            used = np.flatnonzero(count)
            columns = [[p] * len(used), used.tolist(), count[used].tolist(), [sums[p][e].tolist() for e in used]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["part", "entry", "n", "sums"])

    rows = stored.select("trees").mapInArrow(partial, "part int, entry int, n long, sums array<long>")
    totals = F.array(*[F.sum(F.col("sums")[i]) for i in range(size)])
    moved = [list(book) for book in books]
    for r in rows.groupBy("part", "entry").agg(F.sum("n").alias("n"), totals.alias("sums")).collect():
        moved[r["part"]][r["entry"]] = floor_means(r["sums"], r["n"])
    return moved


def encode(found: Coding) -> DataFrame:
    """(vec_id, label, code, error): entry numbers in part order, two hex digits each, and the summed squared distance.

    Codebooks of more than 256 entries take as many digits as their last number needs.
    """
    arrays = [np.array(book, np.int64) for book in found.books]
    entries = max([256, *map(len, arrays)])
    digits = len(f"{entries - 1:x}")
    spelt = np.array([f"{e:0{digits}x}" for e in range(entries)], object)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, blobs in zip(*batch.columns, strict=True):
                code, error = np.full(len(ids.values), "", object), np.zeros(len(ids.values), object)
                for tree, book in _trees(blobs.as_py(), arrays):
                    lo, hi, best = search(tree, book)
                    entry = np.empty(len(code), np.int64)
                    entry[tree.order[runs(lo, hi - lo)]] = np.repeat(best, hi - lo)
                    points = np.empty_like(tree.points)
                    points[tree.order] = tree.points
                    code += spelt[entry]
                    error += squares(points, book[entry]).astype(object)
                columns = [ids.values, labels.values, pa.array(code, pa.string()), pa.array(error, pa.int64())]
                yield pa.record_batch(columns, ["vec_id", "label", "code", "error"])

    kind = found.blocks.schema["labels"].dataType.elementType.simpleString()
    blocks_ = found.blocks.select("ids", "labels", "trees")
    return blocks_.mapInArrow(coded, f"vec_id long, label {kind}, code string, error long")


def digest(found: Coding) -> str:
    """sha256 of all components of the codebooks, by part, entry and position."""
    values = [str(x) for book in found.books for entry in book for x in entry]
    return hashlib.sha256(",".join(values).encode()).hexdigest()


def with_label_error(codes: DataFrame) -> DataFrame:
    """Codes with the error summed over rows of an equal label; null labels are equal.

    Codes and sums are written first, so that a label with a large share of the rows is
    split in the join like any skewed key, and few labels are broadcast by their known size.
    """
    codes = keep(codes)
    sums = keep(codes.groupBy("label").agg(F.sum("error").alias("label_error")))
    same = codes["label"].eqNullSafe(sums["label"])
    return codes.join(sums, same).select(codes["vec_id"], codes["label"], "code", "error", "label_error")
