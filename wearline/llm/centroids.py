"""Centroid clustering of integer vectors by Walsh-Hadamard progressive search.

The Walsh-Hadamard transform maps integers to integers and multiplies every squared
distance by the dimension. A vector is transformed once and kept by its coefficients,
coarse ones (few sign changes) first. To find a vector's centroid, squared coefficient
differences are added up from coarse to fine for all centroids. The one that is best
after the first coefficients is finished at once; what it comes to is a bound, and
partial sums only grow, so a centroid above the bound is strictly worse and goes.
The centroids left over get all coefficients, so distances and ties are exact.

A round adds up coefficients per centroid; sums transform back to sums. Only the
centroids and their sums (k rows) meet on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, pack, unpack, workers_import_this
from .vectors import blocks, exact, finite, first_rows, floor_means, whole

#: Rows in a stored block, and (row, centroid) pairs that a search begins with at once.
BLOCK_ROWS = 4096
PAIRS_AT_ONCE = 1 << 18


def transform(x: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Coefficients (dim, n) of vectors (n, dim) by sums and differences of halves; `order` sorts them coarse first."""
    out = np.ascontiguousarray(x.T)
    half = 1
    while half < len(out):
        pairs = out.reshape(len(out) // (2 * half), 2, half, out.shape[1])
        out = np.stack([pairs[:, 0] + pairs[:, 1], pairs[:, 0] - pairs[:, 1]], axis=1).reshape(out.shape)
        half *= 2
    return out[order]


def coarse_first(dim: int) -> np.ndarray:
    """Positions of the transform's natural order, by number of sign changes; `dim` is a power of two."""
    if dim < 1 or dim & (dim - 1):
        raise ValueError("the dimension must be a power of two")
    signs = transform(np.eye(dim, dtype=np.int64), np.arange(dim))
    return np.argsort((np.diff(signs, axis=1) != 0).sum(axis=1), kind="stable")


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, dim times squared distance) of the nearest centroid of each point; ties to the smaller number.

    Both sides are coefficients, one column per vector.
    """
    dim, n = points.shape
    rows = max(1, PAIRS_AT_ONCE // centroids.shape[1])
    found = [_nearest(points[:, i : i + rows], centroids, dim) for i in range(0, n, rows)]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _nearest(points: np.ndarray, centroids: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    steps = [min(8, dim), *[s for s in (16, 32, 64) if min(8, dim) < s < dim], dim]
    head = steps[0]
    partial = np.zeros((points.shape[1], centroids.shape[1]), points.dtype)
    for p, c in zip(points[:head], centroids[:head], strict=True):
        partial = partial + (p[:, None] - c) ** 2
    guess = partial.argmin(axis=1)
    bound = ((points - centroids[:, guess]) ** 2).sum(axis=0)
    row, number = np.nonzero(partial <= bound[:, None])
    total = partial[row, number]
    for lo, hi in pairwise(steps):
        total = total + ((points[lo:hi, row] - centroids[lo:hi, number]) ** 2).sum(axis=0)
        stay = total <= bound[row]
        row, number, total = row[stay], number[stay], total[stay]
    # pairs are ordered by row and number, and the guess of every row is still among them
    starts = np.searchsorted(row, np.arange(points.shape[1]))
    least = np.minimum.reduceat(total, starts)
    best = np.flatnonzero(total == least[row])
    _, firsts = np.unique(row[best], return_index=True)
    return number[best[firsts]].astype(np.int32), least


@dataclass
class Clustering:
    """Centroids as integer components, with the size and the summed squared distance of each, and the kept blocks."""

    blocks: DataFrame
    order: np.ndarray
    centroids: list[list[int]]
    sizes: list[int]
    inertias: list[int]


def fit(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dim: int = 64, k: int = 8, rounds: int = 10,
    seed: str = "3", scale: int = 1024,
) -> Clustering:
    """Lloyd's rounds from the k vectors whose sha256 of `seed:id` comes first.

    Takes part: vectors with exactly `dim` components (a power of two), none null or
    non-finite, as floor(scale * component). Null ids come last in the seeds' order,
    and of equal ids the smaller vector first. Repeated rows count each. Fewer vectors
    than k give as many centroids. A round that changes no centroid is the last.
    """
    spark = vectors.sparkSession
    workers_import_this(spark)
    row_id, x = F.col(f"`{vec_id}`").cast("long"), F.col(f"`{vector}`").cast("array<double>")
    kept = vectors.where(finite(vector) & (F.size(f"`{vector}`") == dim)).select(row_id.alias("vec_id"), x.alias("x"))
    order = coarse_first(dim)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values, (ids,) in blocks(batches, BLOCK_ROWS):
            coefficients = transform(whole(values, scale), order)
            column = pa.array([pack(coefficients.reshape(-1))], pa.binary())
            yield pa.record_batch([pa.array([ids.to_pylist()], pa.list_(pa.int64())), column], ["ids", "coefficients"])

    stored = keep(kept.mapInArrow(packed, "ids array<long>, coefficients binary"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = first_rows(kept, k, digest.asc_nulls_last(), F.col("x"))
    centroids = [whole(np.array(r["x"]), scale).tolist() for r in first]
    for _ in range(rounds):
        sums, sizes, _ = _round(stored, order, centroids)
        moved = [floor_means(s, n) if n else c for s, n, c in zip(sums, sizes, centroids, strict=True)]
        if moved == centroids:
            break
        centroids = moved
    _, sizes, inertias = _round(stored, order, centroids)
    return Clustering(stored, order, centroids, sizes, inertias)


def _assigned(blob: bytes, dim: int, coefficients: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(points, number, squared distance) of a stored block."""
    # dim * (2 * largest coefficient)^2 must fit 64 bits
    most = int((2**63 / (4 * dim)) ** 0.5) - dim
    points = exact(unpack(blob).reshape(dim, -1), most)
    number, total = nearest(points, coefficients.astype(points.dtype))
    return points, number, total // dim


def _round(stored: DataFrame, order: np.ndarray, centroids: list[list[int]]) -> tuple[list[list[int]], list[int], list[int]]:
    """(component sums, sizes, summed squared distances) of the vectors nearest to each centroid."""
    k, dim = len(centroids), len(order)
    if not k:
        return [], [], []
    coefficients = transform(np.array(centroids, np.int64), order)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes, inertia = np.zeros((k, dim), object), [0] * k, [0] * k
        for batch in batches:
            for blob in batch.column(0):
                points, number, distance = _assigned(blob.as_py(), dim, coefficients)
                for c in np.unique(number).tolist():
                    mine = number == c
                    sums[c] += points[:, mine].sum(axis=1).astype(object)
                    sizes[c] += int(mine.sum())
                    inertia[c] += int(distance[mine].sum())
        used = [c for c in range(k) if sizes[c]]
        columns = [used, [sizes[c] for c in used], [inertia[c] for c in used], [sums[c].tolist() for c in used]]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        yield pa.record_batch([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["cluster", "n", "inertia", "sums"])

    parts = stored.select("coefficients").mapInArrow(partial, "cluster int, n long, inertia long, sums array<long>")
    totals = [F.sum(F.col("sums")[i]) for i in range(dim)]
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum("inertia").alias("inertia"), F.array(*totals).alias("sums"))
    sums, sizes, inertia = [[0] * dim for _ in range(k)], [0] * k, [0] * k
    back = transform(np.eye(dim, dtype=np.int64), order).T.astype(object)
    for r in found.collect():
        sums[r["cluster"]] = [int(s) // dim for s in back @ np.array(r["sums"], object)]
        sizes[r["cluster"]], inertia[r["cluster"]] = r["n"], r["inertia"]
    return sums, sizes, inertia


def assign(found: Clustering) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row per vector that took part."""
    dim, order, inertias = len(found.order), found.order, found.inertias
    coefficients = transform(np.array(found.centroids, np.int64).reshape(-1, dim), order)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    total = sum(inertias)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, blob in zip(batch.column(0), batch.column(1), strict=True):
                _, number, distance = _assigned(blob.as_py(), dim, coefficients)
                columns = [
                    ids.values,
                    pa.array(number, pa.int32()),
                    pa.array(distance, pa.int64()),
                    pa.array([inertias[c] for c in number.tolist()], pa.int64()),
                    pa.array([total] * len(number), pa.int64()),
                    pa.array([digests[c] for c in number.tolist()], pa.string()),
                ]
                yield pa.record_batch(columns, names)

    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    kinds = ["long", "int", "long", "long", "long", "string"]
    schema = ", ".join(f"{n} {t}" for n, t in zip(names, kinds, strict=True))
    return found.blocks.select("ids", "coefficients").mapInArrow(rows, schema)
