"""Nearest neighbours by largest inner product as a block matrix join.

Queries and candidates are packed into blocks: int8 codes with one scale per row,
and the float vectors. The blocks are laid on a grid and joined by grid cell. A
tile is the product of the int8 codes, and each code is off by half a step at
most, so every estimate comes with a bound on its error. Per query, candidates
whose upper bound is under the k-th largest lower bound cannot be among the k
nearest; the survivors are recomputed in double precision from the vectors as
given, as are pairs whose bounds are not finite. Heaps of k keep the best of one
query block against the candidates of a cell, and heaps merge them per query; a
task never holds more than one block's. The result is exact.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import width, workers_import_this
from .exchange import rows_of

#: Rows in a block.
BLOCK_ROWS = 2048

#: float32 products of int8 codes stay exact up to this many summed terms.
EXACT_TERMS = 1024


def usable(vector: str) -> F.Column:
    """Is the vector present, without null or non-finite components, and not zero?"""
    v = F.col(f"`{vector}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed from the first component to the last."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Pack (id, vector) rows of one partition into blocks of equal dimension."""
    held: dict[int, list[tuple[int, np.ndarray]]] = {}

    def packed(dim: int) -> pa.RecordBatch:
        part = held.pop(dim)
        ids = np.array([i for i, _ in part], np.int64)
        x = np.array([v for _, v in part], np.float64)
        step = np.abs(x).max(axis=1) / 127
        step[step == 0] = np.finfo(np.float64).tiny
        codes = np.rint(x / step[:, None]).astype(np.int8)
        # the rounding error of the codes, and the float error of computing them
        error = np.abs(x - codes * step[:, None]).max(axis=1) * (1 + 1e-9)
        cells = [ids.tobytes(), x.tobytes(), codes.tobytes(), step.tobytes(), error.tobytes()]
        return pa.record_batch(
            [pa.array([dim], pa.int32())] + [pa.array([c], pa.binary()) for c in cells],
            ["dim", "ids", "x", "codes", "step", "error"],
        )

    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            values = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            held.setdefault(len(values), []).append((i, values))
            if len(held[len(values)]) >= rows:
                yield packed(len(values))
    for dim in list(held):
        yield packed(dim)


class _Block:
    def __init__(self, dim: int, ids: bytes, x: bytes, codes: bytes, step: bytes, error: bytes):
        self.ids = np.frombuffer(ids, np.int64)
        self.x = np.frombuffer(x, np.float64).reshape(len(self.ids), dim)
        self.codes = np.frombuffer(codes, np.int8).reshape(len(self.ids), dim).astype(np.float32)
        self.step, self.error = np.frombuffer(step), np.frombuffer(error)
        self.sum = np.abs(self.x).sum(axis=1)


def _tile(q: _Block, c: _Block, k: int) -> Iterator[tuple[int, list[tuple[float, int]]]]:
    """Per query row: the k nearest of the block's candidates as (score, -id), exact."""
    dim = q.x.shape[1]
    product = np.zeros((len(q.ids), len(c.ids)))
    for s in range(0, dim, EXACT_TERMS):
        product += q.codes[:, s : s + EXACT_TERMS] @ c.codes[:, s : s + EXACT_TERMS].T
    estimate = product * q.step[:, None] * c.step
    # |xy - x'y'| <= |x - x'| |y| + |x'| |y - y'|, component by component
    slack = q.error[:, None] * c.sum + (q.sum + dim * q.error)[:, None] * c.error
    slack = slack * (1 + 1e-9) + 1e-12 * q.sum[:, None] * c.sum
    lower, upper = estimate - slack, estimate + slack
    own = q.ids[:, None] == c.ids
    lower[own] = upper[own] = -np.inf
    if len(c.ids) > k:
        bar = np.partition(lower, len(c.ids) - k, axis=1)[:, len(c.ids) - k]
    else:
        bar = np.full(len(q.ids), -np.inf)
    rows, columns = np.nonzero(~(upper < bar[:, None]) & ~own)  # also where a bound is not a number
    score = np.empty(len(rows))
    for s in range(0, len(rows), 1 << 16):
        part = slice(s, s + (1 << 16))
        score[part] = inner(q.x[rows[part]], c.x[columns[part]])
    order = np.lexsort((c.ids[columns], -score, rows))
    rows, columns, score = rows[order], columns[order], score[order]
    starts = np.searchsorted(rows, np.arange(len(q.ids) + 1))
    for i in range(len(q.ids)):
        part = slice(starts[i], min(starts[i] + k, starts[i + 1]))
        yield int(q.ids[i]), list(zip(score[part].tolist(), (-c.ids[columns[part]]).tolist(), strict=True))


_SIDE = ("ids", "x", "codes", "step", "error")


def search(
    queries: DataFrame, candidates: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k nearest candidates, ties to the smaller id.

    A candidate with the query's own id is left out, and fewer candidates than k are
    all returned. Unusable vectors (null, zero, with null or non-finite components)
    and rows without an id take no part; vectors of another dimension than the
    query's are no candidates. Repeated rows are separate candidates.
    """
    spark = queries.sparkSession
    workers_import_this(spark)

    def packed(df: DataFrame) -> DataFrame:
        rows = df.where(usable(vector) & F.col(f"`{vec_id}`").isNotNull()).select(
            F.col(f"`{vec_id}`").cast("long"), F.col(f"`{vector}`").cast("array<double>")
        )
        kind = "dim int, ids binary, x binary, codes binary, step binary, error binary"
        blocks = rows.mapInArrow(lambda b: _blocks(b, BLOCK_ROWS), kind)
        return blocks.withColumn("turn", F.abs(F.xxhash64("ids")))

    grid = max(1, int(width(spark) ** 0.5))
    q = packed(queries).select("dim", (F.col("turn") % grid).alias("row"), *[F.col(c).alias(f"q_{c}") for c in _SIDE])
    c = packed(candidates).select("dim", (F.col("turn") % grid).alias("column"), *[F.col(c).alias(f"c_{c}") for c in _SIDE])
    side = F.array(*[F.lit(i).cast("long") for i in range(grid)])
    q = q.withColumn("column", F.explode(side))
    c = c.withColumn("row", F.explode(side))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        now, left = None, None
        for r in rows_of(batches):
            if r["q_ids"] != now:  # the join hands on a query block with all candidate blocks of its cell
                yield from _rows(heaps.items())
                heaps, now = {}, r["q_ids"]
                left = _Block(r["dim"], *[r[f"q_{x}"] for x in _SIDE])
            right = _Block(r["dim"], *[r[f"c_{x}"] for x in _SIDE])
            for i, found in _tile(left, right, k):
                heap = heaps.setdefault(i, [])
                for item in found:
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)
                    else:
                        break
        yield from _rows(heaps.items())

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            now, heap = None, []
            for batch in batches:
                for i, v, s in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                    if i != now:
                        if heap:
                            yield now, heap
                        now, heap = i, []
                    if len(heap) < k:
                        heapq.heappush(heap, (s, -v))
                    else:
                        heapq.heappushpop(heap, (s, -v))
            if heap:
                yield now, heap

        yield from _rows(groups(), ranked=True)

    pairs = q.join(c.hint("merge"), ["dim", "row", "column"]).drop("row", "column")
    kept = pairs.mapInArrow(best, "query_id long, vec_id long, score double")
    dealt = kept.repartition(width(spark), "query_id").sortWithinPartitions("query_id")
    return dealt.mapInArrow(merged, "query_id long, vec_id long, score double, rank int").select(
        "query_id", "rank", "vec_id", "score"
    )


def _rows(heaps, ranked: bool = False) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        out.clear()
        kinds = [("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("rank", pa.int32())]
        chosen = kinds if ranked else kinds[:3]
        return pa.record_batch(
            [pa.array(x, t) for x, (_, t) in zip(columns, chosen, strict=False)], [n for n, _ in chosen]
        )

    for i, heap in heaps:
        for r, (score, v) in enumerate(sorted(heap, reverse=True), 1):
            out.append((i, -v, score, r))
        if len(out) > 50_000:
            yield batch()
    yield batch()
