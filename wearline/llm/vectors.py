"""Vectors as exact integers, packed into blocks of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest magnitude of a scaled component; the double it comes from is still a whole number of units.
LARGEST = 1 << 52


def finite(vector: str) -> Column:
    """Is the vector present and without null or non-finite components?"""
    v = F.col(f"`{vector}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def whole(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in double precision, as integers."""
    scaled = np.floor(values.astype(np.float64) * scale)
    if scaled.size and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST // scale} have no exact integer distances")
    return scaled.astype(np.int64)


def exact(values: np.ndarray, most: int) -> np.ndarray:
    """The integers themselves if no sum made of them can leave 64 bits (`most` is the bound), else as Python's."""
    return values if not values.size or max(-int(values.min()), int(values.max())) <= most else values.astype(object)


def blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[np.ndarray, list[pa.Array]]]:
    """(vectors, other columns) of `rows` rows at a time; the last column of the batches is the vector, of equal sizes."""
    held: list[pa.RecordBatch] = []

    def cut(part: list[pa.RecordBatch]) -> tuple[np.ndarray, list[pa.Array]]:
        table = pa.Table.from_batches(part).combine_chunks()
        values = [c.chunk(0) for c in table.columns]
        flat = values[-1].flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(table.num_rows, -1), values[:-1]

    count = 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, rows - count)
            held.append(part)
            count += part.num_rows
            batch = batch.slice(part.num_rows)
            if count == rows:
                yield cut(held)
                held, count = [], 0
    if held:
        yield cut(held)


def first_rows(df: DataFrame, n: int, *order: Column) -> list:
    """The first n rows of an order, on the driver; n is a parameter, not a share of the table."""
    return df.orderBy(*order).limit(n).collect()


def floor_means(sums: list[int], n: int) -> list[int]:
    return [s // n for s in sums]
