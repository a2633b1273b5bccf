"""Chunks of documents that ask questions about the whole corpus and get the answers back.

A chunk is a bounded number of whole documents (a longer document is a chunk of
its own) in one row of a staged table. Chunks send packed, sorted key arrays to
the partitions that own the keys; a partition answers each chunk in the chunk's
own order, so an answer needs no keys. Packed arrays take a fraction of the disk
and network of one row per key. The staged table is bucketed by chunk, so answers
meet their chunks again without moving the chunks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from ..session import shared_folder
from .common import width


def keep_bucketed(df: DataFrame, key: str) -> DataFrame:
    """Write a table bucketed by `key` to the cluster's shared folder and go on from the copy.

    Only tables can be bucketed, so it is one until its files are found; the catalog keeps nothing.
    """
    spark, name = df.sparkSession, f"wearline_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/wearline-llm/{name}"
    df.write.option("path", path).bucketBy(width(spark), key).format("parquet").saveAsTable(name)
    copy = spark.table(name)
    spark.sql(f"drop table {name}")
    return copy


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one, so that of many large ones only one is unpacked at a time."""
    for batch in batches:
        names = batch.schema.names
        for i in range(batch.num_rows):
            yield {n: batch.column(j)[i].as_py() for j, n in enumerate(names)}


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Runs of rows with an equal key."""
    now, held = None, []
    for row in rows_of(batches):
        if held and row[key] != now:
            yield now, held
            held = []
        now = row[key]
        held.append(row)
    if held:
        yield now, held


def chunk_numbers() -> Iterator[int]:
    """Numbers no other task of the job uses."""
    base = TaskContext.get().partitionId() << 32
    while True:
        yield base
        base += 1


def by_owner(df: DataFrame, key: str, answer: Callable, schema: str) -> DataFrame:
    """Run `answer(key, rows)` for every key's rows; it yields tuples of the schema's columns."""
    names = [x.split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, rows in groups_of(batches, key):
            for part in answer(k, rows):
                yield pa.record_batch([pa.array([x], kinds[n]) for x, n in zip(part, names, strict=True)], names)

    kinds = arrow_kinds(schema)
    return df.repartition(width(df.sparkSession), key).sortWithinPartitions(key).mapInArrow(run, schema)


def arrow_kinds(schema: str) -> dict[str, pa.DataType]:
    known = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string()}
    known |= {"boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<binary>": pa.list_(pa.binary())}
    return {x.split()[0]: known[x.split()[1]] for x in schema.split(",")}


def cuts(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the ranges of `parts` equal shares of the 64-bit key space begin in an ascending array."""
    borders = (np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype(np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, borders), [len(keys)]))
