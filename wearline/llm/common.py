"""What the operators of this subpackage share: staged tables, worker paths, packed arrays."""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SPACES = rb"\x20\x09-\x0D"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


#: Where modules keep what a worker has loaded, by module.
LOADED = {"bpe": "_loaded", "pieces": "_loaded", "langid": "_models"}


def release(keep: str | None = None) -> None:
    """Forget the models and vocabularies that tasks of other operators have left in this worker.

    Workers outlive stages, and the next stage needs their memory for itself.
    """
    for name, cache in LOADED.items():
        module = sys.modules.get(f"{__package__}.{name}")
        if module is not None and name != keep:
            getattr(module, cache).clear()


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Arrow batches of at most `size` for the jobs inside, where rows hold texts and a task needs memory beside them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, *frames: DataFrame) -> str:
    """The name, with as many underscores behind it as it takes to differ from all columns."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def workers_import_this(spark: SparkSession) -> None:
    """Let Python workers import the package when it is not installed but run from its folder."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *[p for p in paths if p]])


def keep(df: DataFrame) -> DataFrame:
    """Write an intermediate table to the cluster's shared folder and go on from the copy.

    The copy cuts the lineage and survives lost executors. The folder belongs to
    the cluster's checkpoint housekeeping.
    """
    path = f"{shared_folder(df.sparkSession)}/wearline-llm/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def expand(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def pack(values: np.ndarray) -> bytes:
    """An integer array, its bytes grouped by significance, then compressed."""
    raw = np.ascontiguousarray(values)
    planes = raw.view(np.uint8).reshape(len(raw), raw.itemsize).T
    return squeeze(raw.dtype.str.encode().ljust(4) + np.ascontiguousarray(planes).tobytes())


def unpack(packed: bytes) -> np.ndarray:
    raw = expand(packed)
    kind = np.dtype(raw[:4].decode().strip())
    planes = np.frombuffer(raw, np.uint8, offset=4).reshape(kind.itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def pack_sorted(values: np.ndarray) -> bytes:
    """Ascending unsigned integers as differences."""
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(packed: bytes) -> np.ndarray:
    steps = unpack(packed)
    return np.cumsum(steps, dtype=steps.dtype)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits (multiply and fold, twice)."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD1B54A32D192ED03)
    h ^= h >> np.uint64(32)
    return h
