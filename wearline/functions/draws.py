"""Random draws as pure functions of (seed, replicate, index).

A hash instead of a generator gives the same draw whatever the partitioning,
after a lost executor, and in any other SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 2**32


def hash_int(seed, *parts: Column) -> Column:
    """First 32 bits of md5('seed:part:part…') as a long in [0, 2^32)."""
    text = F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform(seed, *parts: Column) -> Column:
    """Uniform double in [0, 1)."""
    return hash_int(seed, *parts) / F.lit(float(SPAN))


def pick(seed, size: Column, *parts: Column) -> Column:
    """Uniform integer in 1..size."""
    return (F.floor(uniform(seed, *parts) * size) + 1).cast("long")
