"""Named queries over a folder of tables, each with its check query where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            return tidy(fn(spark, d))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check
        return fn

    return add


def six_decimals(c: Column) -> Column:
    """Rounded half away from zero in binary arithmetic, as other engines do; `round` would go through decimals."""
    near = F.floor(F.abs(c) * 1e6 + 0.5) / 1e6
    near = F.when(c < 0, -near).otherwise(near)
    return F.when(F.isnan(c) | (F.abs(c) >= 1e12), c).when(near == 0, F.lit(0.0)).otherwise(near)


def tidy(df: DataFrame) -> DataFrame:
    """Result types that compare across engines: bigint and double with 6 decimals."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if kind in ("integer", "short", "byte"):
            c = c.cast("long")
        elif kind in ("double", "float", "decimal"):
            c = six_decimals(c.cast("double"))
        out.append(c.alias(f.name))
    return df.select(*out)
