"""Prediction records that arrive over time: skip finished keys, append, and keep run metrics current."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.metrics import concentration_of, error_metrics, value_frequencies
from ..operators.validate import pending


def arriving_records(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One JSON record per line, in files that appear in a folder."""
    return spark.readStream.schema(schema).json(folder)


def append_new(stream: DataFrame, store: str, checkpoint: str, keys: Sequence[str]) -> StreamingQuery:
    """Append records whose key is not stored yet.

    Each batch goes to a folder of its checkpoint and number and overwrites only
    that, so a batch that is repeated after a failure leaves the same rows, and a
    stream with a new checkpoint adds to the store. Keys are compared with all of
    the store but the batch's own folder. Give every checkpoint a path of its own.
    """
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    # an empty part, so that the store can always be read
    stream.sparkSession.createDataFrame([], stream.schema).write.mode("ignore").parquet(f"{store}/run=none/batch=0")

    def write(batch: DataFrame, number: int) -> None:
        stored = batch.sparkSession.read.schema(f"{schema_of(batch)}, run string, batch bigint").parquet(store)
        others = stored.where((F.col("run") != run) | (F.col("batch") != number))
        fresh = pending(batch.dropDuplicates(list(keys)), others, keys)
        fresh.write.mode("overwrite").parquet(f"{store}/run={run}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def stored_metrics(spark: SparkSession, store: str, by: Sequence[str]) -> DataFrame:
    return error_metrics(spark.read.parquet(store), list(by))


def append_distinct(
    stream: DataFrame, store: str, checkpoint: str, keys: Sequence[str], time: str, delay: str = "1 day"
) -> StreamingQuery:
    """Append records whose key has not come within `delay` before, without reading the store.

    The state holds the keys of the watermark's span only. Records may come late and out
    of order by up to `delay` of event time; a record behind the watermark is dropped, as
    its repetition could not be told from it any more. The file sink commits a batch
    once, whatever is repeated after a failure.
    """
    fresh = stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))
    sink = fresh.writeStream.format("parquet").option("path", store).option("checkpointLocation", checkpoint)
    return sink.outputMode("append").trigger(availableNow=True).start()


#: Running tables and what they hold, one row per group or per group and value.
RUNNING = {"errors": error_metrics, "values": value_frequencies}


def running_metrics(spark: SparkSession, store: str, schema: str, by: Sequence[str], out: str, checkpoint: str) -> list[StreamingQuery]:
    """Keep errors and value counts of the stored records current; a run reads new files of the store only.

    The state of a group is its partial sums, and a count for each of its values. Every
    batch leaves whole tables in a folder of its number, so a repeated batch leaves the same.
    """

    def save(name: str):
        return lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    running = []
    for name, table in RUNNING.items():
        rows = spark.readStream.schema(schema).parquet(store)
        sink = table(rows, list(by)).writeStream.foreachBatch(save(name)).option("checkpointLocation", f"{checkpoint}/{name}")
        running.append(sink.outputMode("complete").trigger(availableNow=True).start())
    return running


def _latest(spark: SparkSession, out: str, name: str) -> DataFrame:
    every = spark.read.parquet(f"{out}/{name}")
    return every.where(F.col("batch") == every.agg(F.max("batch")).first()[0]).drop("batch")


def current_errors(spark: SparkSession, out: str) -> DataFrame:
    return _latest(spark, out, "errors")


def current_concentration(spark: SparkSession, out: str, by: Sequence[str]) -> DataFrame:
    return concentration_of(_latest(spark, out, "values"), list(by))
