"""Session settings the operators are designed for."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def tuned(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Adaptive execution with skew splitting also where a later operator wants the join's layout."""
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.optimizer.windowGroupLimitThreshold", "1000000")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="wearline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def staging_path(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/wearline-stage/{uuid.uuid4().hex}"


def shared(df: DataFrame) -> DataFrame:
    """A table that several branches of a plan read: kept on the executors' disks once computed.

    Nothing runs until a result is asked for. A lost partition is computed again, and
    since draws are hashes it comes out the same.
    """
    return df.persist(StorageLevel.DISK_ONLY)


def spread(scan: DataFrame) -> DataFrame:
    """At least one partition per core for heavy work per row, where the table has fewer files than cores."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if len(scan.inputFiles()) >= cores else scan.repartition(cores)
