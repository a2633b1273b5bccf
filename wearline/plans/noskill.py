"""Does any configuration beat a forecast without skill?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import metrics as m
from ..operators.frames import with_rul
from ..session import shared
from . import bindings as b


def baselines(spark: SparkSession, d: str, traj: DataFrame | None = None, preds: DataFrame | None = None) -> DataFrame:
    traj = traj if traj is not None else shared(b.trajectories(spark, d))
    preds = preds if preds is not None else b.predictions(spark, d, traj)
    return m.constant_baselines(with_rul(traj, b.CAP), labels(preds), b.CAP)


def labels(preds: DataFrame) -> DataFrame:
    """One label per test unit: the truth is the same for every configuration."""
    return preds.groupBy("dataset", "unit").agg({"truth": "max"}).withColumnRenamed("max(truth)", "truth")


def beats_a_constant(spark: SparkSession, d: str) -> DataFrame:
    traj = shared(b.trajectories(spark, d))
    preds = shared(b.predictions(spark, d, traj))
    scored = m.error_metrics(preds.withColumnRenamed("n", "w"), ["dataset", "w", "q"])
    return m.beats_constant(scored, baselines(spark, d, traj, preds))
