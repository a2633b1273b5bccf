"""Supervised reference predictors on window features, and operating regimes."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import RUL_CAP, clip
from . import trees


def fit_regimes(train: DataFrame, settings: Sequence[str], k: int = 6, seed: int = 42):
    """k-means on the settings; returns a function that adds the regime to any table."""
    vec = VectorAssembler(inputCols=list(settings), outputCol="_settings")
    model = KMeans(k=k, seed=seed, featuresCol="_settings", predictionCol="regime").fit(vec.transform(train))
    return lambda df: model.transform(vec.transform(df)).drop("_settings").withColumn("regime", F.col("regime").cast("long"))


def fit_forest(train: DataFrame, features: Sequence[str], label: str = "rul", size: int = 200, seed: int = 42, depth: int = 12):
    """A random forest of the reference's size."""
    return _clipped(trees.fit_forest(train, features, label, replace(trees.FOREST, rounds=size, depth=depth, seed=seed)))


def fit_boosting(train: DataFrame, features: Sequence[str], label: str = "rul", rounds: int = 600, seed: int = 42, depth: int = 6):
    """Boosted trees of the reference's size."""
    return _clipped(trees.fit_boosting(train, features, label, trees.Settings(rounds=rounds, depth=depth, seed=seed)))


def _clipped(model):
    def predict(df: DataFrame, cap: float = RUL_CAP) -> DataFrame:
        return model(df, "_raw").withColumn("pred", clip("_raw", 0, cap)).drop("_raw")

    return predict


def feature_names(sensors: Sequence[str]) -> list[str]:
    return [f"{s}_{part}" for s in sensors for part in ("mean", "sd", "net")]
