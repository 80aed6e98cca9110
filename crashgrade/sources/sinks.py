"""Stored results: the clean base, accepted features, thresholds, metrics, models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

FEATURES_DDL = "position int, feature string, feature_group string"
THRESHOLDS_DDL = "model string, threshold double, f1 double"


def write_clean(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_clean(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_features(features: DataFrame, path: str) -> None:
    """`features` has the columns position, feature and feature_group."""
    features.select("position", "feature", "feature_group").write.mode("overwrite").json(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEATURES_DDL).json(path)


def write_thresholds(thresholds: DataFrame, path: str) -> None:
    thresholds.select("model", "threshold", "f1").write.mode("overwrite").json(path)


def read_thresholds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(THRESHOLDS_DDL).json(path)


def write_metrics(tables: dict[str, DataFrame], folder: str) -> None:
    """Metrics, confusion matrices and importances, one Parquet table each."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def read_metrics(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def save_models(models: dict[str, PipelineModel], folder: str) -> None:
    for name, model in models.items():
        model.write().overwrite().save(f"{folder}/{name}")


def load_models(names: list[str], folder: str) -> dict[str, PipelineModel]:
    return {name: PipelineModel.load(f"{folder}/{name}") for name in names}
