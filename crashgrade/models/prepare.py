"""From a feature table to the vector the models are trained on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashgrade.functions.arithmetic import ratio


def as_doubles(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def fit_preparation(train: DataFrame, scaled: Sequence[str], flags: Sequence[str]) -> PipelineModel:
    """Missing values to the training mean, z-scores of the numeric columns with
    training statistics, 0/1 columns as they are, all in the vector `features`."""
    scaled, flags = list(scaled), list(flags)
    filled = [f"{c}_filled" for c in scaled]
    stages = [
        Imputer(inputCols=scaled, outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="z", withMean=True, withStd=True),
        VectorAssembler(inputCols=["z", *flags], outputCol="features"),
    ]
    return Pipeline(stages=stages).fit(as_doubles(train, [*scaled, *flags]))


def prepare(model: PipelineModel, df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    return model.transform(as_doubles(df, cols)).select(*keep, "features")


def class_weights(train: DataFrame, target: str = "severe") -> DataFrame:
    """Negatives, positives, and the weight of a positive row: their ratio."""
    return train.agg(
        F.count_if(F.col(target) == 0).alias("n_negative"),
        F.count_if(F.col(target) == 1).alias("n_positive"),
    ).withColumn("positive_weight", ratio(F.col("n_negative"), F.col("n_positive")))


def positive_weight(train: DataFrame, target: str = "severe") -> float:
    weight = class_weights(train, target).first()["positive_weight"]
    if not weight:
        raise ValueError("training rows need both classes")
    return weight


def weight_column(weight: float, target: str = "severe") -> Column:
    return F.when(F.col(target) == 1, F.lit(float(weight))).otherwise(F.lit(1.0))
