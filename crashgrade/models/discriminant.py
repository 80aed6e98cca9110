"""Linear discriminant analysis for two classes.

Two distributed passes: class means, then the pooled covariance of the rows
after their own class's mean is taken off, which keeps the digits that large
means would cost. Only p x p numbers reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Discriminant:
    """P(severe) = 1 / (1 + exp(-(intercept + coefficients . x)))."""

    names: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def probability(self, features: str = "features") -> Column:
        """Score of a feature vector, as a column."""
        weights = F.array(*[F.lit(w) for w in self.coefficients])
        products = F.zip_with(vector_to_array(features), weights, lambda x, w: x * w)
        return _sigmoid(F.aggregate(products, F.lit(self.intercept), lambda a, b: a + b))

    def probability_of(self, columns: dict[str, Column]) -> Column:
        """Score of separate columns."""
        total = F.lit(self.intercept)
        for name, weight in zip(self.names, self.coefficients):
            total = total + columns[name] * F.lit(weight)
        return _sigmoid(total)


def _sigmoid(t: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-t))


def fit_lda(
    train: DataFrame, cols: Sequence[str], target: str = "severe", balanced: bool = False
) -> Discriminant:
    """`cols` are numeric columns without missing values. `balanced` gives both
    classes the same prior instead of their share."""
    cols = list(cols)
    x = [F.col(c).cast("double") for c in cols]
    by_class = {
        row[target]: row
        for row in train.groupBy(target)
        .agg(F.count("*").alias("n_rows"), *[F.avg(v).alias(f"m{i}") for i, v in enumerate(x)])
        .collect()
    }
    if set(by_class) != {0, 1}:
        raise ValueError("training rows need both classes")
    means = {k: np.array([row[f"m{i}"] for i in range(len(cols))]) for k, row in by_class.items()}
    counts = {k: row["n_rows"] for k, row in by_class.items()}

    centred = train.select(
        *[
            (
                v
                - F.when(F.col(target) == 1, F.lit(float(means[1][i]))).otherwise(
                    F.lit(float(means[0][i]))
                )
            ).alias(f"c{i}")
            for i, v in enumerate(x)
        ]
    )
    pooled = _covariance(centred) * (sum(counts.values()) / (sum(counts.values()) - 2))
    gap = means[1] - means[0]
    # A column that never varies within a class, or repeats others, gets no
    # weight of its own: least squares takes the shortest solution.
    weights = np.linalg.lstsq(pooled, gap, rcond=1e-10)[0]
    prior = 0.0 if balanced else float(np.log(counts[1] / counts[0]))
    intercept = prior - 0.5 * float((means[1] + means[0]) @ weights)
    return Discriminant(tuple(cols), tuple(float(w) for w in weights), intercept)


def _covariance(centred: DataFrame) -> np.ndarray:
    """Population covariance: correlations times deviations."""
    names = centred.columns
    row = centred.agg(*[F.stddev_pop(c).alias(c) for c in names]).first()
    deviations = np.array([row[c] for c in names])
    alive = [c for c, d in zip(names, deviations) if d > 0]
    matrix = np.zeros((len(names), len(names)))
    if alive:
        vectors = VectorAssembler(inputCols=alive, outputCol="v").transform(centred)
        corr = Correlation.corr(vectors.select("v"), "v").first()[0].toArray()
        at = [names.index(c) for c in alive]
        matrix[np.ix_(at, at)] = corr
    return matrix * np.outer(deviations, deviations)


def fit_lda_on_vector(
    train: DataFrame, names: Sequence[str], target: str = "severe", balanced: bool = True
) -> Discriminant:
    """The same from a feature vector whose entries are called `names`."""
    entries = vector_to_array(F.col("features"))
    columns = train.select(target, *[entries[i].alias(n) for i, n in enumerate(names)])
    return fit_lda(columns, names, target, balanced)


def discriminant_table(spark: SparkSession, model: Discriminant) -> DataFrame:
    """One row per coefficient, and the intercept at position -1."""
    rows = [(-1, "(intercept)", model.intercept)]
    rows += [(i, n, w) for i, (n, w) in enumerate(zip(model.names, model.coefficients))]
    return spark.createDataFrame(rows, "position int, feature string, coefficient double")


def save_lda(spark: SparkSession, model: Discriminant, path: str) -> None:
    discriminant_table(spark, model).write.mode("overwrite").parquet(path)


def load_lda(spark: SparkSession, path: str) -> Discriminant:
    rows = spark.read.parquet(path).orderBy("position").collect()
    return Discriminant(
        tuple(r["feature"] for r in rows[1:]),
        tuple(r["coefficient"] for r in rows[1:]),
        rows[0]["coefficient"],
    )
