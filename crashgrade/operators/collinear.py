"""Correlations and variance inflation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashgrade.operators.reshape import per_column

MAX_VIF = 10.0


def _survey(df: DataFrame, cols: Sequence[str]) -> tuple[list[str], dict[str, float]]:
    """The columns with more than one value, and the mean of each of them."""
    surveyed = per_column(df, cols, {"varies": lambda v: F.min(v) < F.max(v), "mean": F.avg})
    found = {row["feature"]: row for row in surveyed.collect()}
    varying = [c for c in cols if found[c]["varies"]]
    return varying, {c: found[c]["mean"] for c in varying}


def _correlation(df: DataFrame, cols: Sequence[str], means: dict[str, float]) -> np.ndarray:
    """Pearson matrix from a distributed pass; p x p numbers reach the driver.
    Missing values count as the mean of their column."""
    filled = df.select(
        *[F.coalesce(F.col(c).cast("double"), F.lit(means[c])).alias(c) for c in cols]
    )
    assembled = VectorAssembler(inputCols=list(cols), outputCol="v").transform(filled)
    return Correlation.corr(assembled.select("v"), "v").first()[0].toArray()


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per ordered pair of columns: feature_a, feature_b, correlation,
    which is null where a column has a single value."""
    varying, means = _survey(df, cols)
    found = _correlation(df, varying, means)
    at = {c: i for i, c in enumerate(varying)}
    rows = [
        (a, b, float(found[at[a], at[b]]) if a in at and b in at else None)
        for a in cols
        for b in cols
    ]
    return df.sparkSession.createDataFrame(
        rows, "feature_a string, feature_b string, correlation double"
    )


def _inflation(matrix: np.ndarray) -> np.ndarray:
    """Diagonal of the inverse; columns tied to others exactly count as infinite."""
    values, vectors = np.linalg.eigh(matrix)
    tied = values < 1e-10
    if not tied.any():
        return (vectors**2 / values).sum(axis=1)
    in_null_space = (vectors[:, tied] ** 2).sum(axis=1) > 1e-8
    kept = ~tied
    finite = (vectors[:, kept] ** 2 / values[kept]).sum(axis=1)
    return np.where(in_null_space, np.inf, finite)


def vif(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Variance inflation of each column that varies: feature, vif."""
    cols, means = _survey(df, cols)
    found = _inflation(_correlation(df, cols, means)) if cols else []
    return df.sparkSession.createDataFrame(
        [(c, float(v)) for c, v in zip(cols, found)], "feature string, vif double"
    )


def vif_stepwise(df: DataFrame, cols: Sequence[str], max_vif: float = MAX_VIF) -> DataFrame:
    """Removes the worst column above the limit until none is.

    One row per column: feature, step (of its removal, null for survivors),
    vif (at removal, or at the end) and kept. Columns with a single value go
    first, at step 0. The data are read once; the steps only shrink the matrix.
    """
    spark: SparkSession = df.sparkSession
    left, means = _survey(df, cols)
    rows = [(c, 0, None, False) for c in cols if c not in left]
    matrix = _correlation(df, left, means) if left else None
    step = 0
    while left:
        found = _inflation(matrix)
        worst = int(np.argmax(found))
        if found[worst] <= max_vif:
            rows += [(c, None, float(v), True) for c, v in zip(left, found)]
            break
        step += 1
        rows.append((left[worst], step, float(found[worst]), False))
        left.pop(worst)
        matrix = np.delete(np.delete(matrix, worst, axis=0), worst, axis=1)
    return spark.createDataFrame(rows, "feature string, step int, vif double, kept boolean")


def interaction_verdict(trace: DataFrame, pairs: Sequence[str]) -> DataFrame:
    """Which interactions the stepwise test kept: feature, vif, accepted."""
    return trace.where(F.col("feature").isin(*pairs)).select(
        "feature", "vif", F.col("kept").alias("accepted")
    )
