"""Outlier fences from sketches that can be stored and merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashgrade.functions.arithmetic import ratio
from crashgrade.operators.reshape import per_column

# Rank error of about 0.04%, in a few ten thousand bytes per column.
SKETCH_K = 4096


def column_sketches(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), k: int = SKETCH_K) -> DataFrame:
    """feature (and `by`) and a quantile sketch of the column's values, of
    bounded size: one pass, combined before the shuffle. Nulls and NaN do not
    count."""

    def sketch(v):
        return F.kll_sketch_agg_double(F.when(~F.isnan(v), v), F.lit(k))

    return per_column(df, cols, {"sketch": sketch}, by)


def merge_sketches(sketches: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """One sketch per feature, of the sketches of parts of the input. So a day
    of new rows is added without reading the old ones."""
    return sketches.groupBy("feature").agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def sketched_quartiles(sketches: DataFrame) -> DataFrame:
    """feature, n, q1, q3; no row for a column without values."""
    at = lambda share: F.kll_sketch_get_quantile_double("sketch", F.lit(share))
    counted = sketches.withColumn("n", F.kll_sketch_get_n_double("sketch")).where(F.col("n") > 0)
    return counted.select("feature", "n", at(0.25).alias("q1"), at(0.75).alias("q3"))


def sketched_bounds(sketches: DataFrame, k: float = 1.5) -> DataFrame:
    """Interquartile fences like `clean.outlier_bounds`: feature, lower, upper."""
    spread = F.lit(float(k)) * (F.col("q3") - F.col("q1"))
    return sketched_quartiles(sketches).select(
        "feature", (F.col("q1") - spread).alias("lower"), (F.col("q3") + spread).alias("upper")
    )


def rank_errors(df: DataFrame, quartiles: DataFrame) -> DataFrame:
    """How far the sketched quartiles lie from their ranks: feature, q1_error,
    q3_error, as shares of the rows. A quartile within a run of equal values is
    exact. The quartiles are one row per column and become constants."""
    found = quartiles.select("feature", "q1", "q3").collect()
    picks = []
    for i, row in enumerate(found):
        v = F.col(row["feature"]).cast("double")
        n = F.count_if(v.isNotNull() & ~F.isnan(v))
        for name, share in (("q1", 0.25), ("q3", 0.75)):
            below, up_to = (ratio(F.count_if(c), n) for c in (v < row[name], v <= row[name]))
            error = F.greatest(F.lit(0.0), below - share, share - up_to)
            picks.append(error.alias(f"{name}_{i}"))
    wide = df.agg(*picks) if picks else df.sparkSession.createDataFrame([(0,)], "_ int")
    rows = [
        F.struct(
            F.lit(r["feature"]).alias("feature"), F.col(f"q1_{i}").alias("q1_error"), F.col(f"q3_{i}").alias("q3_error")
        )
        for i, r in enumerate(found)
    ]
    empty = "array<struct<feature:string,q1_error:double,q3_error:double>>"
    return wide.select(F.inline(F.array(*rows) if rows else F.array().cast(empty)))
