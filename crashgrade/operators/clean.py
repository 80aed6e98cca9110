"""Outliers, the binary target, dropped columns and exploration tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashgrade.functions.arithmetic import ratio
from crashgrade.operators.ranks import exact_quantiles
from crashgrade.operators.reshape import per_column

# Columns that would let a model memorise places or dates.
LEAKY = ("lat", "lon", "cell_9", "cell_10", "cell_11", "accident_ts", "obs_ts")


def outlier_bounds(df: DataFrame, cols: Sequence[str], k: float = 1.5, exact: bool = True) -> DataFrame:
    """Interquartile fences, one row per column: feature, lower, upper.

    `exact=False` reads the quartiles from a bounded sketch in a single pass.
    """
    if exact:
        quartiles = exact_quantiles(df, cols, {"q1": 0.25, "q3": 0.75})
    else:
        sketched = per_column(df, cols, {"q": lambda v: F.percentile_approx(v, [0.25, 0.75], 10000)})
        quartiles = sketched.select("feature", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    spread = F.lit(float(k)) * (F.col("q3") - F.col("q1"))
    return quartiles.select(
        "feature", (F.col("q1") - spread).alias("lower"), (F.col("q3") + spread).alias("upper")
    )


def remove_outliers(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Keeps the rows inside every fence. Null values are no outliers.

    The fences come to the driver, one row per column, and go into the plan
    as constants, so that the filter reaches the file scan.
    """
    keep = F.lit(True)
    for row in bounds.collect():
        value = F.col(row["feature"])
        keep = keep & (value.between(row["lower"], row["upper"]) | value.isNull())
    return df.where(keep)


def binarise_severity(
    df: DataFrame,
    severe_codes: Sequence[str],
    light_codes: Sequence[str],
    column: str = "severity",
) -> DataFrame:
    """Severe and fatal codes to 1, light and moderate ones to 0, null and any
    other code to null, so that a broken line does not become a light accident."""
    code = F.col(column)
    return df.withColumn(
        "severe", F.when(code.isin(*severe_codes), 1).when(code.isin(*light_codes), 0)
    )


def drop_leaky(df: DataFrame, columns: Sequence[str] = LEAKY) -> DataFrame:
    return df.drop(*columns)


def class_balance(df: DataFrame, target: str = "severe") -> DataFrame:
    """Rows and share of each class."""
    everything = Window.partitionBy()
    counts = df.groupBy(target).agg(F.count("*").alias("n_rows"))
    # The window runs over one row per class.
    return counts.withColumn("share", ratio(F.col("n_rows"), F.sum("n_rows").over(everything)))


def row_funnel(raw: DataFrame, clean: DataFrame, parts: DataFrame) -> DataFrame:
    """Row counts after each step: raw, clean, then every part."""

    def step(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy().agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("step"), "n_rows"
        )

    by_part = parts.groupBy("part").agg(F.count("*").alias("n_rows"))
    return (
        step(raw, "raw")
        .unionByName(step(clean, "clean"))
        .unionByName(by_part.withColumnRenamed("part", "step"))
    )


def profile(df: DataFrame, cols: Sequence[str], target: str = "severe") -> DataFrame:
    """Count, mean, deviation, extremes and quartiles of each column, in total
    (class "all") and per class."""
    values = df.select(
        F.col(target).cast("string").alias(target), *[F.col(c).cast("double").alias(c) for c in cols]
    )
    both = values.withColumn(
        "class", F.explode(F.array(F.lit("all"), F.col(target)))
    ).drop(target)
    statistics = {
        "n": F.count, "mean": F.avg, "deviation": F.stddev_pop, "lowest": F.min, "highest": F.max,
    }
    moments = per_column(both, cols, statistics, ["class"])
    quartiles = exact_quantiles(both, cols, {"q1": 0.25, "median": 0.5, "q3": 0.75}, ["class"])
    return moments.join(quartiles, ["class", "feature"], "left")


def severity_rate_by(df: DataFrame, factor: Column, name: str, target: str = "severe") -> DataFrame:
    """Rows and severe share per level of a factor."""
    return (
        df.groupBy(factor.cast("string").alias("level"))
        .agg(F.count("*").alias("n_rows"), F.sum(target).alias("n_severe"))
        .select(
            F.lit(name).alias("factor"),
            "level",
            "n_rows",
            ratio(F.col("n_severe"), F.col("n_rows")).alias("severe_share"),
        )
    )


def severity_rates(df: DataFrame, factors: dict[str, Column], target: str = "severe") -> DataFrame:
    """`severity_rate_by` for several factors, in one pass over the data."""
    levels = df.select(
        F.col(target).alias("severe"), *[c.cast("string").alias(n) for n, c in factors.items()]
    )
    return (
        levels.unpivot(["severe"], list(factors), "factor", "level")
        .groupBy("factor", "level")
        .agg(F.count("*").alias("n_rows"), F.sum("severe").alias("n_severe"))
        .select(
            "factor",
            "level",
            "n_rows",
            ratio(F.col("n_severe"), F.col("n_rows")).alias("severe_share"),
        )
    )


def histogram(
    df: DataFrame, column: str, lowest: float, highest: float, bins: int, target: str = "severe"
) -> DataFrame:
    """Rows per equal-width bin and class. Bin 0 is below the range, and bin
    `bins` + 1 is from its upper end on."""
    slot = F.width_bucket(F.col(column), F.lit(float(lowest)), F.lit(float(highest)), F.lit(bins))
    return df.groupBy(slot.alias("bin"), target).agg(F.count("*").alias("n_rows"))
