"""The feature registry, one-hot columns and the scaler in column form."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashgrade.functions import interactions, temporal
from crashgrade.operators.reshape import per_column


@dataclass(frozen=True)
class Feature:
    name: str
    group: str
    scaled: bool = True


def _group(group: str, *names: str, scaled: bool = True) -> list[Feature]:
    return [Feature(n, group, scaled) for n in names]


# Our own names for the features of the seven groups.
REGISTRY = [
    *_group("climate", "temp_c", "dew_c", "precip", "wind_ms"),
    *_group(
        "road", "mean_speed", "lanes", "n_segments", "road_len", "n_curves", "n_bridges",
        "n_tunnels", "n_signals", "bridge_len",
    ),
    *_group("surroundings", "n_hospitals", "n_schools", "n_fuel"),
    *_group("surroundings", "urban", scaled=False),
    *_group(
        "hex", "hex9_road_len", "hex10_road_len", "hex11_road_len", "hex9_n_curves",
        "hex10_bridge_len",
    ),
    *_group(
        "hex", "road_error", "road_purchase", "road_signup", "road_view",
        "dominant_large", "dominant_medium", "dominant_promo", "dominant_small",
        "dominant_standard", "dominant_other", "road_other", scaled=False,
    ),
    *_group("time", "hour", "weekday", "month"),
    *_group("time", "rush_hour", scaled=False),
    *_group("interaction", "rain_x_curves", "temp_x_curvature", "speed_x_lanes"),
    *_group("country", "country_flag", scaled=False),
]
# Accidents as the sources report them have no road type of their own.
SOURCE_REGISTRY = [
    f for f in REGISTRY
    if f.name not in ("road_error", "road_purchase", "road_signup", "road_view", "road_other")
]
INTERACTIONS = ("rain_x_curves", "temp_x_curvature", "speed_x_lanes")


def registry_table(spark: SparkSession, names: Sequence[str], registry: Sequence[Feature] = REGISTRY) -> DataFrame:
    """position, feature, feature_group of the named features, in registry order."""
    chosen = set(names)
    rows = [f for f in registry if f.name in chosen]
    return spark.createDataFrame(
        [(i, f.name, f.group) for i, f in enumerate(rows)],
        "position int, feature string, feature_group string",
    )


def select_features(
    df: DataFrame, names: Sequence[str], key: str, target: str = "severe",
    registry: Sequence[Feature] = REGISTRY,
) -> DataFrame:
    """Projects the key, the target and the accepted features as
    `<group>__<name>`, in registry order."""
    chosen = set(names)
    return df.select(
        key,
        target,
        *[F.col(f.name).alias(f"{f.group}__{f.name}") for f in registry if f.name in chosen],
    )


def temporal_features(df: DataFrame, ts: str = "accident_ts") -> DataFrame:
    t = F.col(ts)
    return df.withColumns(
        {
            "hour": temporal.hour_of_day(t),
            "weekday": temporal.day_of_week(t),
            "month": temporal.month(t),
            "rush_hour": temporal.rush_hour(t),
        }
    )


def interaction_features(df: DataFrame) -> DataFrame:
    curve_density = interactions.curvature(F.col("n_curves"), F.col("road_len"))
    return df.withColumns(
        {
            "rain_x_curves": interactions.rain_x_curves(F.col("precip"), F.col("n_curves")),
            "temp_x_curvature": interactions.temp_x_curvature(F.col("temp_c"), curve_density),
            "speed_x_lanes": interactions.speed_x_lanes(F.col("mean_speed"), F.col("lanes")),
        }
    )


def one_hot(df: DataFrame, column: str, levels: Sequence[str], prefix: str) -> DataFrame:
    """A 0/1 column per level, and `<prefix>other` for a missing value or any
    other level, so that exactly one of them is 1 and neither is mistaken for
    a level left out of a model as its baseline."""
    flags = {level: F.coalesce((F.col(column) == level).cast("int"), F.lit(0)) for level in levels}
    listed = F.coalesce(F.col(column).isin(*levels), F.lit(False))
    return df.withColumns(
        {f"{prefix}{level.lower()}": flag for level, flag in flags.items()}
        | {f"{prefix}other": (~listed).cast("int")}
    )


def fit_scaler(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and population deviation per column: feature, mean, deviation."""
    return per_column(train, cols, {"mean": F.avg, "deviation": F.stddev_pop})


def apply_scaler(df: DataFrame, stats: DataFrame) -> DataFrame:
    """Z-scores with the given statistics. A constant column, or a missing
    value, gives 0. The statistics are one row per column and become constants
    of the plan."""
    scaled = {}
    for row in stats.collect():
        value = F.col(row["feature"]).cast("double")
        if row["deviation"]:
            z = (value - F.lit(row["mean"])) / F.lit(row["deviation"])
            scaled[row["feature"]] = F.coalesce(z, F.lit(0.0))
        else:
            scaled[row["feature"]] = F.lit(0.0)
    return df.withColumns(scaled)
