"""Accident, road and weather tables derived from the given ones.

The given tables hold no accidents, so events stand for accidents and
observations, customers for places, and line items for road features. The
label is drawn from a known score, which no model may see.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crashgrade.functions import interactions, temporal
from crashgrade.functions.hashing import salted_hash
from crashgrade.operators.joins import join_dimension
from crashgrade.operators.weather import PER_DEGREE, to_utc
from crashgrade.sources.readers import utc_offset
from crashgrade.sources.tables import table, table_with_row_id

# Corner of the map square the points are spread over.
SOUTH, WEST = -23.70, -46.80
STANDARD_LATS = (-23.5, 39.5)
# Few points per square kilometre here, so the cells are large.
BASE_EDGE_M = 3000.0

ROAD_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
BRIDGE_TYPE = "ECONOMY"
ACCIDENT_ROADS = ("click", "error", "purchase", "signup", "view")
RESIDENTIAL = "view"


def _place(key: Column, lat_salt: str, lon_salt: str) -> tuple[Column, Column]:
    lat = F.lit(SOUTH) + salted_hash(lat_salt, key) % 4000 * F.lit(0.0001)
    lon = F.lit(WEST) + salted_hash(lon_salt, key) % 4000 * F.lit(0.0001)
    return lat, lon


def road_features(spark: SparkSession, folder: str) -> DataFrame:
    """One row per road feature."""
    items = table_with_row_id(
        spark, folder, "lineitem", "l_orderkey", "l_partkey", "l_quantity"
    )
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey")
    parts = table(spark, folder, "part", "p_partkey", "p_type", "p_size")
    keys = table(spark, folder, "lineitem", "l_orderkey", "l_partkey")
    placed = join_dimension(
        items, orders.withColumnRenamed("o_orderkey", "l_orderkey"), ["l_orderkey"], ["row_id"],
        key_source=keys,
    )
    typed = join_dimension(
        placed, parts.withColumnRenamed("p_partkey", "l_partkey"), ["l_partkey"], ["row_id"],
        key_source=keys,
    )
    size = F.col("p_size")
    kind = (
        F.when(size > 40, "curve")
        .when(size < 5, "signal")
        .when(size == 10, "hospital")
        .when(size.isin(11, 12), "school")
        .when(size.isin(13, 14), "fuel")
        .when(size == 20, "tunnel")
        .otherwise("plain")
    )
    lat, lon = _place(F.col("l_orderkey"), "flat", "flon")
    return typed.select(
        F.col("o_custkey").alias("zone_id"),
        F.col("l_orderkey").alias("feature_id"),
        F.col("p_type").alias("road_type"),
        F.col("l_quantity").alias("length_km"),
        F.col("p_size").alias("speed"),
        kind.alias("kind"),
        (F.col("o_custkey") % 4 + 1).cast("bigint").alias("lanes"),
        lat.alias("lat"),
        lon.alias("lon"),
    )


def zone_infra(features: DataFrame) -> DataFrame:
    """Road statistics per zone."""
    kind, bridge = F.col("kind"), F.col("road_type") == BRIDGE_TYPE
    return features.groupBy("zone_id").agg(
        F.count("*").alias("n_segments"),
        F.sum("length_km").alias("road_len"),
        F.sum(F.when(bridge, F.col("length_km")).otherwise(0.0)).alias("bridge_len"),
        F.count_if(bridge).alias("n_bridges"),
        *[
            F.count_if(kind == k).alias(n)
            for k, n in [
                ("curve", "n_curves"),
                ("signal", "n_signals"),
                ("tunnel", "n_tunnels"),
                ("hospital", "n_hospitals"),
                ("school", "n_schools"),
                ("fuel", "n_fuel"),
            ]
        ],
        (F.sum("speed").cast("double") / F.count("*")).alias("mean_speed"),
    ).withColumn("lanes", F.col("zone_id") % 4 + 1)


def zones(spark: SparkSession, folder: str, infra: DataFrame) -> DataFrame:
    """Zones with their country; both sides have one row per zone."""
    customers = table(spark, folder, "customer", "c_custkey", "c_nationkey").select(
        F.col("c_custkey").alias("zone_id"),
        (F.col("c_nationkey") % 2).cast("int").alias("country_flag"),
    )
    return infra.join(customers, "zone_id")


def weather(spark: SparkSession, folder: str) -> DataFrame:
    """One row per hour and grid point."""
    events = table(spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value")
    return (
        events.where(F.col("event_type") != "error")
        .groupBy(
            temporal.hour_floor(F.col("ts")).alias("hr"),
            (F.col("user_id") % 5).alias("grid_id"),
        )
        .agg(
            F.sum(F.round(F.col("value") * 100).cast("bigint")).alias("centi"),
            F.min(salted_hash("dew", F.col("event_id")) % 150).alias("dew_gap"),
            F.max(salted_hash("wind", F.col("event_id")) % 300).alias("gust"),
            F.count("*").alias("n_obs"),
        )
        .withColumn("temp_c", F.col("centi").cast("double") / F.col("n_obs") / 100.0 - 20.0)
        .select(
            "hr",
            "grid_id",
            "temp_c",
            (F.col("temp_c") - F.col("dew_gap") / 10.0).alias("dew_c"),
            (F.col("gust") / 10.0).alias("wind_ms"),
            "n_obs",
        )
    )


# South-western lattice point of the map square, in quarter degrees, and the
# number of points north and east from there.
LATTICE_SOUTH, LATTICE_WEST, LATTICE_ROWS, LATTICE_COLUMNS = -95, -188, 3, 4


def lattice_weather(accidents: DataFrame) -> DataFrame:
    """Hourly weather in UTC on the lattice around the map square, for the hours
    in which there are accidents. It follows what was observed in the hour, with
    a share of its own per point; one point in forty is missing."""
    utc = to_utc(F.col("accident_ts"), utc_offset())
    hours = accidents.groupBy(temporal.hour_floor(utc).alias("hr")).agg(
        F.sum(F.round(F.col("precip") * 100).cast("bigint")).alias("centi"), F.count("*").alias("n")
    )
    n_points = LATTICE_ROWS * LATTICE_COLUMNS
    points = hours.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))))
    hour = F.expr("timestampdiff(HOUR, timestamp_ntz'1970-01-01 00:00:00', hr)")
    points = points.withColumn("k", hour * n_points + F.col("point"))
    k, mean = F.col("k"), F.col("centi").cast("double") / F.col("n") / 100.0
    temp = mean - 20.0 + salted_hash("lt", k) % 100 / F.lit(10.0)
    step = {
        "lat": F.floor(F.col("point") / LATTICE_COLUMNS) + LATTICE_SOUTH,
        "lon": F.col("point") % LATTICE_COLUMNS + LATTICE_WEST,
    }
    return points.where(salted_hash("lm", k) % 40 != 0).select(
        "hr",
        *[(s / F.lit(float(PER_DEGREE))).alias(c) for c, s in step.items()],
        temp.alias("temp_c"),
        (temp - salted_hash("ld", k) % 150 / F.lit(10.0)).alias("dew_c"),
        (salted_hash("lw", k) % 300 / F.lit(10.0)).alias("wind_ms"),
        (mean * (salted_hash("lp", k) % 21 + 90) / F.lit(100.0)).alias("precip"),
    )


def planted_score(bridge_len: Column, rush: Column, precip: Column, road_type: Column,
                  country: Column) -> Column:
    """True severity, in thousandths."""
    raw = (
        F.lit(-360)
        + 2 * F.floor(bridge_len)
        + 200 * rush
        + 4 * F.floor(precip)
        - F.when(road_type == RESIDENTIAL, 250).otherwise(0)
        + 60 * country
    )
    return F.least(F.lit(950), F.greatest(F.lit(15), raw)).cast("bigint")


def accidents(spark: SparkSession, folder: str, zone_table: DataFrame) -> DataFrame:
    """One row per accident, with the statistics of its zone, its label, and a
    `row_id` that also tells copies of an accident apart."""
    events = table_with_row_id(
        spark, folder, "events", "event_id", "ts", "user_id", "event_type", "value"
    )
    located = join_dimension(
        events.withColumnRenamed("user_id", "zone_id"), zone_table, ["zone_id"], ["row_id"],
        key_source=table(spark, folder, "events", "user_id").withColumnRenamed(
            "user_id", "zone_id"
        ),
    )
    shift = F.make_dt_interval((F.col("zone_id") % 12 * 30).cast("int"))
    lat, lon = _place(F.col("event_id"), "lat", "lon")
    rows = located.select(
        "row_id",
        F.col("event_id").alias("accident_id"),
        "zone_id",
        (F.col("zone_id") % 5).alias("grid_id"),
        F.col("ts").alias("obs_ts"),
        (F.col("ts") + shift).alias("accident_ts"),
        F.col("value").alias("precip"),
        F.col("event_type").alias("road_type"),
        "country_flag",
        *[c for c in zone_table.columns if c not in ("zone_id", "country_flag")],
        (salted_hash("sev", F.col("event_id")) % 1000).alias("h"),
        lat.alias("lat"),
        lon.alias("lon"),
    )
    col = F.col
    return (
        rows.withColumn("rush_hour", temporal.rush_hour(col("accident_ts")))
        .withColumn("rain_x_curves", interactions.rain_x_curves(col("precip"), col("n_curves")))
        .withColumn("speed_x_lanes", interactions.speed_x_lanes(col("mean_speed"), col("lanes")))
        .withColumn(
            "score",
            planted_score(
                col("bridge_len"), col("rush_hour"), col("precip"), col("road_type"),
                col("country_flag"),
            ),
        )
        .withColumn("severe", (col("h") < col("score")).cast("int"))
    )


def accidents_br(df: DataFrame) -> DataFrame:
    """Accidents of the first country in that source's own shape."""
    even = F.col("h") % 2 == 0
    grave = (
        F.when((F.col("severe") == 1) & even, "GRAVE")
        .when(F.col("severe") == 1, "FATAL")
        .when(even, "LEVE")
        .otherwise("MODERADO")
    )
    return df.where(F.col("country_flag") == 0).select(
        F.col("accident_id").alias("id"),
        F.col("accident_ts").alias("data_hora"),
        F.col("lat").alias("latitude"),
        F.col("lon").alias("longitude"),
        grave.alias("gravidade"),
    )


def accidents_us(df: DataFrame) -> DataFrame:
    """Accidents of the second country in that source's own shape."""
    level = F.when(F.col("severe") == 1, 3 + F.col("h") % 2).otherwise(1 + F.col("h") % 2)
    return df.where(F.col("country_flag") == 1).select(
        F.col("accident_id").alias("ID"),
        F.col("accident_ts").alias("Start_Time"),
        F.col("lat").alias("Start_Lat"),
        F.col("lon").alias("Start_Lng"),
        level.cast("bigint").alias("Severity"),
    )
