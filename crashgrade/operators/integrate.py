"""Union of the sources, statistics per hex cell, and the joins to accidents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashgrade.functions.hexgrid import RESOLUTIONS, edge_length, hex_cell
from crashgrade.functions.temporal import hour_floor
from crashgrade.operators.joins import join_dimension

URBAN_MIN_SERVICES = 5


def consolidate(br: DataFrame, us: DataFrame) -> DataFrame:
    """All accidents of both countries; nothing is de-duplicated."""
    return br.unionByName(us)


def country_flag(df: DataFrame, value: int) -> DataFrame:
    """1 = United States, 0 = Brazil."""
    return df.withColumn("country_flag", F.lit(value))


def with_cells(
    df: DataFrame,
    base_edge_m: float,
    standard_lat: float | tuple[float, float],
    resolutions: Sequence[int] = RESOLUTIONS,
) -> DataFrame:
    """Adds `cell_<resolution>` for each resolution."""
    return df.withColumns(
        {
            f"cell_{res}": hex_cell(
                F.col("lat"), F.col("lon"), edge_length(res, base_edge_m), standard_lat
            )
            for res in resolutions
        }
    )


def infra_by_cell(features: DataFrame, cell: str, bridge_type: str) -> DataFrame:
    """Counts, lengths and mean speed of the road features of each cell."""
    kind, bridge = F.col("kind"), F.col("road_type") == bridge_type
    return features.groupBy(cell).agg(
        F.count("*").alias("n_segments"),
        F.sum("length_km").alias("road_len"),
        F.sum(F.when(bridge, F.col("length_km")).otherwise(0.0)).alias("bridge_len"),
        F.count_if(bridge).alias("n_bridges"),
        F.count_if(kind == "curve").alias("n_curves"),
        F.count_if(kind == "signal").alias("n_signals"),
        F.count_if(kind == "tunnel").alias("n_tunnels"),
        (F.sum("speed").cast("double") / F.count("*")).alias("mean_speed"),
    )


def length_by_type(features: DataFrame, cell: str, road_types: Sequence[str]) -> DataFrame:
    """Road kilometres per cell, one column per road type and one for all other
    types, null included; together they are the cell's kilometres."""

    def length(where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col("length_km"))), F.lit(0.0))

    kind = F.col("road_type")
    listed = F.coalesce(kind.isin(*road_types), F.lit(False))
    return features.groupBy(cell).agg(
        *[length(kind == t).alias(f"len_{t.lower()}") for t in road_types],
        length(~listed).alias("len_other"),
    )


def dominant_type(features: DataFrame, cell: str) -> DataFrame:
    """Road type with the most kilometres in a cell; ties go to the first name.

    Two combining aggregations; a crowded cell never meets in one sort.
    """
    per_type = features.groupBy(cell, "road_type").agg(F.sum("length_km").alias("km"))
    first = F.min(F.struct((-F.col("km")).alias("neg_km"), F.col("road_type")))
    return per_type.groupBy(cell).agg(first.alias("top")).select(
        cell, F.col("top.road_type").alias("dominant"), (-F.col("top.neg_km")).alias("dominant_km")
    )


def surroundings(
    features: DataFrame, cell: str, urban_min: int = URBAN_MIN_SERVICES
) -> DataFrame:
    """Hospitals, schools and fuel stations per cell; urban from their number up."""
    kind = F.col("kind")
    services = F.col("n_hospitals") + F.col("n_schools") + F.col("n_fuel")
    return (
        features.groupBy(cell)
        .agg(
            F.count_if(kind == "hospital").alias("n_hospitals"),
            F.count_if(kind == "school").alias("n_schools"),
            F.count_if(kind == "fuel").alias("n_fuel"),
        )
        .withColumn("urban", (services >= urban_min).cast("int"))
    )


def cell_statistics(
    features: DataFrame,
    resolutions: Sequence[int],
    bridge_type: str,
    urban_min: int = URBAN_MIN_SERVICES,
) -> DataFrame:
    """Everything known of the cells of all resolutions, from one scan of the
    features: one row per (res, cell) with the columns of `infra_by_cell`,
    `surroundings` and `dominant_type`."""
    cells = F.explode(
        F.array(
            *[F.struct(F.lit(r).alias("res"), F.col(f"cell_{r}").alias("cell")) for r in resolutions]
        )
    )
    kind, bridge = F.col("kind"), F.col("road_type") == bridge_type
    kinds = {
        "n_curves": "curve", "n_signals": "signal", "n_tunnels": "tunnel",
        "n_hospitals": "hospital", "n_schools": "school", "n_fuel": "fuel",
    }
    per_type = (
        features.select("road_type", "kind", "length_km", "speed", cells.alias("at"))
        .groupBy("at.res", "at.cell", "road_type")
        .agg(
            F.count("*").alias("n_segments"),
            F.sum("length_km").alias("road_len"),
            F.sum(F.when(bridge, F.col("length_km")).otherwise(0.0)).alias("bridge_len"),
            F.count_if(bridge).alias("n_bridges"),
            F.sum("speed").alias("speed_sum"),
            *[F.count_if(kind == k).alias(n) for n, k in kinds.items()],
        )
    )
    sums = ["n_segments", "road_len", "bridge_len", "n_bridges", "speed_sum", *kinds]
    longest = F.min(F.struct((-F.col("road_len")).alias("neg_km"), F.col("road_type")))
    totals = per_type.groupBy("res", "cell").agg(
        *[F.sum(c).alias(c) for c in sums], longest.alias("top")
    )
    services = F.col("n_hospitals") + F.col("n_schools") + F.col("n_fuel")
    return totals.select(
        "res",
        "cell",
        *[c for c in sums if c != "speed_sum"],
        (F.col("speed_sum").cast("double") / F.col("n_segments")).alias("mean_speed"),
        (services >= urban_min).cast("int").alias("urban"),
        F.col("top.road_type").alias("dominant"),
    )


def _zero_if_absent(df: DataFrame, name: str) -> Column:
    empty = "" if dict(df.dtypes)[name] == "string" else 0
    return F.coalesce(F.col(name), F.lit(empty)).alias(name)


def attach_infra(
    df: DataFrame,
    cells: DataFrame,
    cell: str,
    prefix: str,
    spread_by: str = "accident_id",
    limit: int | None = None,
    key_source: DataFrame | None = None,
) -> DataFrame:
    """Adds the statistics of each accident's cell as `<prefix><name>`.

    `cells` has one row per cell. Accidents in a cell without roads get 0.
    Rows of a crowded cell are told apart by `spread_by`.
    """
    named = cells.select(
        cell, *[F.col(c).alias(f"{prefix}{c}") for c in cells.columns if c != cell]
    )
    joined = join_dimension(
        df, named, [cell], [spread_by], how="left", limit=limit, key_source=key_source
    )
    added = [c for c in named.columns if c != cell]
    return joined.select(*df.columns, *[_zero_if_absent(joined, c) for c in added])


def attach_weather(
    df: DataFrame,
    weather: DataFrame,
    ts: str = "obs_ts",
    grid: str = "grid_id",
    spread_by: str = "accident_id",
    limit: int | None = None,
) -> DataFrame:
    """Adds the weather of each accident's grid point and hour; null if unknown."""
    keyed = df.withColumn("hr", hour_floor(F.col(ts)))
    facts = weather.withColumnRenamed("grid_id", grid) if grid != "grid_id" else weather
    joined = join_dimension(keyed, facts, ["hr", grid], [spread_by], how="left", limit=limit)
    return joined.select(*df.columns, *[c for c in weather.columns if c not in ("hr", "grid_id")])
