"""Products of two factors that may act together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crashgrade.functions.arithmetic import ratio


def rain_x_curves(precip: Column, curves: Column) -> Column:
    return precip * curves


def curvature(curves: Column, road_km: Column) -> Column:
    """Curves per kilometre, 0 where no road is known."""
    return F.coalesce(ratio(curves, road_km), F.lit(0.0))


def temp_x_curvature(temp: Column, curve_density: Column) -> Column:
    return temp * curve_density


def speed_x_lanes(speed: Column, lanes: Column) -> Column:
    return speed * lanes
