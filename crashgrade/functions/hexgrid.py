"""Hexagonal map cells as plain column arithmetic.

Points go through an equal-area cylindrical projection, then into axial
coordinates of a pointy-top hexagon grid, then to the nearest centre by
rounding in cube coordinates. All of it stays inside generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371007.2
RESOLUTIONS = (9, 10, 11)
BASE_RESOLUTION = 9
BASE_EDGE_M = 200.8
# Points from here on northwards lie on a grid of their own.
BORDER_LAT = 15.0
_NORTH = 1 << 62
# q and r are shifted to be positive and packed into one bigint.
_SHIFT = 1 << 30
_STRIDE = 1 << 31


def edge_length(resolution: int, base_edge_m: float = BASE_EDGE_M) -> float:
    """Each finer level has a seventh of the area of the one above it."""
    return base_edge_m / math.sqrt(7.0) ** (resolution - BASE_RESOLUTION)


def project(
    lat: Column, lon: Column, standard_lat: float | tuple[float, float]
) -> tuple[Column, Column]:
    """Metres east and north, equal in area, true to shape at `standard_lat`; a
    pair holds south and north of `BORDER_LAT`."""
    if isinstance(standard_lat, tuple):
        south, north = (math.cos(math.radians(at)) for at in standard_lat)
        is_north = lat >= BORDER_LAT
        wide = F.when(is_north, EARTH_RADIUS_M * north).otherwise(EARTH_RADIUS_M * south)
        high = F.when(is_north, EARTH_RADIUS_M / north).otherwise(EARTH_RADIUS_M / south)
    else:
        stretch = math.cos(math.radians(standard_lat))
        wide, high = EARTH_RADIUS_M * stretch, EARTH_RADIUS_M / stretch
    return F.radians(lon) * wide, F.sin(F.radians(lat)) * high


def _nearest(v: Column) -> Column:
    return F.floor(v + 0.5).cast("double")


def axial(
    lat: Column, lon: Column, edge_m: float, standard_lat: float | tuple[float, float]
) -> tuple[Column, Column]:
    """Axial coordinates (q, r) of the cell whose centre is nearest."""
    x, y = project(lat, lon, standard_lat)
    q = (x * (math.sqrt(3.0) / 3.0) - y * (1.0 / 3.0)) / edge_m
    r = (y * (2.0 / 3.0)) / edge_m
    s = -q - r
    rq, rr, rs = _nearest(q), _nearest(r), _nearest(s)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fix_q = (dq > dr) & (dq > ds)
    cell_q = F.when(fix_q, -rr - rs).otherwise(rq)
    cell_r = F.when(~fix_q & (dr > ds), -rq - rs).otherwise(rr)
    return cell_q.cast("bigint"), cell_r.cast("bigint")


def hex_cell(
    lat: Column, lon: Column, edge_m: float, standard_lat: float | tuple[float, float] = 0.0
) -> Column:
    """Cell id of a point, as one bigint. With a pair of latitudes the two grids
    have ids of their own, so their cells never meet."""
    q, r = axial(lat, lon, edge_m, standard_lat)
    cell = (q + _SHIFT) * _STRIDE + (r + _SHIFT)
    if isinstance(standard_lat, tuple):
        return cell + F.when(lat >= BORDER_LAT, F.lit(_NORTH)).otherwise(F.lit(0))
    return cell
