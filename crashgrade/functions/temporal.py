"""Time-of-accident features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

RUSH_HOURS = (7, 8, 9, 17, 18, 19)


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts)


def day_of_week(ts: Column) -> Column:
    """Monday is 0."""
    return F.weekday(ts)


def month(ts: Column) -> Column:
    return F.month(ts)


def rush_hour(ts: Column, hours: Sequence[int] = RUSH_HOURS) -> Column:
    return F.hour(ts).isin(*hours).cast("int")


def hour_floor(ts: Column) -> Column:
    """Start of the hour. `date_trunc` would turn a zoneless timestamp into a
    zoned one and so depend on the session zone; this does not."""
    return ts - F.make_dt_interval(
        F.lit(0), F.lit(0), F.minute(ts), F.extract(F.lit("SECOND"), ts)
    )
