"""Readers that map every source to one fixed schema."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class AccidentSource:
    """Native schema of a source and the place of each common column in it."""

    schema: T.StructType
    columns: dict[str, str]
    country_flag: int
    severe_codes: tuple[str, ...]
    light_codes: tuple[str, ...]
    # How far the source's local time is ahead of UTC.
    utc_offset_hours: int


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


# Column names and severity codes of the raw shapes; replace them to read other files.
ACCIDENT_SOURCES = {
    "br": AccidentSource(
        schema=_schema(
            id=T.LongType(), data_hora=T.TimestampNTZType(), latitude=T.DoubleType(),
            longitude=T.DoubleType(), gravidade=T.StringType(),
        ),
        columns={"accident_id": "id", "accident_ts": "data_hora", "lat": "latitude",
                 "lon": "longitude", "severity": "gravidade"},
        country_flag=0,
        severe_codes=("GRAVE", "FATAL"),
        light_codes=("LEVE", "MODERADO"),
        utc_offset_hours=-3,
    ),
    "us": AccidentSource(
        schema=_schema(
            ID=T.LongType(), Start_Time=T.TimestampNTZType(), Start_Lat=T.DoubleType(),
            Start_Lng=T.DoubleType(), Severity=T.LongType(),
        ),
        columns={"accident_id": "ID", "accident_ts": "Start_Time", "lat": "Start_Lat",
                 "lon": "Start_Lng", "severity": "Severity"},
        country_flag=1,
        severe_codes=("3", "4"),
        light_codes=("1", "2"),
        utc_offset_hours=-5,
    ),
}

ROAD_SCHEMA = _schema(
    zone_id=T.LongType(), feature_id=T.LongType(), road_type=T.StringType(),
    length_km=T.DoubleType(), speed=T.IntegerType(), kind=T.StringType(),
    lanes=T.LongType(), lat=T.DoubleType(), lon=T.DoubleType(),
)

WEATHER_SCHEMA = _schema(
    hr=T.TimestampNTZType(), grid_id=T.LongType(), temp_c=T.DoubleType(),
    dew_c=T.DoubleType(), wind_ms=T.DoubleType(), n_obs=T.LongType(),
)

# Hourly weather in UTC at the points of a lattice.
LATTICE_SCHEMA = _schema(
    hr=T.TimestampNTZType(), lat=T.DoubleType(), lon=T.DoubleType(), temp_c=T.DoubleType(),
    dew_c=T.DoubleType(), wind_ms=T.DoubleType(), precip=T.DoubleType(),
)

_CORRUPT = "_corrupt_record"


def _load(spark: SparkSession, path: str, schema: T.StructType, fmt: str, options: dict) -> DataFrame:
    return spark.read.schema(schema).options(**options).format(fmt).load(path)


def normalise(raw: DataFrame, source: str, keep: Sequence[str] = ()) -> DataFrame:
    """Renames a raw source to the common columns and adds its country flag."""
    spec = ACCIDENT_SOURCES[source]
    picked = raw.select(*[F.col(native).alias(name) for name, native in spec.columns.items()], *keep)
    return picked.withColumn("severity", F.col("severity").cast("string")).withColumn(
        "country_flag", F.lit(spec.country_flag)
    )


def utc_offset(flag: str = "country_flag") -> Column:
    """Hours that a country's local time is ahead of UTC."""
    specs = {s.country_flag: s.utc_offset_hours for s in ACCIDENT_SOURCES.values()}
    out = None
    for value, hours in specs.items():
        is_it = F.col(flag) == value
        out = F.when(is_it, hours) if out is None else out.when(is_it, hours)
    return out


def read_accidents(
    spark: SparkSession, path: str, source: str, fmt: str = "parquet", **options: str
) -> DataFrame:
    raw = _load(spark, path, ACCIDENT_SOURCES[source].schema, fmt, options)
    return normalise(raw, source)


def read_accidents_audited(
    spark: SparkSession, path: str, source: str, fmt: str = "parquet", **options: str
) -> DataFrame:
    """All rows of a source in the common columns, with `source`, the `raw` line
    of those that could not be read, and `reject`, the reason why a row is no
    accident (null for accepted ones). So rows = accepted + rejected.

    Reasons, the first that holds: short_line (fewer fields than columns),
    bad_value (a field that its column's type cannot hold), no_id, no_time, no_place
    (missing, or off the globe), unknown_severity."""
    spec = ACCIDENT_SOURCES[source]
    if fmt in ("csv", "json"):
        schema = T.StructType([*spec.schema.fields, T.StructField(_CORRUPT, T.StringType())])
        options = {**options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
        raw = _load(spark, path, schema, fmt, options)
    else:
        raw = _load(spark, path, spec.schema, fmt, options).withColumn(_CORRUPT, F.lit(None).cast("string"))
    named = normalise(raw, source, keep=[_CORRUPT])
    line, lat, lon = F.col(_CORRUPT), F.col("lat"), F.col("lon")
    reject = F.when(line.isNotNull() & F.lit(fmt == "csv") & (_fields(line, options) < len(spec.schema)), "short_line")
    reject = reject.when(line.isNotNull(), "bad_value").when(F.col("accident_id").isNull(), "no_id")
    reject = reject.when(F.col("accident_ts").isNull(), "no_time")
    on_globe = lat.between(-90, 90) & lon.between(-180, 180)
    reject = reject.when(~F.coalesce(on_globe, F.lit(False)), "no_place")
    known = F.col("severity").isin(*spec.severe_codes, *spec.light_codes)
    reject = reject.when(~F.coalesce(known, F.lit(False)), "unknown_severity")
    return named.withColumns({"source": F.lit(source), "raw": line, "reject": reject}).drop(_CORRUPT)


def _fields(line: Column, options: dict) -> Column:
    sep = options.get("sep", options.get("delimiter", ","))
    return F.size(F.split(line, re.escape(sep), -1))


def accepted(audited: DataFrame) -> DataFrame:
    return audited.where(F.col("reject").isNull()).drop("raw", "reject")


def rejects(audited: DataFrame) -> DataFrame:
    """The rejected rows, with their reason and line."""
    return audited.where(F.col("reject").isNotNull())


def audit_counts(audited: DataFrame) -> DataFrame:
    """Rows per source and outcome: accepted, or the reason of the rejection."""
    outcome = F.coalesce("reject", F.lit("accepted"))
    return audited.groupBy("source", outcome.alias("outcome")).agg(F.count("*").alias("n_rows"))


def read_road_features(
    spark: SparkSession, path: str, fmt: str = "parquet", **options: str
) -> DataFrame:
    return _load(spark, path, ROAD_SCHEMA, fmt, options)


def read_weather(
    spark: SparkSession, path: str, fmt: str = "parquet", **options: str
) -> DataFrame:
    return _load(spark, path, WEATHER_SCHEMA, fmt, options)


def read_lattice_weather(
    spark: SparkSession, path: str, fmt: str = "parquet", **options: str
) -> DataFrame:
    return _load(spark, path, LATTICE_SCHEMA, fmt, options)
