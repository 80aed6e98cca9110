"""The given tables, read with only the columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return df.select(*cols) if cols else df


def table_with_row_id(spark: SparkSession, folder: str, name: str, *cols: str) -> DataFrame:
    """Adds `row_id` from the file and the row's place in it: unique even among
    identical rows, and the same when a task is run again."""
    df = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    row_id = F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    return df.select(*cols, row_id.alias("row_id"))
