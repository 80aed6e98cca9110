"""Joining a large fact table to a table with one row per key."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is hot when it holds this share of the rows, so there are at most
# 1 / HOT_SHARE of them and their list can always be broadcast.
HOT_SHARE = 0.002
_UNITS = {"": 0, "b": 0, "k": 10, "m": 20, "g": 30, "t": 40, "p": 50}


def estimated_bytes(df: DataFrame) -> float:
    """Size the optimizer expects, which is the file size for a plain table
    scan. Unknown sizes (a remote session tells none) count as large."""
    if not hasattr(df, "_jdf"):
        return float("inf")
    return float(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def broadcast_limit(df: DataFrame) -> int:
    text = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10MB").lower()
    number, unit = re.fullmatch(r"(-?\d+)([a-z]?)b?", text).groups()
    return int(number) << _UNITS[unit]


def is_small(dim: DataFrame, limit: int | None = None) -> bool:
    """Is the dimension known to be under the broadcast limit?"""
    return estimated_bytes(dim) <= (broadcast_limit(dim) if limit is None else limit)


def hot_keys(fact: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> DataFrame:
    """Hashes of the keys that hold at least `share` of the rows, 1 / share at most.

    One pass over the key columns, into sketches of bounded size: one per task,
    merged in groups of tasks first, so that no task has to merge them all.
    """
    groups = int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    most = math.ceil(1 / share)
    # The sketch's error is far below the share at eight times the items.
    tracked = 8 * most
    per_group = (
        fact.select(
            F.xxhash64(*keys).alias("key_hash"),
            F.pmod(F.spark_partition_id(), F.lit(groups)).alias("task_group"),
        )
        .groupBy("task_group")
        .agg(
            F.expr(f"approx_top_k_accumulate(key_hash, {tracked})").alias("sketch"),
            F.count("*").alias("n_rows"),
        )
    )
    # One group, but none for a table without rows.
    merged = per_group.groupBy(F.lit(1)).agg(
        F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"),
        F.sum("n_rows").alias("n_rows"),
    )
    top = merged.select("n_rows", F.expr(f"inline(approx_top_k_estimate(sketch, {most}))"))
    return top.where(F.col("count") >= F.col("n_rows") * share).select(
        F.col("item").alias("key_hash")
    )


def join_dimension(
    fact: DataFrame,
    dim: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    limit: int | None = None,
    salts: int | None = None,
    key_source: DataFrame | None = None,
) -> DataFrame:
    """Join `fact` to `dim`, which has one row per key, whatever the key skew.

    A dimension known to be under the broadcast limit needs no shuffle of the
    facts, so skew does not matter and Spark plans the broadcast itself. A
    larger one is joined on (key, salt): rows of hot keys are spread over
    `salts` values by the hash of `spread_by` (a unique column, for an even
    spread), and the few dimension rows of hot keys are repeated once per
    salt. Other keys keep salt 0 and are not repeated. No row is dropped.

    Hot keys are looked for in `key_source`, or else in `fact`. Name a stored
    table with the same keys where `fact` is itself the result of joins, so
    that these do not run twice.
    """
    keys = list(keys)
    if is_small(dim, limit):
        return fact.join(dim, keys, how)

    salts = salts or int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = fact if key_source is None else key_source
    hot = F.broadcast(hot_keys(source, keys).withColumn("is_hot", F.lit(True)))
    salted_fact = (
        fact.withColumn("key_hash", F.xxhash64(*keys))
        .join(hot, "key_hash", "left")
        .withColumn(
            "salt",
            F.when(
                F.col("is_hot"), F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
            ).otherwise(F.lit(0)),
        )
        .drop("key_hash", "is_hot")
    )
    salted_dim = (
        dim.withColumn("key_hash", F.xxhash64(*keys))
        .join(hot, "key_hash", "left")
        .withColumn("top_salt", F.when(F.col("is_hot"), F.lit(salts - 1)).otherwise(F.lit(0)))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("top_salt"))))
        .drop("key_hash", "is_hot", "top_salt")
    )
    return salted_fact.join(salted_dim, [*keys, "salt"], how).drop("salt")
