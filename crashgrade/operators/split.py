"""Reproducible split of the rows into three parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashgrade.functions.arithmetic import ratio
from crashgrade.functions.hashing import salted_hash

# Thousandths of the rows: train, meta holdout, and the rest for the test.
TRAIN, META = 595, 105
PARTS = ("train", "meta", "test")


def part_of(key: Column, salt: str = "split", train: int = TRAIN, meta: int = META) -> Column:
    """Part of a key; depends on the key alone, so never on layout or run."""
    slot = salted_hash(salt, key) % 1000
    return F.when(slot < train, "train").when(slot < train + meta, "meta").otherwise("test")


def split3(
    df: DataFrame, key: str, salt: str = "split", train: int = TRAIN, meta: int = META
) -> DataFrame:
    return df.withColumn("part", part_of(F.col(key), salt, train, meta))


def split_audit(df: DataFrame, key: str, target: str = "severe") -> DataFrame:
    """Rows, share, severe share and keys per part, and the number of its keys
    that also occur in another part (which must be 0)."""
    # One shuffle, by key: counts per part, combined before it.
    counts = [
        F.struct(
            F.lit(part).alias("part"),
            F.count_if(F.col("part") == part).alias("n_rows"),
            F.sum(F.when(F.col("part") == part, F.col(target)).otherwise(0)).alias("n_severe"),
        )
        for part in PARTS
    ]
    per_key = df.groupBy(key).agg(F.array(*counts).alias("parts"))
    held = F.filter("parts", lambda p: p["n_rows"] > 0)
    per_part = (
        per_key.select(held.alias("parts"))
        .select((F.size("parts") > 1).alias("torn"), F.explode("parts").alias("p"))
        .groupBy(F.col("p.part").alias("part"))
        .agg(
            F.sum("p.n_rows").alias("n_rows"),
            F.sum("p.n_severe").alias("n_severe"),
            F.count("*").alias("n_keys"),
            F.count_if(F.col("torn")).alias("torn_keys"),
        )
    )
    # The window runs over one row per part.
    everything = Window.partitionBy()
    return per_part.select(
        "part",
        "n_rows",
        "n_keys",
        "torn_keys",
        ratio(F.col("n_rows"), F.sum("n_rows").over(everything)).alias("share"),
        ratio(F.col("n_severe"), F.col("n_rows")).alias("severe_share"),
    )
