"""Running totals and exact quantiles without a single-partition sort."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashgrade.operators.reshape import to_rows

SLOTS_PER_PARTITION = 2


def cut_points(df: DataFrame, cols: Sequence[str]) -> list[float]:
    """Values that split the rows of each column into slots of about equal size.

    One pass without a shuffle, over bounded sketches. The slots only balance
    the work: any cut points lead to the same totals.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = SLOTS_PER_PARTITION * partitions
    shares = [i / slots for i in range(1, slots)]
    found = df.approxQuantile(list(cols), shares, 1.0 / slots)
    return sorted({value for column in found for value in column if math.isfinite(value)})


def running_totals(
    df: DataFrame,
    order_col: str,
    sums: Sequence[str],
    by: Sequence[str] = (),
    cuts: Sequence[float] | None = None,
) -> DataFrame:
    """For each row the sum over all rows before it, as `<name>_before`, and
    over its whole group, as `<name>_total`. Rows without a value are left out.

    `df` has one row per (by, order_col), so no single value can be heavy.
    Slots are summed first, the few slot totals get a running sum, and only
    the rows of one slot are ever sorted together. `cuts` come from
    `cut_points` over the data behind `df`, or else over `df` itself.
    """
    by = list(by)
    cuts = cut_points(df, [order_col]) if cuts is None else cuts
    splits = [-float("inf"), *(cuts or [0.0]), float("inf")]
    # The same filter on both uses of `df` lets Spark shuffle it once.
    known = df.where(F.col(order_col).isNotNull())
    slotter = Bucketizer(
        splits=splits, inputCol=order_col, outputCol="slot", handleInvalid="keep"
    )
    slotted = slotter.transform(known)

    earlier = Window.partitionBy(*by).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = slotted.groupBy(*by, "slot").agg(
        *[F.sum(c).alias(f"{c}_slot") for c in sums]
    ).select(
        *by,
        "slot",
        *[F.coalesce(F.sum(f"{c}_slot").over(earlier), F.lit(0)).alias(f"{c}_offset") for c in sums],
        *[F.sum(f"{c}_slot").over(whole).alias(f"{c}_total") for c in sums],
    )

    within = (
        Window.partitionBy(*by, "slot")
        .orderBy(order_col)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return slotted.join(offsets, [*by, "slot"]).select(
        *by,
        order_col,
        *sums,
        *[
            (F.col(f"{c}_offset") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(f"{c}_before")
            for c in sums
        ],
        *[f"{c}_total" for c in sums],
    )


def _value_at(rank: Column) -> Column:
    holds = (F.col("n_before") <= rank) & (rank < F.col("n_before") + F.col("n"))
    return F.max(F.when(holds, F.col("value")))


def exact_quantiles(
    df: DataFrame, cols: Sequence[str], probs: dict[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Interpolated quantiles of several columns at once, one row per
    (by, feature), one column per entry of `probs`. Nulls are ignored.

    The built-in exact percentile keeps all distinct values of a column in
    one task; here they stay spread over the cluster.
    """
    by = list(by)
    values = df.select(*by, *[F.col(c).cast("double").alias(c) for c in cols])
    counts = (
        to_rows(values, by, cols, "feature", "value")
        .where(F.col("value").isNotNull())
        .groupBy(*by, "feature", "value")
        .agg(F.count("*").alias("n"))
    )
    ranked = running_totals(counts, "value", ["n"], [*by, "feature"], cut_points(values, cols))
    picks = []
    for name, prob in probs.items():
        position = (F.col("n_total") - 1) * F.lit(float(prob))
        picks += [
            _value_at(F.floor(position)).alias(f"{name}_lo"),
            _value_at(F.ceil(position)).alias(f"{name}_hi"),
            F.max(position - F.floor(position)).alias(f"{name}_part"),
        ]
    picked = ranked.groupBy(*by, "feature").agg(*picks)
    return picked.select(
        *by,
        "feature",
        *[
            (
                F.col(f"{n}_lo") + F.col(f"{n}_part") * (F.col(f"{n}_hi") - F.col(f"{n}_lo"))
            ).alias(n)
            for n in probs
        ],
    )
