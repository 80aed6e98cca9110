"""Columns to rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_rows(
    df: DataFrame, keep: Sequence[str], cols: Sequence[str], name: str, value: str
) -> DataFrame:
    """One row per column of `cols`, as `DataFrame.unpivot` gives.

    Built on a generator: where the result is used twice, Spark sees that both
    uses are the same and shuffles once, which it does not after an unpivot
    that keeps columns.
    """
    pairs = [F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in cols]
    return df.select(*keep, F.inline(F.array(*pairs)))


def per_column(
    df: DataFrame,
    cols: Sequence[str],
    statistics: dict[str, Callable[[Column], Column]],
    by: Sequence[str] = (),
) -> DataFrame:
    """feature and its statistics, one row per column of `cols` and group.

    The rows are aggregated as they are, all columns at once; only the result,
    one row per group, is turned into rows per column. Without grouping, no
    rows give one row per column, of empty statistics.
    """
    wide = df.groupBy(*by).agg(
        *[
            F.struct(*[fn(F.col(c).cast("double")).alias(n) for n, fn in statistics.items()]).alias(f"_{i}")
            for i, c in enumerate(cols)
        ]
    )
    rows = [
        F.struct(F.lit(c).alias("feature"), *[F.col(f"_{i}")[n].alias(n) for n in statistics])
        for i, c in enumerate(cols)
    ]
    return wide.select(*by, F.inline(F.array(*rows)))
