"""What drives a score: importances, effects and a two-dimensional view."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crashgrade.functions.arithmetic import ratio
from crashgrade.functions.hashing import salted_hash
from crashgrade.operators.metrics import roc_auc
from crashgrade.operators.ranks import exact_quantiles
from crashgrade.operators.reshape import per_column
from crashgrade.session import shared_folder

ROWS_PER_RANGE = 200_000
BASELINE = "(none)"


def tree_importance(spark: SparkSession, model, names: Sequence[str]) -> DataFrame:
    """Importance of each input of a tree model, as a share, with its rank."""
    shares = sorted(
        zip(names, model.featureImportances.toArray()), key=lambda pair: (-pair[1], pair[0])
    )
    return spark.createDataFrame(
        [(n, float(v), i + 1) for i, (n, v) in enumerate(shares)],
        "feature string, importance double, importance_rank int",
    )


def group_importance(importance: DataFrame, registry: DataFrame) -> DataFrame:
    """Importance summed per feature group."""
    return (
        importance.join(registry, "feature")
        .groupBy("feature_group")
        .agg(F.sum("importance").alias("importance"), F.count("*").alias("n_features"))
    )


def shuffle_columns(
    df: DataFrame, cols: Sequence[str], row_id: str, ranges: int, salt: str = "perm"
) -> DataFrame:
    """Adds `<col>_other`, the value of another row, as a permutation.

    Rows stand in a ring by the hash of `row_id`, which must tell copies of a
    row apart, so that they scatter; each row takes the values of the next one,
    all columns in one sort. The ring is cut into contiguous ranges of the hash,
    and the last row of a range takes the first of the next, so the result is
    the same for any number of ranges.
    """
    place = salted_hash(salt, F.coalesce(F.col(row_id).cast("string"), F.lit("")))
    rows = df.withColumn("perm_place", place).withColumn(
        "perm_range", F.shiftright(F.col("perm_place") * ranges, 32)
    )
    rest = [c for c in df.columns if c != row_id]
    own = F.struct(*[F.col(c).alias(f"{c}_other") for c in cols])
    at = F.struct("perm_place", row_id, *rest)
    ring = Window.partitionBy("perm_range").orderBy("perm_place", row_id, *rest)
    # One row per range.
    firsts = rows.groupBy("perm_range").agg(F.min_by(own, at).alias("head"))
    around = Window.partitionBy().orderBy("perm_range")
    whole = around.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heads = firsts.select(
        "perm_range", F.coalesce(F.lead("head").over(around), F.first("head").over(whole)).alias("head")
    )
    return (
        rows.withColumn("next", F.lead(own).over(ring))
        .join(heads, "perm_range")
        .withColumn("other", F.coalesce("next", "head"))
        .select(*df.columns, "other.*")
    )


def permutation_importance(
    df: DataFrame,
    cols: Sequence[str],
    score: Callable[[DataFrame], DataFrame],
    row_id: str,
    ranges: int | None = None,
    target: str = "severe",
) -> DataFrame:
    """AUC lost when one column is shuffled: feature, auc, auc_loss.

    `score` adds the column `p` and keeps the columns it does not read. Every
    row is scored once as it is (feature "(none)") and once per column, in a
    single plan, whose scores are kept in the checkpoint folder, as the AUC
    reads them twice.
    """
    shared_folder(df.sparkSession)
    if ranges is None:
        ranges = max(1, -(-df.count() // ROWS_PER_RANGE))
    variants = F.explode(F.array(*[F.lit(c) for c in [BASELINE, *cols]]))
    shuffled = shuffle_columns(df, cols, row_id, ranges).withColumn("feature", variants)
    swapped = shuffled.withColumns(
        {c: F.when(F.col("feature") == c, F.col(f"{c}_other")).otherwise(F.col(c)) for c in cols}
    ).drop(*[f"{c}_other" for c in cols])
    scored = score(swapped).select("feature", F.col(target).alias("severe"), "p")
    aucs = roc_auc(scored.checkpoint(), ["feature"])
    # One row per column reaches this window.
    base = F.max(F.when(F.col("feature") == BASELINE, F.col("auc"))).over(Window.partitionBy())
    return aucs.select("feature", "auc", (base - F.col("auc")).alias("auc_loss"))


def linear_shap(df: DataFrame, coefficients: dict[str, float], key: str) -> DataFrame:
    """Contribution of each column to a linear score, against the average row."""
    names = list(coefficients)
    means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in names]).first()
    return df.select(
        key,
        *[
            (F.lit(float(coefficients[c])) * (F.col(c).cast("double") - F.lit(means[c]))).alias(c)
            for c in names
        ],
    )


def shap_summary(contributions: DataFrame, names: Sequence[str], key: str) -> DataFrame:
    """Mean absolute contribution per column."""
    return per_column(contributions, names, {"mean_abs": lambda v: F.avg(F.abs(v))})


def effect_direction(
    df: DataFrame, flags: Sequence[str], coefficients: dict[str, float] | None = None,
    target: str = "severe",
) -> DataFrame:
    """Severe share with and without each 0/1 flag, and the sign of the gap;
    also the sign of its coefficient where one is given."""
    severe = F.col(target) == 1

    def share(where: Column) -> Column:
        return ratio(F.count_if(where & severe), F.count_if(where))

    rates = per_column(
        df, flags, {"share_with": lambda v: share(v == 1), "share_without": lambda v: share(v != 1)}
    ).withColumn(
        "direction",
        F.when(F.col("share_with") > F.col("share_without"), "raises")
        .when(F.col("share_with") < F.col("share_without"), "lowers")
        .otherwise("neutral"),
    )
    if coefficients is None:
        return rates
    pairs = [x for c in flags if c in coefficients for x in (F.lit(c), F.lit(coefficients[c]))]
    weight = F.create_map(*pairs)[F.col("feature")]
    return rates.withColumn(
        "model_direction",
        F.when(weight > 0, "raises").when(weight < 0, "lowers").otherwise("neutral"),
    )


def _swapped(
    df: DataFrame, column: str, values: dict[str, Column], score: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Adds a score per entry of `values`, with the column set to that value. The
    rows are not repeated; everything else stays as it is."""
    names = df.columns
    for name, value in values.items():
        moved = df.withColumn("_own", F.col(column)).withColumn(column, value)
        df = score(moved).withColumnRenamed("p", name).withColumn(column, F.col("_own")).select(*names, name)
        names = [*names, name]
    return df


def accumulated_effects(
    df: DataFrame,
    cols: Sequence[str],
    score: Callable[[DataFrame], DataFrame],
    bins: int = 10,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Accumulated local effects of numeric columns on any score: feature, bin,
    low, high, n_rows, effect, ale, direction.

    A column is cut at its quantiles, in at most `bins` bins. `effect` is the
    mean change of the score from a bin's low to its high end, over the rows that
    lie in it, all else as in those rows; so no row is scored where no row like it is. `ale` is
    the sum of the effects up to the bin's high end, less its mean over all rows.
    `direction` says whether the score rises over the whole range.

    `score` adds the column `p` and keeps the columns `cols` and `keep`. Each
    row is scored twice per column, side by side, in one pass; one row per bin is
    collected by Spark. Rows without a value are left out of that column; a column
    with a single value has no row."""
    shares = {f"q{i}": i / bins for i in range(bins + 1)}
    found = {r["feature"]: r for r in exact_quantiles(df, cols, shares).collect()}
    edges = {c: sorted({found[c][q] for q in shares}) for c in cols if c in found}
    edges = {c: e for c, e in edges.items() if len(e) > 1}
    wide, used = df.select(*dict.fromkeys([*cols, *keep])), []
    for i, (c, e) in enumerate(edges.items()):
        v = F.col(c).cast("double")
        at = F.array(*map(F.lit, e))
        # The bin ends at the first edge that is not below the value.
        below = F.filter(at, lambda x: x < v)  # noqa: B023
        slot = F.greatest(F.lit(1), F.size(below))
        wide = wide.withColumn(f"_bin{i}", F.when(v.isNotNull(), slot))
        ends = {f"_{k}{i}": F.element_at(at, F.col(f"_bin{i}") + step) for k, step in (("low", 0), ("high", 1))}
        wide = _swapped(wide, c, ends, score)
        used.append(F.struct(F.lit(c).alias("feature"), F.col(f"_bin{i}").alias("bin"), (F.col(f"_high{i}") - F.col(f"_low{i}")).alias("change")))
    schema = "feature string, bin int, low double, high double"
    spans = [(c, k + 1, a, b) for c, e in edges.items() for k, (a, b) in enumerate(zip(e, e[1:]))]
    table = df.sparkSession.createDataFrame(spans, schema)
    changes = wide.select(F.inline(F.array(*used))) if used else table.select("feature", "bin", F.lit(0.0).alias("change"))
    effects = changes.where(F.col("bin").isNotNull()).groupBy("feature", "bin").agg(
        F.count("*").alias("n_rows"), F.avg("change").alias("effect")
    )
    # At most `bins` rows per column.
    upto = Window.partitionBy("feature").orderBy("bin")
    whole = Window.partitionBy("feature")
    known = table.join(effects, ["feature", "bin"], "left").withColumns(
        {"n_rows": F.coalesce("n_rows", F.lit(0)), "effect": F.coalesce("effect", F.lit(0.0))}
    )
    summed = known.withColumn("_sum", F.sum("effect").over(upto))
    inner = F.col("n_rows") * (F.col("_sum") - F.col("effect") / 2.0)
    middle = ratio(F.sum(inner).over(whole), F.sum("n_rows").over(whole))
    total = F.sum("effect").over(whole)
    return summed.select(
        "feature", "bin", "low", "high", "n_rows", "effect", (F.col("_sum") - middle).alias("ale"),
        F.when(total > 0, "raises").when(total < 0, "lowers").otherwise("neutral").alias("direction"),
    )


def project_2d(df: DataFrame, cols: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """First two principal components of scaled columns, for every row."""
    assembled = VectorAssembler(inputCols=list(cols), outputCol="v").transform(df)
    model = PipelineModel([PCA(k=2, inputCol="v", outputCol="xy").fit(assembled)])
    point = vector_to_array("xy")
    return model.transform(assembled).select(
        *keep, point[0].alias("x"), point[1].alias("y")
    )
