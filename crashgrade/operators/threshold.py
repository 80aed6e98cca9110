"""Decision cuts: precision, recall and F1 of the severe class at every cut.

Scores come in long form: model, severe, p.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashgrade.functions.arithmetic import ratio
from crashgrade.operators.reshape import to_rows

STEPS = 100


def score_rows(scored: DataFrame, models: Sequence[str], keep: Sequence[str] = ("severe",)) -> DataFrame:
    """Wide scores, one column per model, to one row per model."""
    return to_rows(scored, keep, models, "model", "p")


def cut_index(p: Column, steps: int = STEPS) -> Column:
    """The largest i with p >= i / steps, safe against rounding in p * steps."""
    i = F.floor(p * steps).cast("bigint")
    too_low = p >= (i + 1).cast("double") / steps
    too_high = p < i.cast("double") / steps
    return i + F.when(too_low, 1).when(too_high, -1).otherwise(0)


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))


def is_scored(p: Column) -> Column:
    """False for null and NaN, which are above no cut and below none."""
    return p.isNotNull() & ~F.isnan(p.cast("double"))


def flagged_counts(scored: DataFrame, steps: int, lowest: int, highest: int) -> DataFrame:
    """model, i, all_pos, all_neg, tp, fp, n_unscored for the cuts i / steps with
    i from `lowest` (at least -1, which flags all) to `highest`. Scores below 0
    and above 1 count at the ends of the grid; rows without a score are in none
    of the counts but n_unscored."""
    p = F.col("p")
    slot = F.greatest(F.lit(-1), F.least(F.lit(steps), cut_index(p, steps))).cast("bigint")
    slot = F.when(p >= 1, F.lit(steps).cast("bigint")).when(p < 0, F.lit(-1).cast("bigint")).otherwise(slot)
    slots = scored.groupBy("model", F.when(is_scored(p), slot).alias("i")).agg(
        F.sum("severe").alias("pos"), F.count("*").alias("n")
    )
    known = F.col("i").isNotNull()
    # At most steps + 2 slots per model: small enough to meet in one map.
    held = F.map_from_entries(F.collect_list(F.when(known, F.struct("i", F.struct("pos", "n")))))
    whole = lambda c: F.coalesce(F.sum(F.when(known, F.col(c))), F.lit(0))
    every_cut = F.explode(F.sequence(F.lit(-1).cast("bigint"), F.lit(highest).cast("bigint")))
    grid = (
        slots.groupBy("model")
        .agg(
            whole("pos").alias("all_pos"),
            (whole("n") - whole("pos")).alias("all_neg"),
            F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_unscored"),
            held.alias("held"),
        )
        .select("model", "all_pos", "all_neg", "n_unscored", "held", every_cut.alias("i"))
        .withColumn("slot", F.try_element_at("held", F.col("i")))
    )
    from_top = Window.partitionBy("model").orderBy(F.desc("i"))
    flagged = grid.select(
        "model",
        "i",
        "all_pos",
        "all_neg",
        "n_unscored",
        F.sum(F.coalesce("slot.pos", F.lit(0))).over(from_top).alias("tp"),
        F.sum(F.coalesce("slot.n", F.lit(0))).over(from_top).alias("flagged"),
    )
    return flagged.withColumn("fp", F.col("flagged") - F.col("tp")).where(F.col("i") >= lowest)


def threshold_sweep(scored: DataFrame, steps: int = STEPS) -> DataFrame:
    """One row per model and cut 0, 1/steps, ..., 1: counts, precision, recall,
    F1, and the number of rows without a score."""
    counts = (
        flagged_counts(scored, steps, 0, steps)
        .withColumn("threshold", F.col("i").cast("double") / steps)
        .withColumn("fn", F.col("all_pos") - F.col("tp"))
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "model",
        "threshold",
        "tp",
        "fp",
        "fn",
        F.coalesce(ratio(tp, tp + fp), F.lit(0.0)).alias("precision"),
        F.coalesce(ratio(tp, tp + fn), F.lit(0.0)).alias("recall"),
        f1_of(tp, fp, fn).alias("f1"),
        "n_unscored",
    )


def _best() -> Column:
    """Highest F1 first, then the lower cut."""
    return F.max(F.struct("f1", (-F.col("threshold")).alias("low_first")))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """Cut with the highest F1 per model; ties go to the lower cut."""
    return sweep.groupBy("model").agg(_best().alias("best")).select(
        "model", (-F.col("best.low_first")).alias("threshold"), F.col("best.f1").alias("f1")
    )


def tune_all(scored: DataFrame, models: Sequence[str], steps: int = STEPS) -> DataFrame:
    """Best cut of every score column, in one pass."""
    return best_threshold(threshold_sweep(score_rows(scored, models), steps))


def cut_of(thresholds: DataFrame) -> Column:
    """Each model's own cut. There is one row per model, so the cuts become a
    constant map of the plan."""
    pairs: list[Column] = []
    for row in thresholds.collect():
        pairs += [F.lit(row["model"]), F.lit(row["threshold"])]
    return F.create_map(*pairs)[F.col("model")]


def apply_threshold(scored: DataFrame, thresholds: DataFrame | float) -> DataFrame:
    """Adds `predicted`, from one cut or from each model's own."""
    is_table = isinstance(thresholds, DataFrame)
    cut = cut_of(thresholds) if is_table else F.lit(float(thresholds))
    return scored.withColumn(
        "predicted", F.when(is_scored(F.col("p")), (F.col("p") >= cut).cast("int"))
    )


def threshold_gain(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """F1 at 0.5, at each model's given cut, the gain in percentage points, and
    the rows without a score, which are in none of these. The cuts are to be
    tuned on other rows than `scored`."""
    truth, p, cut = F.col("severe") == 1, F.col("p"), F.col("threshold")

    def f1_at(c: Column) -> Column:
        tp, fp, fn = (F.count_if(x) for x in (truth & (p >= c), ~truth & (p >= c), truth & (p < c)))
        return f1_of(tp, fp, fn)

    return (
        scored.withColumn("p", F.when(is_scored(p), p))
        .withColumn("threshold", cut_of(thresholds))
        .groupBy("model", "threshold")
        .agg(
            f1_at(F.lit(0.5)).alias("f1_at_half"),
            f1_at(cut).alias("f1_at_cut"),
            F.count_if(p.isNull()).alias("n_unscored"),
        )
        .withColumn("gain_points", (F.col("f1_at_cut") - F.col("f1_at_half")) * 100.0)
    )
