"""Evaluation. Predictions come in long form: model, severe, p, predicted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crashgrade.functions.arithmetic import ratio
from crashgrade.operators.ranks import cut_points, running_totals
from crashgrade.operators.threshold import cut_of, f1_of, flagged_counts, is_scored

CHANCE_FACTOR = 1.25


def confusion(pred: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """tp, fp, tn and fn per model, and the rows without a prediction."""
    truth, guess = F.col("severe") == 1, F.col("predicted") == 1
    return pred.groupBy(*by).agg(
        F.count_if(truth & guess).alias("tp"),
        F.count_if(~truth & guess).alias("fp"),
        F.count_if(~truth & ~guess).alias("tn"),
        F.count_if(truth & ~guess).alias("fn"),
        F.count_if(F.col("predicted").isNull()).alias("n_unscored"),
    )


def _cells():
    return F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")


def accuracy(conf: DataFrame) -> DataFrame:
    tp, fp, tn, fn = _cells()
    return conf.withColumn("accuracy", ratio(tp + tn, tp + fp + tn + fn))


def balanced_accuracy(conf: DataFrame) -> DataFrame:
    """Mean of the recall of both classes; null if a class has no rows."""
    tp, fp, tn, fn = _cells()
    return conf.withColumn("balanced_accuracy", (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2.0)


def prf_severe(conf: DataFrame) -> DataFrame:
    """Precision, recall and F1 of the severe class."""
    tp, fp, _, fn = _cells()
    return conf.withColumns(
        {
            "precision": F.coalesce(ratio(tp, tp + fp), F.lit(0.0)),
            "recall": F.coalesce(ratio(tp, tp + fn), F.lit(0.0)),
            "f1": f1_of(tp, fp, fn),
        }
    )


def matthews(conf: DataFrame) -> DataFrame:
    """Matthews correlation; 0 where a margin is empty."""
    tp, fp, tn, fn = (c.cast("double") for c in _cells())
    margins = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return conf.withColumn("matthews", F.coalesce(ratio(tp * tn - fp * fn, margins), F.lit(0.0)))


def score_counts(
    scored: DataFrame, by: Sequence[str] = ("model",), copies: str | None = None
) -> DataFrame:
    """Severe and other rows per distinct score; rows without a score are those
    of the score null. A row may stand for several, whose number is in the
    column `copies`."""
    n = F.col(copies) if copies else F.lit(1)
    return (
        scored.withColumn("p", F.when(is_scored(F.col("p")), F.col("p")))
        .groupBy(*by, "p")
        .agg(
            F.sum(F.col("severe") * n).alias("pos"),
            F.sum((1 - F.col("severe")) * n).alias("neg"),
        )
    )


def _unscored(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """The rows without a score per group, which all have a row here."""
    n = F.when(F.col("p").isNull(), F.col("pos") + F.col("neg")).otherwise(0)
    return counts.groupBy(*by).agg(F.sum(n).alias("n_unscored"))


def _auc(counts: DataFrame, by: Sequence[str], cuts: Sequence[float]) -> DataFrame:
    ranked = running_totals(counts, "p", ["pos", "neg"], by, cuts)

    def wide(c):
        # Products of two row counts can pass 64 bits.
        return c.cast("decimal(19,0)")

    wins_twice = F.sum(wide(F.col("pos")) * wide(2 * F.col("neg_before") + F.col("neg")))
    pairs_twice = wide(F.max("pos_total")) * wide(2 * F.max("neg_total"))
    return ranked.groupBy(*by).agg(ratio(wins_twice, pairs_twice).alias("auc"))


def roc_auc(
    scored: DataFrame, by: Sequence[str] = ("model",), copies: str | None = None
) -> DataFrame:
    """Share of (severe, not severe) pairs that the score puts in order; ties
    count half. Exact: rows are counted per distinct score, then ranked with
    `running_totals`. Null if a class has no rows. `n_unscored` counts the rows
    without a score, which are in no pair."""
    counts = score_counts(scored, by, copies)
    aucs = _auc(counts, by, cut_points(scored, ["p"]))
    # One row per group on either side.
    return _unscored(counts, by).join(aucs, list(by), "left").select(*by, "auc", "n_unscored")


def _rates(scored: DataFrame, bins: int) -> DataFrame:
    """Cumulated counts at every cut, from -1 (all flagged) to bins + 1 (none)."""
    return flagged_counts(scored, bins, -1, bins + 1).withColumnRenamed("i", "bin")


def roc_points(scored: DataFrame, bins: int = 100) -> DataFrame:
    """False and true positive rate when all scores from bin / bins up are
    flagged; bins -1 and bins + 1 are the end points (1, 1) and (0, 0)."""
    return _rates(scored, bins).select(
        "model",
        "bin",
        ratio(F.col("fp"), F.col("all_neg")).alias("false_positive_rate"),
        ratio(F.col("tp"), F.col("all_pos")).alias("true_positive_rate"),
    )


def pr_points(scored: DataFrame, bins: int = 100) -> DataFrame:
    """Precision (null if nothing is flagged) and recall at the same cuts."""
    return _rates(scored, bins).select(
        "model",
        "bin",
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("all_pos")).alias("recall"),
    )


def max_chance(df: DataFrame, target: str = "severe") -> DataFrame:
    """Share of the largest class: the accuracy of always naming it."""
    counts = df.groupBy(target).agg(F.count("*").alias("n"))
    return counts.agg(ratio(F.max("n"), F.sum("n")).alias("max_chance"))


def proportional_chance(
    df: DataFrame, conf: DataFrame, target: str = "severe", factor: float = CHANCE_FACTOR
) -> DataFrame:
    """Sum of squared class shares, the accuracy bar above it, and whether each
    model passes. The share is one number and becomes a constant."""
    counts = df.groupBy(target).agg(F.count("*").cast("double").alias("n"))
    pcc = counts.agg(
        ratio(F.sum(F.col("n") * F.col("n")), F.sum("n") * F.sum("n")).alias("pcc")
    ).first()["pcc"]
    bar = pcc * factor if pcc is not None else None
    return accuracy(conf).select(
        "model",
        "accuracy",
        F.lit(pcc).cast("double").alias("pcc"),
        F.lit(bar).cast("double").alias("bar"),
        (F.col("accuracy") > F.lit(bar).cast("double")).cast("int").alias("passes"),
    )


def compare_models(scored: DataFrame, thresholds: DataFrame) -> DataFrame:
    """One row per model: its cut and all headline metrics, ranked by AUC.

    Confusion and AUC both come from the counts per score, one shuffle. Models
    without a score for some rows are measured on the others; `n_unscored` says
    how many these are.
    """
    counts = score_counts(scored)
    cut = cut_of(thresholds)
    flagged = F.col("p") >= cut

    def total(count: str, where: Column) -> Column:
        return F.sum(F.when(where, F.col(count)).otherwise(0))

    conf = counts.groupBy("model").agg(
        total("pos", flagged).alias("tp"),
        total("neg", flagged).alias("fp"),
        total("neg", ~flagged).alias("tn"),
        total("pos", ~flagged).alias("fn"),
        F.sum(F.when(F.col("p").isNull(), F.col("pos") + F.col("neg")).otherwise(0)).alias("n_unscored"),
    )
    auc = _auc(counts, ["model"], cut_points(scored, ["p"]))
    return (
        prf_severe(balanced_accuracy(accuracy(conf)))
        .join(auc, "model", "left")
        .select(
            "model",
            cut.alias("threshold"),
            "accuracy",
            "balanced_accuracy",
            "f1",
            "auc",
            # One row per model reaches this window.
            F.rank().over(Window.orderBy(F.desc("auc"))).alias("auc_rank"),
            "n_unscored",
        )
    )


def overfit_gap(meta: DataFrame, test: DataFrame) -> DataFrame:
    """Each metric of two `compare_models` tables side by side, and the drop."""
    metrics = ["accuracy", "balanced_accuracy", "f1", "auc"]

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select("model", *metrics).unpivot(["model"], metrics, "metric", name)

    both = long(meta, "on_meta").join(long(test, "on_test"), ["model", "metric"])
    return both.withColumn("fall", F.col("on_meta") - F.col("on_test"))
