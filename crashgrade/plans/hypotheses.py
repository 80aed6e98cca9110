"""The five hypotheses, answered from result tables, and the risk report.

Each verdict is one row: hypothesis, statement, left_value, right_value,
confirmed. The tables read here have a few rows each.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashgrade.functions.arithmetic import ratio
from crashgrade.operators.paired_auc import SIGNIFICANT, lead

NONLINEAR = ("boosted", "mlp")
LINEAR = ("logistic", "lda")


def _verdict(df: DataFrame, number: int, statement: str, left: Column, right: Column,
             confirmed: Column) -> DataFrame:
    return df.select(
        F.lit(number).alias("hypothesis"),
        F.lit(statement).alias("statement"),
        left.cast("double").alias("left_value"),
        right.cast("double").alias("right_value"),
        confirmed.cast("int").alias("confirmed"),
    )


def _sum_where(condition: Column, value: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0.0))


def road_over_climate(by_group: DataFrame) -> DataFrame:
    """Hypothesis 1: the road group weighs more than the climate group."""
    sums = by_group.agg(
        _sum_where(F.col("feature_group") == "road", "importance").alias("road"),
        _sum_where(F.col("feature_group") == "climate", "importance").alias("climate"),
    )
    road, climate = F.col("road"), F.col("climate")
    return _verdict(sums, 1, "road importance exceeds climate importance", road, climate,
                    road > climate)


def interactions_pass(verdicts: DataFrame) -> DataFrame:
    """Hypothesis 2: rain on curves and cold on bends pass the VIF test."""
    names = ("rain_x_curves", "temp_x_curvature")
    sums = verdicts.where(F.col("feature").isin(*names)).agg(
        F.count_if(F.col("accepted")).alias("passed"), F.count("*").alias("tested")
    )
    passed, tested = F.col("passed"), F.col("tested")
    return _verdict(sums, 2, "climate and road interactions pass the VIF limit", passed, tested,
                    (passed == tested) & (tested > 0))


def country_rates(df: DataFrame) -> DataFrame:
    """Severe share per country."""
    return df.groupBy("country_flag").agg(
        F.count("*").alias("n_rows"),
        ratio(F.sum("severe"), F.count("*")).alias("severe_share"),
    )


def country_controls(df: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Hypothesis 3: the country shifts severity. Confirmed when its flag was
    kept as a control in the model and the severe shares of country 1 and
    country 0, the values shown, differ by 1.96 standard errors or more of a
    two-proportion test."""

    def of(country: int, column: str) -> Column:
        return F.max(F.when(F.col("country_flag") == country, F.col(column)))

    rates = country_rates(df).agg(
        of(1, "severe_share").alias("us"),
        of(0, "severe_share").alias("br"),
        of(1, "n_rows").alias("n_us"),
        of(0, "n_rows").alias("n_br"),
    )
    us, br, n_us, n_br = (F.col(c) for c in ("us", "br", "n_us", "n_br"))
    pooled = ratio(us * n_us + br * n_br, n_us + n_br)
    error = F.sqrt(pooled * (1 - pooled) * (1 / n_us + 1 / n_br))
    differs = F.coalesce(F.abs(us - br) >= F.lit(1.96) * error, F.lit(False)) & (us != br)
    control = coefficients.agg(
        F.max(F.when(F.col("feature") == "country_flag", F.col("coefficient"))).alias("weight")
    ).first()["weight"]
    held = F.lit(bool(control)) & F.coalesce(differs, F.lit(False))
    return _verdict(rates, 3, "country is a control with an effect of its own", F.col("us"),
                    F.col("br"), held)


def country_effect(tests: DataFrame, significant: float = SIGNIFICANT) -> DataFrame:
    """Hypothesis 3: the country shifts severity beside all other features.
    Confirmed when the flag's coefficient in the model is `significant` standard
    errors or more from 0 (shown: their number, and the limit)."""
    z = F.max(F.when(F.col("feature") == "country_flag", F.abs(F.col("z"))))
    found = tests.agg(z.alias("z"))
    held = F.coalesce(F.col("z") >= significant, F.lit(False))
    return _verdict(found, 3, "country is a control with an effect of its own", F.col("z"),
                    F.lit(significant), held)


def _best(models: Sequence[str], metric: str) -> Column:
    return F.max(F.when(F.col("model").isin(*models), F.col(metric)))


def _top(condition: Column, metric: str = "auc") -> Column:
    """Metric and name of the best of some models."""
    return F.max(F.when(condition, F.struct(F.col(metric).alias("value"), F.col("model").alias("name"))))


def _leads(best: DataFrame, pairs: DataFrame | None, better: str, worse: str, significant: float) -> DataFrame:
    """Adds `leads`: is the lead in AUC significant in the paired test? Without
    a table of pairs any lead counts."""
    if pairs is None:
        return best.withColumn("leads", F.lit(True))
    z = lead(pairs).select(F.col("better").alias("_b"), F.col("worse").alias("_w"), F.col("z").alias("_z"))
    same = (F.col(f"{better}.name") == F.col("_b")) & (F.col(f"{worse}.name") == F.col("_w"))
    # One row against one per pair of models.
    return best.join(F.broadcast(z), same, "left").withColumn(
        "leads", F.coalesce(F.col("_z") >= significant, F.lit(False))
    )


def nonlinear_over_linear(
    compared: DataFrame, pairs: DataFrame | None = None, significant: float = SIGNIFICANT
) -> DataFrame:
    """Hypothesis 4: the best non-linear AUC against the best linear one. With
    the paired tests of `paired_auc`, only a significant lead confirms it."""
    best = compared.agg(
        _top(F.col("model").isin(*NONLINEAR)).alias("curved"), _top(F.col("model").isin(*LINEAR)).alias("flat")
    )
    curved, flat = F.col("curved.value"), F.col("flat.value")
    return _verdict(_leads(best, pairs, "curved", "flat", significant), 4,
                    "non-linear models exceed linear ones in AUC", curved, flat,
                    (curved > flat) & F.col("leads"))


def stack_over_best(
    compared: DataFrame, pairs: DataFrame | None = None, significant: float = SIGNIFICANT
) -> DataFrame:
    """Hypothesis 5: the stack against the best single model, in AUC and F1. With
    the paired tests, only a significant lead in AUC confirms it."""
    singles = F.col("model") != "stack"
    best = compared.agg(
        _top(~singles).alias("stack"),
        _top(singles).alias("single"),
        _best(["stack"], "f1").alias("stack_f1"),
        F.max(F.when(singles, F.col("f1"))).alias("best_f1"),
    )
    ours, theirs = F.col("stack.value"), F.col("single.value")
    confirmed = (ours > theirs) & (F.col("stack_f1") > F.col("best_f1")) & F.col("leads")
    return _verdict(_leads(best, pairs, "stack", "single", significant), 5,
                    "the stack exceeds every single model in AUC and F1", ours, theirs, confirmed)


def report(*verdicts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, verdicts)


def risk_hotspots(df: DataFrame, risk: Column, by: Sequence[str], k: int) -> DataFrame:
    """The k places and times with the highest mean risk; ties in key order."""
    return (
        df.groupBy(*by)
        .agg(F.count("*").alias("n_rows"), F.avg(risk).alias("mean_risk"))
        .orderBy(F.desc("mean_risk"), *by)
        .limit(k)
    )
