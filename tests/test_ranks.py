"""Property checks against brute force."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crashgrade.operators import metrics, threshold
from crashgrade.operators.ranks import exact_quantiles, running_totals

FEW = settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
scores = st.lists(
    st.tuples(st.integers(0, 1), st.integers(0, 20).map(lambda i: i / 20)), min_size=2, max_size=60
)


def scored(spark, rows, model="m"):
    data = pd.DataFrame({"model": model, "severe": [r[0] for r in rows], "p": [float(r[1]) for r in rows]})
    return spark.createDataFrame(data)


def brute_auc(rows):
    pos = [p for y, p in rows if y]
    neg = [p for y, p in rows if not y]
    if not pos or not neg:
        return None
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    return wins / (len(pos) * len(neg))


@FEW
@given(rows=scores)
def test_auc_is_the_share_of_ordered_pairs(spark, rows):
    got = metrics.roc_auc(scored(spark, rows)).first()["auc"]
    want = brute_auc(rows)
    assert got == want if want is None else got == pytest.approx(want, abs=1e-12)


@FEW
@given(rows=scores)
def test_sweep_counts_every_cut(spark, rows):
    sweep = threshold.threshold_sweep(scored(spark, rows)).collect()
    assert len(sweep) == 101
    for r in sweep:
        t = r["threshold"]
        assert r["tp"] == sum(y == 1 and p >= t for y, p in rows)
        assert r["fp"] == sum(y == 0 and p >= t for y, p in rows)
        assert r["fn"] == sum(y == 1 and p < t for y, p in rows)


@FEW
@given(
    values=st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60),
    prob=st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 1.0]),
)
def test_quantiles_match_linear_interpolation(spark, values, prob):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = exact_quantiles(df, ["x"], {"q": prob}).first()["q"]
    assert got == pytest.approx(np.quantile(values, prob), rel=1e-9, abs=1e-9)


def test_running_totals_over_many_slots_and_groups(spark):
    df = spark.range(5000).select(
        (F.col("id") % 3).alias("g"), F.sqrt("id").alias("x"), F.lit(1).alias("n")
    )
    got = running_totals(df, "x", ["n"], ["g"]).toPandas().sort_values(["g", "x"])
    for _, part in got.groupby("g"):
        assert list(part["n_before"]) == list(range(len(part)))
        assert (part["n_total"] == len(part)).all()


def test_running_totals_do_not_depend_on_the_cuts(spark):
    df = spark.range(300).select((F.col("id") * 1.5).alias("x"), F.col("id").alias("n"))
    want = running_totals(df, "x", ["n"]).orderBy("x").collect()
    for cuts in ([], [10.0], [-5.0, 3.0, 3.5, 1e9]):
        assert running_totals(df, "x", ["n"], cuts=cuts).orderBy("x").collect() == want


def test_quantiles_by_group_ignore_nulls(spark):
    df = spark.createDataFrame(
        [("a", 1.0, None), ("a", 3.0, 4.0), ("b", 9.0, 8.0), ("b", None, 2.0)],
        "g string, x double, y double",
    )
    got = {(r["g"], r["feature"]): r["m"] for r in exact_quantiles(df, ["x", "y"], {"m": 0.5}, ["g"]).collect()}
    assert got == {("a", "x"): 2.0, ("a", "y"): 4.0, ("b", "x"): 9.0, ("b", "y"): 5.0}


def test_auc_with_all_scores_tied_is_half(spark):
    assert metrics.roc_auc(scored(spark, [(1, 0.3), (0, 0.3), (0, 0.3)])).first()["auc"] == 0.5


def test_auc_does_not_change_under_a_monotone_map(spark):
    df = scored(spark, [(i % 3 == 0, (i * 37 % 101) / 101) for i in range(200)]).withColumn(
        "severe", F.col("severe").cast("int")
    )
    mapped = df.withColumn("p", F.exp(F.col("p") * 5))
    assert metrics.roc_auc(df).first()["auc"] == metrics.roc_auc(mapped).first()["auc"]


def test_cut_index_agrees_with_comparison_at_every_grid_point(spark):
    df = spark.range(101).select((F.col("id") / 100.0).alias("p"), "id")
    assert df.where(threshold.cut_index(F.col("p")) != F.col("id")).count() == 0


def test_best_cut_ties_go_low_and_gain_is_not_negative(spark):
    df = scored(spark, [(1, 0.8), (0, 0.2)])
    best = threshold.best_threshold(threshold.threshold_sweep(df)).first()
    assert (best["threshold"], best["f1"]) == (0.21, 1.0)
    cuts = threshold.best_threshold(threshold.threshold_sweep(df))
    assert threshold.threshold_gain(df, cuts).first()["gain_points"] >= 0


def test_scores_off_the_grid_null_and_nan_are_all_counted(spark):
    rows = [(1, -0.1), (1, 1.0), (1, 1.5), (0, 0.29), (1, None), (0, float("nan"))]
    df = spark.createDataFrame([("m", *r) for r in rows], "model string, severe long, p double")
    sweep = {r["threshold"]: r for r in threshold.threshold_sweep(df).collect()}
    assert len(sweep) == 101 and {r["n_unscored"] for r in sweep.values()} == {2}
    assert (sweep[0.0]["tp"], sweep[0.0]["fp"], sweep[0.0]["fn"]) == (2, 1, 1)
    assert (sweep[0.29]["fp"], sweep[0.3]["fp"], sweep[1.0]["tp"]) == (1, 0, 2)
    assert metrics.roc_auc(df).first()["auc"] == metrics.roc_auc(df.where("p < 2")).first()["auc"]
    conf = metrics.confusion(threshold.apply_threshold(df, 0.5)).first()
    assert (conf["tp"], conf["fp"], conf["tn"], conf["fn"], conf["n_unscored"]) == (2, 0, 1, 1, 2)


def test_points_agree_with_the_sweep_and_have_both_ends(spark):
    df = scored(spark, [(int(i % 3 == 0), i / 100.0) for i in range(101)])
    sweep = {round(r["threshold"] * 100): r["recall"] for r in threshold.threshold_sweep(df).collect()}
    roc = {r["bin"]: r for r in metrics.roc_points(df).collect()}
    assert all(roc[i]["true_positive_rate"] == sweep[i] for i in range(101))
    ends = [(roc[i]["false_positive_rate"], roc[i]["true_positive_rate"]) for i in (-1, 101)]
    assert ends == [(1.0, 1.0), (0.0, 0.0)]


def test_each_model_gets_its_own_cut(spark):
    both = scored(spark, [(1, 0.4), (0, 0.1)], "a").unionByName(scored(spark, [(1, 0.9), (0, 0.6)], "b"))
    cuts = spark.createDataFrame([("a", 0.3), ("b", 0.7)], "model string, threshold double")
    got = threshold.apply_threshold(both, cuts)
    assert got.where("predicted = severe").count() == 4


def test_metrics_of_one_class_only(spark):
    pred = threshold.apply_threshold(scored(spark, [(0, 0.2), (0, 0.8)]), 0.5)
    conf = metrics.confusion(pred)
    assert metrics.accuracy(conf).first()["accuracy"] == 0.5
    assert metrics.balanced_accuracy(conf).first()["balanced_accuracy"] is None
    assert metrics.matthews(conf).first()["matthews"] == 0.0
    assert metrics.roc_auc(pred).first()["auc"] is None
    assert metrics.max_chance(pred).first()["max_chance"] == 1.0
    assert metrics.proportional_chance(pred, conf).first()["bar"] == 1.25


def test_no_rows_and_unusual_values(spark):
    empty = scored(spark, [(1, 0.5)]).where("p > 1")
    assert metrics.roc_auc(empty).count() == 0
    odd = scored(spark, [(0, float("-inf")), (1, 0.2), (0, 0.1), (1, float("inf"))])
    assert metrics.roc_auc(odd).first()["auc"] == 1.0
