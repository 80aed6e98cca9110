"""Both outcomes of every verdict, on small tables."""

import pytest

from crashgrade.operators import clean, explain
from crashgrade.plans import hypotheses as h


def compared(spark, **auc_and_f1):
    rows = [(m, a, f) for m, (a, f) in auc_and_f1.items()]
    return spark.createDataFrame(rows, "model string, auc double, f1 double")


def verdict(df):
    row = df.collect()
    assert len(row) == 1
    return row[0]["left_value"], row[0]["right_value"], row[0]["confirmed"]


def test_road_against_climate(spark):
    def groups(road, climate):
        return spark.createDataFrame(
            [("road", road), ("climate", climate), ("time", 0.9)],
            "feature_group string, importance double",
        )

    assert verdict(h.road_over_climate(groups(0.4, 0.3))) == (0.4, 0.3, 1)
    assert verdict(h.road_over_climate(groups(0.2, 0.3))) == (0.2, 0.3, 0)


def test_road_without_any_climate_feature(spark):
    only = spark.createDataFrame([("road", 0.4)], "feature_group string, importance double")
    assert verdict(h.road_over_climate(only)) == (0.4, 0.0, 1)


def test_interactions(spark):
    schema = "feature string, vif double, accepted boolean"
    passed = [("rain_x_curves", 2.0, True), ("temp_x_curvature", 3.0, True), ("speed_x_lanes", 99.0, False)]
    assert verdict(h.interactions_pass(spark.createDataFrame(passed, schema))) == (2, 2, 1)
    failed = [("rain_x_curves", 2.0, True), ("temp_x_curvature", 30.0, False)]
    assert verdict(h.interactions_pass(spark.createDataFrame(failed, schema))) == (1, 2, 0)


@pytest.mark.parametrize("weight, held", [(0.4, 1), (0.0, 0), (None, 0)])
def test_country(spark, weight, held):
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 0)] * 50, "country_flag int, severe int")
    names = [("country_flag", weight)] if weight is not None else [("precip", 1.0)]
    table = spark.createDataFrame(names, "feature string, coefficient double")
    assert verdict(h.country_controls(rows, table)) == (0.5, 0.0, held)


def test_models(spark):
    win = compared(spark, boosted=(0.8, 0.5), mlp=(0.7, 0.4), logistic=(0.75, 0.4), lda=(0.7, 0.4), stack=(0.81, 0.51))
    assert verdict(h.nonlinear_over_linear(win)) == (0.8, 0.75, 1)
    assert verdict(h.stack_over_best(win)) == (0.81, 0.8, 1)
    lose = compared(spark, boosted=(0.7, 0.5), mlp=(0.7, 0.4), logistic=(0.75, 0.4), lda=(0.7, 0.4), stack=(0.81, 0.49))
    assert verdict(h.nonlinear_over_linear(lose))[2] == 0
    # Better in AUC alone is not enough.
    assert verdict(h.stack_over_best(lose)) == (0.81, 0.75, 0)


def test_hotspots_break_ties_by_key(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(2, 0.5), (1, 0.5), (3, 0.9), (4, 0.1)], "cell long, p double")
    got = h.risk_hotspots(df, F.col("p"), ["cell"], 3).collect()
    assert [r["cell"] for r in got] == [3, 1, 2]


def test_groups_sum_their_features(spark):
    imp = spark.createDataFrame([("a", 0.25), ("b", 0.5), ("c", 0.25)], "feature string, importance double")
    reg = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y")], "feature string, feature_group string")
    got = {r["feature_group"]: r["importance"] for r in explain.group_importance(imp, reg).collect()}
    assert got == {"x": 0.75, "y": 0.25}


def test_funnel_counts_each_step(spark):
    raw = spark.range(10)
    parts = spark.createDataFrame([("train",), ("train",), ("test",)], "part string")
    got = {r["step"]: r["n_rows"] for r in clean.row_funnel(raw, raw.where("id < 3"), parts).collect()}
    assert got == {"raw": 10, "clean": 3, "train": 2, "test": 1}


def test_country_needs_a_difference(spark):
    weights = spark.createDataFrame([("country_flag", 0.3)], "feature string, coefficient double")

    def verdict(severe_of_us):
        rows = [(1, int(i < severe_of_us)) for i in range(100)] + [(0, int(i < 20)) for i in range(100)]
        df = spark.createDataFrame(rows, "country_flag int, severe int")
        return h.country_controls(df, weights).first()["confirmed"]

    assert (verdict(20), verdict(21), verdict(60)) == (0, 0, 1)
