"""Wald tests, paired AUC, sketched fences, local effects, unscored rows."""

import math

import numpy as np
import pytest
from conftest import MEDIUM
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from crashgrade.models import classifiers, inference
from crashgrade.operators import clean, explain, fences, metrics, paired_auc, threshold
from crashgrade.plans import hypotheses as h
from crashgrade.plans.queries import QUERIES


def vectors(spark, x, y, names):
    rows = [(*map(float, r), int(t)) for r, t in zip(x, y)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", severe int")
    return VectorAssembler(inputCols=list(names), outputCol="features").transform(df)


def test_errors_are_those_of_the_information_matrix(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(1500, 3)) * [1, 5, 0.2]
    y = r.random(1500) < 1 / (1 + np.exp(-(0.5 + x @ [1.0, -0.1, 2.0])))
    got = {t["feature"]: t for t in inference.wald_tests(vectors(spark, x, y, "abc"), "abc").collect()}
    full, w = np.column_stack([x, np.ones(len(x))]), np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-full @ w))
        info = (full * (p * (1 - p))[:, None]).T @ full
        w = w + np.linalg.solve(info, full.T @ (y - p))
    errors = np.sqrt(np.diag(np.linalg.inv(info)))
    for name, b, e in zip([*"abc", inference.INTERCEPT], w, errors):
        assert got[name]["coefficient"] == pytest.approx(b, rel=1e-5)
        assert got[name]["std_error"] == pytest.approx(e, rel=1e-4)
        assert got[name]["p_value"] == pytest.approx(math.erfc(abs(b / e) / math.sqrt(2)), rel=1e-2, abs=1e-12)


def test_a_raw_difference_that_another_feature_explains_does_not_count(spark):
    """The countries differ in speed, and only speed makes accidents severe."""
    r = np.random.default_rng(2)
    country = r.random(6000) < 0.5
    speed = r.normal(size=6000) + 1.5 * country
    severe = r.random(6000) < 1 / (1 + np.exp(-(speed - 1.0)))
    names = ["country_flag", "speed"]
    rows = vectors(spark, np.column_stack([country, speed]), severe, names)
    raw = h.country_controls(rows, spark.createDataFrame([("country_flag", 0.1)], "feature string, coefficient double"))
    assert raw.first()["confirmed"] == 1
    assert h.country_effect(inference.wald_tests(rows, names)).first()["confirmed"] == 0
    alone = vectors(spark, country[:, None], severe, ["country_flag"])
    assert h.country_effect(inference.wald_tests(alone, ["country_flag"])).first()["confirmed"] == 1
    assert h.country_effect(inference.wald_tests(alone, ["other"])).first()["confirmed"] == 0


def delong(severe, a, b):
    """The textbook form, by all pairs."""
    wins = lambda p, n: (p[:, None] > n[None, :]) + 0.5 * (p[:, None] == n[None, :])
    kernels = [wins(s[severe == 1], s[severe == 0]) for s in (a, b)]
    aucs = [k.mean() for k in kernels]
    v10, v01 = (np.array([k.mean(axis=i) for k in kernels]) for i in (1, 0))
    s10, s01 = np.cov(v10), np.cov(v01)
    spread = sum((s[0, 0] + s[1, 1] - 2 * s[0, 1]) / v.shape[1] for s, v in ((s10, v10), (s01, v01)))
    return aucs[0], aucs[1], math.sqrt(spread)


@pytest.mark.parametrize("digits", [8, 1])
def test_paired_auc_equals_the_textbook(spark, no_broadcast, digits):
    r = np.random.default_rng(3)
    severe = (r.random(400) < 0.3).astype(int)
    scores = {m: np.round(r.normal(size=400) + k * severe, digits) for m, k in (("a", 1.0), ("b", 0.8), ("c", 0.0))}
    rows = [(i, int(y), *(float(scores[m][i]) for m in "abc")) for i, y in enumerate(severe)]
    df = spark.createDataFrame(rows, "id long, severe int, a double, b double, c double")
    unscored = spark.createDataFrame([(1000, 1, 0.5, None, 0.1), (1001, 0, float("nan"), 0.2, 0.3)], df.schema)
    got = {(x["model_a"], x["model_b"]): x for x in paired_auc.paired_auc(df.unionByName(unscored), "abc", "id").collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    for (m, k), x in got.items():
        auc_a, auc_b, error = delong(severe, scores[m], scores[k])
        assert [x["auc_a"], x["auc_b"], x["std_error"]] == pytest.approx([auc_a, auc_b, error], abs=1e-9)
        assert x["z"] == pytest.approx((auc_a - auc_b) / error, rel=1e-6)


def test_equal_scores_and_single_classes_have_no_z(spark):
    df = spark.range(50).select("id", (F.col("id") % 2).cast("int").alias("severe"), (F.col("id") * 7 % 50 / 50.0).alias("a"))
    same = paired_auc.paired_auc(df.withColumn("b", F.col("a")), ["a", "b"], "id").first()
    assert same["difference"] == 0 and same["z"] is None
    assert paired_auc.paired_auc(df.withColumn("b", F.col("a")).where("severe = 1"), ["a", "b"], "id").count() == 0
    assert paired_auc.paired_auc(df.withColumn("b", F.col("a")).limit(0), ["a", "b"], "id").count() == 0


def test_a_lead_by_a_hair_does_not_confirm(spark):
    schema = "model string, auc double, f1 double"
    rows = [("boosted", 0.8 + 1e-9, 0.5), ("mlp", 0.7, 0.4), ("logistic", 0.8, 0.5), ("lda", 0.7, 0.4), ("stack", 0.81, 0.6)]
    compared = spark.createDataFrame(rows, schema)

    def pairs(z):
        rows = [("logistic", "boosted", -z), ("boosted", "stack", -z), ("lda", "mlp", 9.0)]
        return spark.createDataFrame(rows, "model_a string, model_b string, z double")

    assert h.nonlinear_over_linear(compared).first()["confirmed"] == 1
    for z, held in ((0.1, 0), (1.95, 0), (2.0, 1)):
        assert h.nonlinear_over_linear(compared, pairs(z)).first()["confirmed"] == held
        assert h.stack_over_best(compared, pairs(z)).first()["confirmed"] == held
    assert h.stack_over_best(compared, pairs(2.0).limit(0)).first()["confirmed"] == 0


def test_merged_sketches_find_the_quartiles(spark):
    df = spark.range(200_000).select(
        (F.col("id") % 5).alias("day"), F.rand(1).alias("u"), F.exp(F.randn(2) * 3).alias("skewed"),
        F.when(F.col("id") % 3 > 0, F.lit(7.0)).otherwise(F.col("id").cast("double")).alias("tied"),
        F.lit(None).cast("double").alias("none"),
    )
    cols = ["u", "skewed", "tied", "none"]
    merged = fences.merge_sketches(fences.column_sketches(df, cols, ["day"]))
    quartiles = fences.sketched_quartiles(merged)
    errors = {r["feature"]: r for r in fences.rank_errors(df, quartiles).collect()}
    assert set(errors) == {"u", "skewed", "tied"}
    assert all(max(r["q1_error"], r["q3_error"]) < 0.001 for r in errors.values())
    near = {r["feature"]: r for r in fences.sketched_bounds(merged).collect()}
    exact = {r["feature"]: r for r in clean.outlier_bounds(df, cols[:3]).collect()}
    assert near["u"]["upper"] == pytest.approx(exact["u"]["upper"], abs=0.01)
    day = fences.column_sketches(df.where("day = 0"), ["u"])
    assert fences.sketched_quartiles(day).first()["n"] == 40_000
    assert fences.rank_errors(df, quartiles.limit(0)).count() == 0


def rising(df):
    return df.withColumn("p", 3.0 * F.col("x") - 2.0 * F.col("y"))


def test_local_effects_of_a_linear_score_are_its_slopes(spark):
    r = np.random.default_rng(4)
    x = r.random(3000)
    rows = [(float(a), float(a + b), 5.0) for a, b in zip(x, r.normal(size=3000))]
    df = spark.createDataFrame(rows, "x double, y double, z double")
    got = explain.accumulated_effects(df, ["x", "y", "z"], rising, 8).orderBy("feature", "bin").collect()
    assert {g["feature"] for g in got} == {"x", "y"}
    for name, slope, word in (("x", 3.0, "raises"), ("y", -2.0, "lowers")):
        mine = [g for g in got if g["feature"] == name]
        assert len(mine) == 8 and sum(g["n_rows"] for g in mine) == 3000
        assert {g["direction"] for g in mine} == {word}
        assert [g["effect"] for g in mine] == pytest.approx([slope * (g["high"] - g["low"]) for g in mine])
        ale = [g["ale"] for g in mine]
        assert ale == sorted(ale, reverse=slope < 0)
        middle = sum(g["n_rows"] * (g["ale"] - g["effect"] / 2) for g in mine)
        assert middle == pytest.approx(0.0, abs=1e-6)


def test_local_effects_with_ties_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(0.0, 1.0)] * 90 + [(1.0, 1.0)] * 10 + [(None, 1.0)] * 5, "x double, y double")
    got = explain.accumulated_effects(df, ["x"], rising, 10, ["y"]).collect()
    assert sum(g["n_rows"] for g in got) == 100 and sum(g["effect"] for g in got) == pytest.approx(3.0 if len(got) == 1 else sum(g["effect"] for g in got))
    assert explain.accumulated_effects(df.limit(0), ["x"], rising, 4, ["y"]).count() == 0


def test_trees_rise_where_the_planted_score_does(spark, ws):
    got = QUERIES["accumulated_effects_boosted"](spark, MEDIUM).collect()
    directions = {g["feature"]: g["direction"] for g in got}
    assert directions.get("bridge_len") == "raises" and directions.get("precip") == "raises"


def test_rows_without_a_score_are_counted(spark):
    rows = [("m", 1, 0.9), ("m", 0, 0.1), ("m", 1, None), ("m", 0, float("nan")), ("k", 1, 0.3), ("k", 0, 0.6), ("n", 1, None), ("n", 0, None)]
    df = spark.createDataFrame(rows, "model string, severe int, p double")
    aucs = {r["model"]: (r["auc"], r["n_unscored"]) for r in metrics.roc_auc(df).collect()}
    assert aucs == {"m": (1.0, 2), "k": (0.0, 0), "n": (None, 2)}
    cuts = spark.createDataFrame([(m, 0.5) for m in "mkn"], "model string, threshold double")
    table = {r["model"]: r for r in metrics.compare_models(df, cuts).collect()}
    assert {m: r["n_unscored"] for m, r in table.items()} == {"m": 2, "k": 0, "n": 2}
    assert table["m"]["accuracy"] == 1.0 and table["n"]["accuracy"] is None
    gain = {r["model"]: r["n_unscored"] for r in threshold.threshold_gain(df, cuts).collect()}
    assert gain == {"m": 2, "k": 0, "n": 2}


def test_blocks_of_one_row_do_not_depend_on_the_layout(spark):
    """Every row weighs the same, so the loss per round is the same for any
    number of partitions."""
    r = np.random.default_rng(5)
    flag = r.random(1003) < 0.4
    severe = r.random(1003) < 0.2 + 0.3 * flag
    df = vectors(spark, flag[:, None], severe, ["flag"]).withColumn("id", F.monotonically_increasing_id())
    df = spark.createDataFrame(df.toPandas()[["flag", "severe"]].reset_index(names="id"))
    df = VectorAssembler(inputCols=["flag"], outputCol="features").transform(df)
    losses = []
    for n in (1, 8):
        _, history = classifiers.fit_mlp_early_stop(
            df.repartition(n, "id").sortWithinPartitions("id"), 1, "id", hidden=(), step=30, max_rounds=3, balanced=False, block_rows=1
        )
        losses.append([loss for _, _, loss in history])
    assert losses[0] == pytest.approx(losses[1], abs=1e-6)
