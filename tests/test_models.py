import numpy as np
import pytest
from conftest import MEDIUM
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from crashgrade.models import classifiers, discriminant, prepare, stack
from crashgrade.operators import explain, metrics
from crashgrade.plans.queries import QUERIES

CEILING = 0.8473


def test_models_approach_the_planted_score(ws):
    table = {r["model"]: r for r in metrics.compare_models(ws.long_scores("test"), ws.thresholds()).collect()}
    assert set(table) == set(stack.ALL_MODELS)
    for name in ("boosted", "stack", "logistic", "lda"):
        assert CEILING - 0.06 < table[name]["auc"] < CEILING + 0.03
    assert table["stack"]["auc"] > table["logistic"]["auc"] - 0.01
    assert all(r["auc"] > 0.7 and r["f1"] > 0.4 for r in table.values())


def test_auc_agrees_with_the_built_in_evaluator(ws):
    test = ws.scores().where("part = 'test'")
    ours = metrics.roc_auc(ws.long_scores("test")).where("model = 'boosted'").first()["auc"]
    builtin = BinaryClassificationEvaluator(
        rawPredictionCol="boosted", labelCol="severe", numBins=0
    ).evaluate(test)
    assert ours == pytest.approx(builtin, abs=1e-12)


def test_tuned_cut_is_no_worse_than_half_on_its_own_rows(ws):
    from crashgrade.operators.threshold import threshold_gain

    got = threshold_gain(ws.long_scores("meta"), ws.thresholds()).collect()
    assert len(got) == 6 and all(r["gain_points"] >= 0 for r in got)


def test_training_rows_lie_the_same_however_they_arrive(spark):
    from crashgrade.plans.workspace import lay_out

    df = spark.range(500)

    def placed(n):
        rows = lay_out(df.repartition(n), "id")
        return rows.selectExpr("id", "spark_partition_id() AS p").collect()

    assert placed(1) == placed(8)


def test_lda_matches_the_textbook_formula(ws):
    cols = ["precip", "bridge_len", "n_curves", "mean_speed"]
    data = ws.accidents().select(*cols, "severe").toPandas().astype(float)
    x, y = data[cols].to_numpy(), data["severe"].to_numpy()
    m0, m1 = x[y == 0].mean(0), x[y == 1].mean(0)
    resid = x - np.where(y[:, None] == 1, m1, m0)
    pooled = resid.T @ resid / (len(y) - 2)
    want = np.linalg.solve(pooled, m1 - m0)
    model = discriminant.fit_lda(ws.accidents(), cols)
    assert model.coefficients == pytest.approx(want, rel=1e-6)
    intercept = np.log(y.sum() / (1 - y).sum()) - (m0 + m1) @ want / 2
    assert model.intercept == pytest.approx(intercept, rel=1e-6)


def test_lda_survives_constant_and_repeated_columns(spark):
    df = spark.range(400).select(
        F.col("id").cast("double").alias("a"), F.col("id").cast("double").alias("b"),
        F.lit(1.0).alias("c"), (F.col("id") % 7 + F.col("id") / 100 > 5).cast("int").alias("severe"),
    )
    model = discriminant.fit_lda(df, ["a", "b", "c"])
    assert np.isfinite(model.coefficients).all() and model.coefficients[2] == 0
    with pytest.raises(ValueError):
        discriminant.fit_lda(df.where("severe = 1"), ["a"])


def test_logistic_regression_is_at_its_optimum(ws):
    """At the optimum the residuals are orthogonal to every input."""
    scored = classifiers.add_score(ws.train, ws.model("logistic"), "p")
    row = scored.agg(F.sum("severe"), F.sum("p")).first()
    assert row[0] == pytest.approx(row[1], rel=1e-3)


def test_oversampling_keeps_every_row_and_balances(ws):
    weight = prepare.positive_weight(ws.train)
    more = classifiers.oversample(ws.train, weight, "accident_id")
    assert ws.train.select("accident_id").exceptAll(more.select("accident_id").distinct()).count() == 0
    counts = {r["severe"]: r["count"] for r in more.groupBy("severe").count().collect()}
    assert counts[1] == pytest.approx(counts[0], rel=0.02)
    negatives = ws.train.where("severe = 0").count()
    assert counts[0] == negatives


def test_oversampling_of_rare_negatives(spark):
    df = spark.range(100).select("id", (F.col("id") >= 20).cast("int").alias("severe"))
    counts = {
        r["severe"]: r["count"]
        for r in classifiers.oversample(df, 20 / 80, "id").groupBy("severe").count().collect()
    }
    assert counts == {0: 80, 1: 80}


def test_early_stopping_returns_the_best_round(ws):
    model, history = ws.early_stop
    losses = [loss for _, _, loss in history]
    assert len(history) < 20 and min(losses) <= losses[0]
    assert model.stages[-1].getLayers()[0] == len(ws.accepted)


def test_models_come_back_from_disk_with_the_same_scores(spark, ws):
    rows = QUERIES["model_roundtrip"](spark, MEDIUM).collect()
    assert {r["model"] for r in rows} == set(stack.ALL_MODELS)
    assert all(r["max_gap"] == 0 for r in rows)


def test_preparation_depends_on_training_rows_only(ws):
    scaled = ["precip", "temp_c"]
    flags = ["rush_hour"]
    first = prepare.fit_preparation(ws.train_rows(), scaled, flags)
    shifted = ws.base().withColumn(
        "precip", F.when(F.col("part") == "test", F.col("precip") + 1000).otherwise(F.col("precip"))
    )
    again = prepare.fit_preparation(shifted.where("part = 'train'"), scaled, flags)
    assert np.array_equal(first.stages[2].mean.toArray(), again.stages[2].mean.toArray())
    assert first.stages[2].getWithMean()


def test_missing_weather_becomes_the_training_mean(ws):
    prepared = prepare.fit_preparation(ws.train_rows(), ["temp_c", "precip"], ["rush_hour"])
    gap = ws.base().where("temp_c IS NULL")
    assert gap.count() > 0
    vectors = prepare.prepare(prepared, gap, ["temp_c", "precip", "rush_hour"], ["accident_id"])
    z = [float(r["features"][0]) for r in vectors.collect()]
    assert z == pytest.approx([0.0] * len(z), abs=1e-6)


def test_new_rows_get_a_score_and_the_class_of_the_stack_cut(ws):
    cut = ws.thresholds().where("model = 'stack'").first()["threshold"]
    scored = stack.score(
        ws.base(), ws.preparation, ws.models(), ws.stack, ws.thresholds(), ws.feature_names,
        ["accident_id"],
    )
    assert scored.count() == ws.base().count()
    wrong = scored.where((F.col("stack") >= cut).cast("int") != F.col("predicted"))
    assert wrong.count() == 0


def test_importances_are_shares(spark, ws):
    rows = QUERIES["tree_importance"](spark, MEDIUM).collect()
    assert sum(r["importance"] for r in rows) == pytest.approx(1)
    groups = QUERIES["group_importance"](spark, MEDIUM).collect()
    assert sum(r["importance"] for r in groups) == pytest.approx(1)


def test_permutation_importance_knows_the_planted_factors(spark, ws):
    loss = {r["feature"]: r["auc_loss"] for r in QUERIES["permutation_importance_boosted"](spark, MEDIUM).collect()}
    assert loss["(none)"] == 0
    assert set(loss) == {"(none)", *ws.feature_names}
    assert max(loss, key=loss.get) in {"bridge_len", "precip"}
    assert loss["rush_hour"] > 0.01 and abs(loss["weekday"]) < 0.01


def test_shuffled_columns_are_permutations(ws):
    df = ws.accidents().select("accident_id", "precip", "bridge_len")
    moved = explain.shuffle_columns(df, ["precip", "bridge_len"], "accident_id", 5)
    assert moved.select("precip").exceptAll(moved.select(F.col("precip_other"))).count() == 0
    assert moved.where("precip = precip_other").count() < 0.2 * moved.count()


def test_shuffling_does_not_depend_on_the_number_of_ranges(ws):
    df = ws.accidents().select("accident_id", "precip")
    one, many = (explain.shuffle_columns(df, ["precip"], "accident_id", n) for n in (1, 64))
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_importance_does_not_depend_on_copies(spark):
    """Copies of a row scatter, so the loss is that of unique rows."""
    losses = []
    for n in (1, 5, 50):
        df = spark.range(4000 * n).select(
            "id",
            (F.col("id") % 4000).cast("double").alias("x"),
            (F.col("id") % 4000 > 2000).cast("int").alias("severe"),
        )
        got = explain.permutation_importance(df, ["x"], lambda d: d.withColumn("p", F.col("x")), "id")
        losses.append({r["feature"]: r["auc_loss"] for r in got.collect()}["x"])
    assert max(losses) - min(losses) < 0.02
    assert losses[0] == pytest.approx(0.5, abs=0.03)


def test_linear_shap_adds_up_to_the_score(ws):
    weights = {"precip": 2.0, "bridge_len": -0.5}
    shap = explain.linear_shap(ws.accidents(), weights, "accident_id")
    means = ws.accidents().agg(F.avg("precip"), F.avg("bridge_len")).first()
    both = shap.withColumnsRenamed({"precip": "sp", "bridge_len": "sb"}).join(ws.accidents(), "accident_id")
    base = 2.0 * means[0] - 0.5 * means[1]
    gap = F.abs(F.col("sp") + F.col("sb") + base - (2.0 * F.col("precip") - 0.5 * F.col("bridge_len")))
    assert both.agg(F.max(gap)).first()[0] < 1e-9


def test_residential_roads_lower_severity(spark, ws):
    rows = {r["feature"]: r for r in QUERIES["effect_direction_models"](spark, MEDIUM).collect()}
    assert rows["road_view"]["direction"] == rows["road_view"]["model_direction"] == "lowers"
    assert rows["rush_hour"]["direction"] == rows["rush_hour"]["model_direction"] == "raises"


def test_projection_has_every_row(spark, ws):
    assert QUERIES["project_2d"](spark, MEDIUM).count() == ws.base().count()


def test_report_has_five_verdicts(spark, ws):
    rows = {r["hypothesis"]: r for r in QUERIES["hypothesis_report"](spark, MEDIUM).collect()}
    assert set(rows) == {1, 2, 3, 4, 5}
    assert rows[1]["confirmed"] == rows[2]["confirmed"] == rows[3]["confirmed"] == 1


def test_chance_bar_is_reported_even_if_no_model_passes(spark, ws):
    rows = QUERIES["chance_models"](spark, MEDIUM).collect()
    assert len(rows) == 6
    assert all(r["passes"] == int(r["accuracy"] > r["bar"]) for r in rows)


def test_everything_is_stored_and_scores_new_rows(spark, ws, tmp_path):
    from crashgrade.plans import artifacts

    folder = str(tmp_path / "results")
    artifacts.store_results(ws, folder)
    rows = {r["artifact"]: r["n_rows"] for r in artifacts.inventory(spark, folder).collect()}
    assert rows["clean_base"] == ws.base().count()
    assert rows["features"] == rows["importance"] == len(ws.feature_names)
    assert rows["thresholds"] == rows["comparison"] == rows["confusion"] == 6
    new = ws.base().where("part = 'test'").select("accident_id", *ws.feature_names)
    scored = artifacts.score_new(spark, folder, new, ["accident_id"])
    before = ws.scores().where("part = 'test'").select("accident_id", F.col("stack").alias("first"))
    gap = scored.join(before, "accident_id").agg(F.count("*"), F.max(F.abs(F.col("stack") - F.col("first")))).first()
    assert gap[0] == new.count() and gap[1] == 0


def test_a_forgotten_workspace_is_built_anew(spark):
    from conftest import SMALL

    from crashgrade.plans.workspace import forget, workspace

    first = workspace(spark, SMALL)
    assert workspace(spark, SMALL + "/") is first
    forget(spark, SMALL)
    assert workspace(spark, SMALL) is not first
