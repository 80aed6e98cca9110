"""The stack of the base models, and scoring with everything that is stored."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashgrade.models.classifiers import add_score, base_scores
from crashgrade.models.discriminant import Discriminant, load_lda, save_lda
from crashgrade.models.prepare import prepare
from crashgrade.sources.sinks import load_models, save_models

BASE_MODELS = ("logistic", "lda", "forest", "mlp", "boosted")
STACK = "stack"
ALL_MODELS = (*BASE_MODELS, STACK)


def fit_stack(
    scores_meta: DataFrame, names: Sequence[str] = BASE_MODELS, tolerance: float = 1e-6
) -> PipelineModel:
    """Logistic regression on the base scores of the meta holdout.

    The stack's cut is later tuned on the same rows, as is the practice this
    follows, so its own holdout figures lean to the good side.
    """
    stages = [
        VectorAssembler(inputCols=list(names), outputCol="base_scores"),
        LogisticRegression(featuresCol="base_scores", labelCol="severe", tol=tolerance),
    ]
    return Pipeline(stages=stages).fit(scores_meta)


def stack_scores(model: PipelineModel, df: DataFrame) -> DataFrame:
    return add_score(df, model, STACK).drop("base_scores")


def stack_weights(
    spark: SparkSession, model: PipelineModel, names: Sequence[str] = BASE_MODELS
) -> DataFrame:
    """Weight of each base model, with its sign and its rank by size."""
    weights = model.stages[-1].coefficients.toArray()
    order = sorted(zip(names, weights), key=lambda pair: -abs(pair[1]))
    return spark.createDataFrame(
        [
            (n, float(w), "positive" if w > 0 else "negative" if w < 0 else "none", i + 1)
            for i, (n, w) in enumerate(order)
        ],
        "model string, weight double, sign string, weight_rank int",
    )


def score(
    df: DataFrame,
    preparation: PipelineModel,
    models: dict[str, PipelineModel | Discriminant],
    stack: PipelineModel,
    thresholds: DataFrame,
    cols: Sequence[str],
    keep: Sequence[str],
) -> DataFrame:
    """Scores new rows with the stored models: the stack's probability and the
    class at its cut."""
    vectors = prepare(preparation, df, cols, keep)
    scored = stack_scores(stack, base_scores(models, vectors))
    cut = {r["model"]: r["threshold"] for r in thresholds.collect()}[STACK]
    return scored.select(
        *keep,
        *models,
        STACK,
        (F.col(STACK) >= F.lit(cut)).cast("int").alias("predicted"),
    )


def save_all(
    spark: SparkSession,
    preparation: PipelineModel,
    models: dict[str, PipelineModel | Discriminant],
    stack: PipelineModel,
    folder: str,
) -> None:
    pipelines = {n: m for n, m in models.items() if isinstance(m, PipelineModel)}
    save_models({**pipelines, "preparation": preparation, STACK: stack}, folder)
    for name, model in models.items():
        if isinstance(model, Discriminant):
            save_lda(spark, model, f"{folder}/{name}")


def load_all(spark: SparkSession, folder: str, names: Sequence[str] = BASE_MODELS):
    """(preparation, base models, stack), as `save_all` stored them."""
    pipelines = load_models([n for n in names if n != "lda"] + ["preparation", STACK], folder)
    models = {n: load_lda(spark, f"{folder}/lda") if n == "lda" else pipelines[n] for n in names}
    return pipelines["preparation"], models, pipelines[STACK]
