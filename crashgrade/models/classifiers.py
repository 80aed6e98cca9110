"""The base classifiers. Each takes rows with `features` and `severe`.

Class weighting is an option of all of them. It is on by default except for
logistic regression, the plain baseline.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashgrade.functions.hashing import salted_hash
from crashgrade.models.discriminant import Discriminant
from crashgrade.models.prepare import positive_weight, weight_column

SEED = 42
WEIGHT = "class_weight"


def _weighted(train: DataFrame, balanced: bool) -> DataFrame:
    weight = positive_weight(train) if balanced else 1.0
    return train.withColumn(WEIGHT, weight_column(weight))


def fit_logistic(
    train: DataFrame, balanced: bool = False, max_iter: int = 100, tolerance: float = 1e-6
) -> PipelineModel:
    learner = LogisticRegression(
        featuresCol="features", labelCol="severe", weightCol=WEIGHT, maxIter=max_iter,
        tol=tolerance,
    )
    return PipelineModel([learner.fit(_weighted(train, balanced))])


def fit_forest(
    train: DataFrame, sample: float = 0.10, trees: int = 50, depth: int = 8, balanced: bool = True,
    bootstrap: bool = True,
) -> PipelineModel:
    """Random forest; every tree sees a tenth of the rows, drawn with
    replacement unless `bootstrap` is off."""
    learner = RandomForestClassifier(
        featuresCol="features", labelCol="severe", weightCol=WEIGHT, numTrees=trees,
        maxDepth=depth, subsamplingRate=sample, bootstrap=bootstrap, seed=SEED,
    )
    return PipelineModel([learner.fit(_weighted(train, balanced))])


def fit_boosted(
    train: DataFrame, trees: int = 80, depth: int = 4, step: float = 0.1, balanced: bool = True
) -> PipelineModel:
    """Gradient boosted trees. The lineage is cut in the checkpoint folder."""
    learner = GBTClassifier(
        featuresCol="features", labelCol="severe", weightCol=WEIGHT, maxIter=trees,
        maxDepth=depth, stepSize=step, checkpointInterval=10, seed=SEED,
    )
    return PipelineModel([learner.fit(_weighted(train, balanced))])


def oversample(train: DataFrame, weight: float, key: str) -> DataFrame:
    """Repeats rows of the rarer class until both weigh the same. The network
    takes no weights; repeating keeps every row, dropping would not."""
    rarer, times = (1, weight) if weight >= 1 else (0, 1 / weight)
    whole = int(times)
    extra = salted_hash("extra", F.col(key)) % 1_000_000 < int((times - whole) * 1_000_000)
    copies = F.when(F.col("severe") == rarer, F.lit(whole) + extra.cast("int")).otherwise(F.lit(1))
    return train.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("copy")


# Rows that Spark's network takes at a time. Every block weighs the same, so
# rows of a partition's last, shorter block weigh more; with blocks of 1 all rows
# weigh alike, at the price of speed.
BLOCK_ROWS = 128


def _network(
    layers: Sequence[int], iterations: int, initial=None, block_rows: int = BLOCK_ROWS
) -> MultilayerPerceptronClassifier:
    learner = MultilayerPerceptronClassifier(
        featuresCol="features", labelCol="severe", layers=list(layers), maxIter=iterations,
        seed=SEED, blockSize=block_rows,
    )
    return learner.setInitialWeights(initial) if initial is not None else learner


def fit_mlp(
    train: DataFrame, n_features: int, key: str, hidden: Sequence[int] = (16, 8),
    iterations: int = 100, balanced: bool = True,
) -> PipelineModel:
    rows = oversample(train, positive_weight(train), key) if balanced else train
    return PipelineModel([_network([n_features, *hidden, 2], iterations).fit(rows)])


def log_loss(model: PipelineModel, rows: DataFrame, weight: float) -> float:
    """Mean log loss, positives weighted."""
    p = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), vector_to_array("probability")[1]))
    w = weight_column(weight)
    loss = -F.when(F.col("severe") == 1, F.log(p)).otherwise(F.log(1.0 - p))
    row = model.transform(rows).agg((F.sum(w * loss) / F.sum(w)).alias("loss")).first()
    return row["loss"]


def fit_mlp_early_stop(
    train: DataFrame, n_features: int, key: str, hidden: Sequence[int] = (16, 8), step: int = 10,
    patience: int = 2, max_rounds: int = 20, tolerance: float = 1e-4,
    valid_thousandths: int = 100, balanced: bool = True, block_rows: int = BLOCK_ROWS,
) -> tuple[PipelineModel, list[tuple[int, int, float]]]:
    """Trains in rounds of `step` iterations, each going on from the last
    weights, until the loss on a hash slice of the training rows has not fallen
    by `tolerance` for `patience` rounds. Returns the best network and, per round, its
    number, the iterations so far and the validation loss."""
    weight = positive_weight(train) if balanced else 1.0
    slice_ = salted_hash("valid", F.col(key)) % 1000
    valid = train.where(slice_ < valid_thousandths).persist()
    fit_rows = train.where(slice_ >= valid_thousandths)
    fit_rows = (oversample(fit_rows, weight, key) if balanced else fit_rows).persist()
    layers = [n_features, *hidden, 2]
    best, best_loss, waited, weights = None, float("inf"), 0, None
    history = []
    for number in range(1, max_rounds + 1):
        network = _network(layers, step, weights, block_rows).fit(fit_rows)
        weights = network.weights
        model = PipelineModel([network])
        loss = log_loss(model, valid, weight)
        history.append((number, number * step, loss))
        if loss < best_loss - tolerance:
            best, best_loss, waited = model, loss, 0
        else:
            waited += 1
            if waited >= patience:
                break
    valid.unpersist()
    fit_rows.unpersist()
    return best, history


def add_score(df: DataFrame, model: PipelineModel | Discriminant, name: str) -> DataFrame:
    """P(severe) of one model as the column `name`."""
    if isinstance(model, Discriminant):
        return df.withColumn(name, model.probability())
    return (
        model.transform(df)
        .withColumn(name, vector_to_array("probability")[1])
        .drop("rawPrediction", "probability", "prediction")
    )


def base_scores(models: dict[str, PipelineModel | Discriminant], df: DataFrame) -> DataFrame:
    """P(severe) of all models side by side, in one pass over the rows."""
    for name, model in models.items():
        df = add_score(df, model, name)
    return df
