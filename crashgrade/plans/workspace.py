"""Tables and models that several queries share.

Each shared table is written once, to the shared folder, and read back: this
cuts its lineage, gives the optimizer exact sizes, and lets a lost executor be
replaced without running its history again. A workspace belongs to one
application and one input folder, and sees the input as it was at first use.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from functools import cached_property
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashgrade.functions.hexgrid import RESOLUTIONS
from crashgrade.models import classifiers, discriminant, prepare
from crashgrade.models.discriminant import Discriminant
from crashgrade.models.stack import ALL_MODELS, BASE_MODELS, fit_stack, stack_scores
from crashgrade.operators import clean, collinear, features, integrate, split, threshold
from crashgrade.session import shared_folder
from crashgrade.sources import derived, readers, sinks

KEY = "accident_id"
OUTLIER_COLUMNS = ("precip", "temp_c", "wind_ms")

_OPEN: dict[tuple[str, str], "Workspace"] = {}


def workspace(spark: SparkSession, folder: str) -> "Workspace":
    key = (spark.sparkContext.applicationId, folder.rstrip("/"))
    if key not in _OPEN:
        _OPEN[key] = Workspace(spark, folder.rstrip("/"))
    return _OPEN[key]


def opened(spark: SparkSession, folder: str, kind: str, build: Callable[[], "Workspace"]) -> "Workspace":
    """A workspace of another kind over the same input, built on first use."""
    key = (spark.sparkContext.applicationId, f"{folder.rstrip('/')}#{kind}")
    if key not in _OPEN:
        _OPEN[key] = build()
    return _OPEN[key]


def forget(spark: SparkSession, folder: str) -> None:
    """Drops a workspace, so that the next use reads changed input anew."""
    name = folder.rstrip("/")
    for app, path in list(_OPEN):
        if app == spark.sparkContext.applicationId and path.split("#")[0] == name:
            ws = _OPEN.pop((app, path))
            if "train" in ws.__dict__:
                ws.train.unpersist()


# Forests draw their bags per partition, so the training rows lie in the same
# number of partitions on every machine. Set `crashgrade.training.partitions`
# for a table whose partitions would not fit into memory.
TRAINING_PARTITIONS = 32


def lay_out(df: DataFrame, key: str) -> DataFrame:
    """The same rows in the same order in the same partitions, whatever the
    files, cores or executors."""
    n = int(df.sparkSession.conf.get("crashgrade.training.partitions", str(TRAINING_PARTITIONS)))
    return df.repartition(n, key).sortWithinPartitions(key)


class Workspace:
    # What tells accidents apart, and the candidate features.
    key = KEY
    registry_list = features.REGISTRY

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        digest = hashlib.md5(folder.encode()).hexdigest()[:12]
        # A folder of its own, so that a later workspace leaves these files alone.
        self.root = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{digest}-{uuid.uuid4().hex[:8]}"
        self._written: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stored(
        self, name: str, build: Callable[[], DataFrame], fmt: str = "parquet", **options: str
    ) -> str:
        """Path of a table, which is written on first use."""
        return self.stored_folder(
            name,
            lambda path: build().write.mode("overwrite").format(fmt).options(**options).save(path),
        )

    def stored_folder(self, name: str, write: Callable[[str], None]) -> str:
        """Path of whatever `write` puts there, on first use."""
        path = self.path(name)
        if name not in self._written:
            write(path)
            self._written.add(name)
        return path

    def table(self, name: str, build: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
        """A table in Parquet; with `by`, a folder per value, so that a filter on
        it reads those rows only."""
        if by is None:
            return self.spark.read.parquet(self.stored(name, build))
        path = self.stored_folder(name, lambda to: build().write.partitionBy(by).parquet(to))
        return self.spark.read.parquet(path)

    # Sources

    def road_path(self) -> str:
        return self.stored("road", lambda: derived.road_features(self.spark, self.folder))

    def road(self) -> DataFrame:
        return readers.read_road_features(self.spark, self.road_path())

    def weather_path(self) -> str:
        return self.stored("weather", lambda: derived.weather(self.spark, self.folder))

    def weather(self) -> DataFrame:
        return readers.read_weather(self.spark, self.weather_path())

    def zones(self) -> DataFrame:
        return self.table(
            "zones",
            lambda: derived.zones(self.spark, self.folder, derived.zone_infra(self.road())),
        )

    def accidents(self) -> DataFrame:
        return self.table(
            "accidents", lambda: derived.accidents(self.spark, self.folder, self.zones())
        )

    def raw_accidents_path(self, source: str, fmt: str = "parquet", **options: str) -> str:
        shape = {"br": derived.accidents_br, "us": derived.accidents_us}[source]
        return self.stored(f"raw_{source}_{fmt}", lambda: shape(self.accidents()), fmt, **options)

    def raw_accidents(self, source: str) -> DataFrame:
        return readers.read_accidents(self.spark, self.raw_accidents_path(source), source)

    def consolidated(self) -> DataFrame:
        return integrate.consolidate(self.raw_accidents("br"), self.raw_accidents("us"))

    # Road statistics per hex cell

    def with_cells(self, df: DataFrame) -> DataFrame:
        return integrate.with_cells(df, derived.BASE_EDGE_M, derived.STANDARD_LATS)

    def cell_statistics(self, res: int, *names: str) -> DataFrame:
        """Statistics `names` of the cells of one resolution."""
        cells = self.table(
            "cells",
            lambda: integrate.cell_statistics(
                self.with_cells(self.road()), RESOLUTIONS, derived.BRIDGE_TYPE
            ),
            by="res",
        )
        return cells.where(F.col("res") == res).select(F.col("cell").alias(f"cell_{res}"), *names)

    # Base for the models

    def joined(self) -> DataFrame:
        """Accidents with weather, cell statistics and all candidate features."""

        def build() -> DataFrame:
            places = self.with_cells(self.accidents())
            df = integrate.attach_weather(places, self.weather(), spread_by="row_id")
            for res, names in (
                (9, ["road_len", "n_curves", "urban"]),
                (10, ["road_len", "bridge_len", "dominant"]),
                (11, ["road_len"]),
            ):
                df = integrate.attach_infra(
                    df, self.cell_statistics(res, *names), f"cell_{res}", f"hex{res}_",
                    spread_by="row_id", key_source=places,
                )
            df = features.interaction_features(features.temporal_features(df))
            df = features.one_hot(df, "road_type", derived.ACCIDENT_ROADS, "road_")
            df = features.one_hot(df, "hex10_dominant", derived.ROAD_TYPES, "dominant_")
            return split.split3(df.withColumnRenamed("hex9_urban", "urban"), KEY)

        return self.table("joined", build, by="part")

    @cached_property
    def bounds(self) -> DataFrame:
        found = clean.outlier_bounds(self.joined(), OUTLIER_COLUMNS)
        return self.spark.createDataFrame(found.collect(), found.schema)

    def base(self) -> DataFrame:
        """The clean base. The fences are constants that filter the scan of the
        joined table, so it is not written a second time."""
        return clean.remove_outliers(self.joined(), self.bounds)

    def train_rows(self) -> DataFrame:
        return self.base().where(F.col("part") == "train")

    @cached_property
    def vif_trace(self) -> DataFrame:
        names = [f.name for f in self.registry_list]
        return collinear.vif_stepwise(self.train_rows(), names)

    @cached_property
    def accepted(self) -> list[features.Feature]:
        """Accepted features: scaled ones first, then 0/1 flags, as in the vector."""
        kept = {r["feature"] for r in self.vif_trace.where("kept").collect()}
        chosen = [f for f in self.registry_list if f.name in kept]
        return [f for f in chosen if f.scaled] + [f for f in chosen if not f.scaled]

    @property
    def feature_names(self) -> list[str]:
        return [f.name for f in self.accepted]

    def registry(self) -> DataFrame:
        return features.registry_table(self.spark, self.feature_names)

    # Models

    @cached_property
    def preparation(self) -> PipelineModel:
        scaled = [f.name for f in self.accepted if f.scaled]
        flags = [f.name for f in self.accepted if not f.scaled]
        return prepare.fit_preparation(self.train_rows(), scaled, flags)

    def vectors(self) -> DataFrame:
        return self.table(
            "vectors",
            lambda: prepare.prepare(
                self.preparation, self.base(), self.feature_names,
                [self.key, "part", "severe", "cell_9", "hour"],
            ),
            by="part",
        )

    @cached_property
    def train(self) -> DataFrame:
        rows = self.vectors().where(F.col("part") == "train")
        return lay_out(rows.select(self.key, "severe", "features"), self.key).persist()

    @cached_property
    def early_stop(self) -> tuple[PipelineModel, list[tuple[int, int, float]]]:
        return classifiers.fit_mlp_early_stop(self.train, len(self.accepted), self.key)

    @cached_property
    def _fitted(self) -> dict[str, PipelineModel | Discriminant]:
        return {}

    def model(self, name: str) -> PipelineModel | Discriminant:
        """A base model, fitted on first use."""
        fit = {
            "logistic": lambda: classifiers.fit_logistic(self.train),
            "lda": lambda: discriminant.fit_lda_on_vector(self.train, self.feature_names),
            "forest": lambda: classifiers.fit_forest(self.train),
            "mlp": lambda: self.early_stop[0],
            "boosted": lambda: classifiers.fit_boosted(self.train),
        }
        if name not in self._fitted:
            self._fitted[name] = fit[name]()
        return self._fitted[name]

    def models(self, parallelism: int = 3) -> dict[str, PipelineModel | Discriminant]:
        """All base models. They do not depend on each other, so several are
        fitted at a time: their many short jobs fill each other's gaps."""
        self.train.count()
        with ThreadPool(parallelism) as pool:
            # The longest fit starts first.
            pool.map(inheritable_thread_target(self.spark)(self.model), BASE_MODELS[::-1], chunksize=1)
        return {name: self.model(name) for name in BASE_MODELS}

    def base_scores(self) -> DataFrame:
        """Base scores of the meta and test rows."""

        def build() -> DataFrame:
            unseen = self.vectors().where(F.col("part") != "train")
            return classifiers.base_scores(self.models(), unseen).drop("features")

        return self.table("base_scores", build, by="part")

    @cached_property
    def stack(self) -> PipelineModel:
        return fit_stack(self.base_scores().where(F.col("part") == "meta"))

    def scores(self) -> DataFrame:
        """Scores of all six models for the meta and test rows."""
        return self.table("scores", lambda: stack_scores(self.stack, self.base_scores()), by="part")

    def thresholds(self) -> DataFrame:
        def build() -> DataFrame:
            meta = self.scores().where(F.col("part") == "meta")
            return threshold.tune_all(meta, ALL_MODELS)

        path = self.stored_folder("thresholds", lambda to: sinks.write_thresholds(build(), to))
        return sinks.read_thresholds(self.spark, path)

    def long_scores(self, part: str) -> DataFrame:
        return threshold.score_rows(self.scores().where(F.col("part") == part), ALL_MODELS)
