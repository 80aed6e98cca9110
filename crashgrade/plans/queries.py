"""The registered queries: one per operator, each over whole tables.

Every query takes (spark, folder) and returns a DataFrame whose columns are
bigint, double or string.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashgrade.functions import interactions, temporal
from crashgrade.functions.hexgrid import RESOLUTIONS
from crashgrade.models import classifiers, discriminant, inference, prepare, stack
from crashgrade.operators import (
    cells, clean, collinear, explain, features, fences, integrate, metrics, paired_auc, split, threshold,
)
from crashgrade.operators.weather import VARIABLES, to_utc
from crashgrade.operators.weather import weather_at_place as weather_between
from crashgrade.plans import artifacts, hypotheses
from crashgrade.plans.source_path import CASE, SourceWorkspace, source_workspace
from crashgrade.plans.workspace import KEY, OUTLIER_COLUMNS, Workspace, lay_out, workspace
from crashgrade.sources import derived, readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

WIDENED = {"tinyint", "smallint", "int", "boolean"}


def plain(df: DataFrame) -> DataFrame:
    """Integers and flags as bigint, decimals as double, timestamps as text."""

    def cast(name: str, kind: str):
        if kind in WIDENED:
            return F.col(name).cast("bigint").alias(name)
        if kind.startswith("decimal") or kind == "float":
            return F.col(name).cast("double").alias(name)
        if kind.startswith("timestamp"):
            return F.col(name).cast("string").alias(name)
        return F.col(name)

    return df.select(*[cast(n, k) for n, k in df.dtypes])


def query(fn: Callable[[Workspace], DataFrame]) -> Callable[[Workspace], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return plain(fn(workspace(spark, folder)))

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return fn


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Statistics of doubles differ between engines in their last digits."""
    return df.withColumns({c: F.round(F.col(c), digits) for c in cols})


# Rule scores: known columns of the accidents taken as scores, so that every
# metric can be checked without a fitted model.
RULES = ("rule", "rule_rain", "rule_time")


def rule_scores(ws: Workspace) -> DataFrame:
    rows = split.split3(ws.accidents(), KEY)
    return rows.select(
        KEY,
        "part",
        "severe",
        (F.col("score") / 1000.0).alias("rule"),
        (F.least(F.col("precip"), F.lit(200.0)) / 200.0).alias("rule_rain"),
        (0.25 + 0.5 * F.col("rush_hour")).alias("rule_time"),
    )


def rules_long(ws: Workspace, part: str | None = None) -> DataFrame:
    wide = rule_scores(ws)
    if part:
        wide = wide.where(F.col("part") == part)
    return threshold.score_rows(wide, RULES)


def rules_predicted(ws: Workspace) -> DataFrame:
    return threshold.apply_threshold(rules_long(ws), 0.5)


# Derived tables


@query
def road_features(ws):
    """Road features, straight from the given tables."""
    return derived.road_features(ws.spark, ws.folder)


@query
def zone_infra(ws):
    return derived.zone_infra(derived.road_features(ws.spark, ws.folder))


@query
def weather(ws):
    return derived.weather(ws.spark, ws.folder)


@query
def accidents(ws):
    return derived.accidents(ws.spark, ws.folder, ws.zones()).drop("row_id")


# Sources and sinks


@query
def read_accidents(ws):
    """One source from CSV and one from Parquet, in the common schema."""
    csv = {"header": "true", "sep": ";", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
    path = ws.raw_accidents_path("br", "csv", **csv)
    br = readers.read_accidents(ws.spark, path, "br", "csv", **csv)
    us = readers.read_accidents(ws.spark, ws.raw_accidents_path("us"), "us")
    return br.unionByName(us)


@query
def read_road_features(ws):
    return readers.read_road_features(ws.spark, ws.road_path()).groupBy("road_type", "kind").agg(
        F.count("*").alias("n_features"),
        F.sum("length_km").alias("length_km"),
        F.sum("speed").alias("speed_sum"),
        F.min("lat").alias("south"),
        F.max("lon").alias("east"),
    )


@query
def read_weather(ws):
    return readers.read_weather(ws.spark, ws.weather_path())


@query
def clean_roundtrip(ws):
    path = ws.path("clean_roundtrip")
    bounds = clean.outlier_bounds(ws.accidents(), ["precip", "mean_speed"])
    sinks.write_clean(clean.remove_outliers(ws.accidents(), bounds), path)
    return sinks.read_clean(ws.spark, path).select(
        KEY, "accident_ts", "precip", "mean_speed", "country_flag", "severe"
    )


@query
def features_roundtrip(ws):
    """Survivors of the collinearity test, written as JSON and read back."""
    trace = collinear.vif_stepwise(ws.accidents(), ["mean_speed", "lanes", "speed_x_lanes"])
    kept = [r["feature"] for r in trace.where("kept").collect()]
    path = ws.path("features_roundtrip")
    sinks.write_features(features.registry_table(ws.spark, kept), path)
    return sinks.read_features(ws.spark, path)


@query
def thresholds_roundtrip(ws):
    path = ws.path("thresholds_roundtrip")
    meta = rule_scores(ws).where(F.col("part") == "meta")
    sinks.write_thresholds(threshold.tune_all(meta, RULES), path)
    return sinks.read_thresholds(ws.spark, path)


@query
def metrics_roundtrip(ws):
    path = ws.path("metrics_roundtrip")
    sinks.write_metrics({"confusion": metrics.confusion(rules_predicted(ws))}, path)
    return sinks.read_metrics(ws.spark, path, "confusion")


@query
def model_roundtrip(ws):
    """Largest difference of any score after storing and loading the models."""
    path = ws.path("model_store")
    stack.save_all(ws.spark, ws.preparation, ws.models(), ws.stack, path)
    preparation, models, stacked = stack.load_all(ws.spark, path)
    names = list(stack.ALL_MODELS)
    cols = ws.feature_names
    # Both sets of models score the same rows in turn, without a join.
    rows = prepare.prepare(ws.preparation, ws.base(), cols, cols)
    rows = stack.stack_scores(ws.stack, classifiers.base_scores(ws.models(), rows))
    rows = rows.drop("features").withColumnsRenamed({n: f"first_{n}" for n in names})
    firsts = [f"first_{n}" for n in names]
    rows = prepare.prepare(preparation, rows, cols, firsts)
    rows = stack.stack_scores(stacked, classifiers.base_scores(models, rows))
    gaps = rows.agg(
        *[F.max(F.abs(F.col(n) - F.col(f"first_{n}"))).alias(n) for n in names],
        F.count("*").alias("n_rows"),
    )
    return gaps.unpivot(["n_rows"], names, "model", "max_gap")


def _results(ws: Workspace) -> str:
    """Folder of the stored results, which are written on first use."""
    return ws.stored_folder("results", lambda path: artifacts.store_results(ws, path))


@query
def store_results(ws):
    """All results of the analysis, stored and read back: rows per table."""
    return artifacts.inventory(ws.spark, _results(ws))


@query
def score_new(ws):
    """Class of every accident, outliers too, from the stored models."""
    scored = artifacts.score_new(ws.spark, _results(ws), ws.joined(), [KEY, "part"])
    return scored.groupBy("part", "predicted").agg(F.count("*").alias("n_rows"))


# Integration


@query
def consolidate(ws):
    return ws.consolidated()


@query
def country_flag(ws):
    br = integrate.country_flag(ws.raw_accidents("br").drop("country_flag"), 0)
    us = integrate.country_flag(ws.raw_accidents("us").drop("country_flag"), 1)
    return integrate.consolidate(br, us).groupBy("country_flag").agg(F.count("*").alias("n_rows"))


@query
def hex_cell(ws):
    """Cells of every accident at three resolutions."""
    return ws.with_cells(ws.accidents()).select(KEY, *[f"cell_{r}" for r in RESOLUTIONS])


@query
def infra_by_cell(ws):
    return integrate.infra_by_cell(ws.with_cells(ws.road()), "cell_10", derived.BRIDGE_TYPE)


@query
def length_by_type(ws):
    return integrate.length_by_type(ws.with_cells(ws.road()), "cell_10", derived.ROAD_TYPES)


@query
def dominant_type(ws):
    return integrate.dominant_type(ws.with_cells(ws.road()), "cell_10")


@query
def surroundings(ws):
    return integrate.surroundings(ws.with_cells(ws.road()), "cell_9")


@query
def cell_statistics(ws):
    """All statistics of the cells of all resolutions, from one scan."""
    return integrate.cell_statistics(
        ws.with_cells(ws.road()), RESOLUTIONS, derived.BRIDGE_TYPE
    )


@query
def attach_infra(ws):
    """Statistics of each accident's cell, at all three resolutions."""
    places = ws.with_cells(ws.accidents())
    df = places.select(KEY, "row_id", *[f"cell_{r}" for r in RESOLUTIONS])
    for res in RESOLUTIONS:
        cells = ws.cell_statistics(res, "n_segments", "road_len", "mean_speed")
        df = integrate.attach_infra(
            df, cells, f"cell_{res}", f"hex{res}_", spread_by="row_id", key_source=places
        )
    return df.drop("row_id", *[f"cell_{r}" for r in RESOLUTIONS])


@query
def attach_weather(ws):
    df = ws.accidents().select(KEY, "row_id", "obs_ts", "grid_id")
    return integrate.attach_weather(df, ws.weather(), spread_by="row_id").drop("obs_ts", "row_id")


@query
def joined_features(ws):
    """All candidate features of every accident: the joins and expressions together."""
    names = [f.name for f in features.REGISTRY]
    return ws.joined().select(KEY, "part", "severe", *names)


# The source path: accidents as their sources report them


def of_sources(ws: Workspace) -> SourceWorkspace:
    return source_workspace(ws.spark, ws.folder)


def _dirty_csv(ws: Workspace) -> str:
    """The first country's accidents as lines, with faults by id: a field short,
    a date that is none, a code that is not listed, no id, and no place."""
    csv = [
        F.col("id").cast("string"),
        F.date_format("data_hora", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
        F.col("latitude").cast("string"),
        F.col("longitude").cast("string"),
        F.col("gravidade"),
    ]
    fault = F.col("id") % 50
    lines = {
        0: F.concat_ws(";", *csv[:4]),
        1: F.concat_ws(";", csv[0], F.lit("31/31/2024"), *csv[2:]),
        2: F.concat_ws(";", *csv[:4], F.lit("IGNORADO")),
        3: F.concat_ws(";", F.lit(""), *csv[1:]),
        4: F.concat_ws(";", *csv[:2], F.lit("95.5"), *csv[3:]),
    }
    line = F.concat_ws(";", *csv)
    for k, broken in lines.items():
        line = F.when(fault == k, broken).otherwise(line)
    raw = ws.spark.read.parquet(ws.raw_accidents_path("br"))
    return ws.stored_folder("dirty_csv", lambda to: raw.select(line.alias("value")).write.text(to))


@query
def audit_accidents(ws):
    """Accepted and rejected rows of a faulty file and of a clean one."""
    csv = {"sep": ";", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
    br = readers.read_accidents_audited(ws.spark, _dirty_csv(ws), "br", "csv", **csv)
    us = readers.read_accidents_audited(ws.spark, ws.raw_accidents_path("us"), "us")
    return readers.audit_counts(integrate.consolidate(br, us))


@query
def source_cases(ws):
    """Accidents of both sources with their two-part key and their label."""
    return of_sources(ws).cases().select(
        CASE, "source", "accident_id", "accident_ts", "lat", "lon", "country_flag", "severe"
    )


@query
def lattice_weather(ws):
    return rounded(of_sources(ws).lattice(), *VARIABLES)


@query
def weather_at_place(ws):
    """Weather between the lattice points around each accident, at its hour in UTC."""
    cases = of_sources(ws).cases().withColumn("utc_ts", to_utc(F.col("accident_ts"), readers.utc_offset()))
    found = weather_between(cases, of_sources(ws).lattice())
    return rounded(cases.join(found, "row_id", "left"), *VARIABLES).select(CASE, *VARIABLES)


@query
def cell_variables(ws):
    """Road variables of the cells of all resolutions, merged from the sums of
    two halves of the roads."""
    road = ws.with_cells(ws.road())
    half = F.col("feature_id") % 2 == 0
    sums = [cells.cell_sums(road.where(h), RESOLUTIONS, derived.BRIDGE_TYPE) for h in (half, ~half)]
    return cells.cell_variables(cells.merge_sums(*sums))


ROAD_GROUP = [f.name for f in features.SOURCE_REGISTRY if f.group == "road"]


@query
def road_variables(ws):
    """Road variables of the finest cell around each accident that has roads."""
    return of_sources(ws).joined().select(CASE, "road_res", *ROAD_GROUP)


SOURCE_NAMES = [f.name for f in features.SOURCE_REGISTRY]
FROM_WEATHER = [*VARIABLES, "rain_x_curves", "temp_x_curvature"]


@query
def source_features(ws):
    """All candidate features on the source path."""
    return rounded(of_sources(ws).joined(), *FROM_WEATHER).select(CASE, "part", "severe", *SOURCE_NAMES)


@query
def source_split_audit(ws):
    return split.split_audit(of_sources(ws).joined(), CASE)


@query
def source_vif_trace(ws):
    return of_sources(ws).vif_trace


@query
def source_compare_models(ws):
    """The six models, trained on the source path, on its test rows."""
    src = of_sources(ws)
    return metrics.compare_models(src.long_scores("test"), src.thresholds())


def _source_results(ws: Workspace) -> str:
    src = of_sources(ws)
    return src.stored_folder("results", lambda path: artifacts.store_source_results(src, path))


@query
def score_accidents(ws):
    """Raw accidents of both sources scored from the store and the weather."""
    src = of_sources(ws)
    reports = readers.accepted(src.audited()).drop("row_id")
    weather = readers.read_lattice_weather(ws.spark, src.lattice_path())
    return artifacts.score_accidents(ws.spark, _source_results(ws), reports, weather)


@query
def score_accidents_one_flag(ws):
    """The way of a raw accident with the rush hour as the only feature: features,
    preparation, a base model, the stack of it, and the class at the tuned cut."""
    return _scored_one_flag(of_sources(ws).joined(), CASE)


# Cleaning and exploration


@query
def outlier_bounds(ws):
    return clean.outlier_bounds(ws.joined(), OUTLIER_COLUMNS)


@query
def outlier_bounds_sketch(ws):
    """Sketches per part of the split, stored and merged: are the quartiles behind
    the fences within 0.1% of their ranks?"""
    rows = ws.joined()
    parts = ws.table("sketches", lambda: fences.column_sketches(rows, OUTLIER_COLUMNS, ["part"]))
    quartiles = fences.sketched_quartiles(fences.merge_sketches(parts))
    errors = fences.rank_errors(rows, quartiles)
    near = {c: (F.col(c) <= 0.001).cast("int") for c in ("q1_error", "q3_error")}
    return errors.withColumns(near).withColumnsRenamed({"q1_error": "q1_near", "q3_error": "q3_near"})


@query
def remove_outliers(ws):
    bounds = clean.outlier_bounds(ws.joined(), OUTLIER_COLUMNS)
    return clean.remove_outliers(ws.joined(), bounds).select(KEY, *OUTLIER_COLUMNS)


@query
def binarise_severity(ws):
    sources = readers.ACCIDENT_SOURCES.values()
    severe, light = ([c for s in sources for c in getattr(s, k)] for k in ("severe_codes", "light_codes"))
    return clean.binarise_severity(ws.consolidated(), severe, light).select(KEY, "severity", "severe")


@query
def drop_leaky(ws):
    kept = clean.drop_leaky(ws.with_cells(ws.accidents()))
    return kept.drop("h", "score", "row_id")


@query
def class_balance(ws):
    return clean.class_balance(ws.accidents())


@query
def row_funnel(ws):
    return clean.row_funnel(ws.joined(), ws.base(), ws.base())


@query
def select_features(ws):
    names = ["precip", "bridge_len", "n_hospitals", "month", "rain_x_curves", "country_flag"]
    return features.select_features(ws.joined(), names, KEY)


@query
def profile(ws):
    table = clean.profile(ws.joined(), ["temp_c", "precip", "bridge_len", "mean_speed"])
    return rounded(table, "mean", "deviation", "q1", "median", "q3")


@query
def severity_rate_by(ws):
    df = ws.accidents()
    ts = F.col("accident_ts")
    factors = {
        "hour": temporal.hour_of_day(ts),
        "weekday": temporal.day_of_week(ts),
        "month": temporal.month(ts),
        "rush_hour": F.col("rush_hour"),
        "road_type": F.col("road_type"),
        "country": F.col("country_flag"),
    }
    return clean.severity_rates(df, factors)


@query
def rush_hour_severity(ws):
    """Which accidents are severe more often: those in rush hours or the others?"""
    return clean.severity_rate_by(ws.accidents(), F.col("rush_hour"), "rush_hour").orderBy("level")


@query
def histogram(ws):
    return clean.histogram(ws.accidents(), "precip", 0.0, 200.0, 20)


# Features


@query
def hour_of_day(ws):
    return ws.accidents().select(KEY, temporal.hour_of_day(F.col("accident_ts")).alias("hour"))


@query
def day_of_week(ws):
    return ws.accidents().select(KEY, temporal.day_of_week(F.col("accident_ts")).alias("weekday"))


@query
def month(ws):
    return ws.accidents().select(KEY, temporal.month(F.col("accident_ts")).alias("month"))


@query
def rush_hour(ws):
    return ws.accidents().select(KEY, temporal.rush_hour(F.col("accident_ts")).alias("rush"))


@query
def rain_x_curves(ws):
    value = interactions.rain_x_curves(F.col("precip"), F.col("n_curves"))
    return ws.accidents().select(KEY, value.alias("value"))


@query
def temp_x_curvature(ws):
    df = integrate.attach_weather(ws.accidents(), ws.weather(), spread_by="row_id")
    bend = interactions.curvature(F.col("n_curves"), F.col("road_len"))
    return df.select(KEY, interactions.temp_x_curvature(F.col("temp_c"), bend).alias("value"))


@query
def speed_x_lanes(ws):
    value = interactions.speed_x_lanes(F.col("mean_speed"), F.col("lanes"))
    return ws.accidents().select(KEY, value.alias("value"))


@query
def climate_features(ws):
    names = [f.name for f in features.REGISTRY if f.group == "climate"]
    return ws.joined().select(KEY, *names)


@query
def road_group_features(ws):
    names = [f.name for f in features.REGISTRY if f.group == "road"]
    return ws.joined().select(KEY, *names)


@query
def one_hot(ws):
    df = features.one_hot(ws.accidents(), "road_type", derived.ACCIDENT_ROADS, "is_")
    return df.select(KEY, *[f"is_{r}" for r in derived.ACCIDENT_ROADS], "is_other")


SCALED = [f.name for f in features.REGISTRY if f.scaled]


@query
def fit_scaler(ws):
    train = ws.joined().where(F.col("part") == "train")
    return rounded(features.fit_scaler(train, SCALED), "mean", "deviation")


@query
def apply_scaler(ws):
    rows = ws.joined()
    stats = features.fit_scaler(rows.where(F.col("part") == "train"), SCALED)
    return rounded(features.apply_scaler(rows, stats), *SCALED).select(KEY, "part", *SCALED)


# Collinearity


@query
def corr_matrix(ws):
    cols = ["precip", "bridge_len", "n_curves", "mean_speed", "lanes", "speed_x_lanes"]
    return rounded(collinear.corr_matrix(ws.accidents(), cols), "correlation")


@query
def vif(ws):
    cols = ["mean_speed", "lanes", "speed_x_lanes"]
    return rounded(collinear.vif(ws.accidents(), cols), "vif")


@query
def vif_stepwise(ws):
    """Three columns, for which the inflation has a closed form."""
    cols = ["mean_speed", "lanes", "speed_x_lanes"]
    return rounded(collinear.vif_stepwise(ws.accidents(), cols), "vif")


@query
def vif_trace(ws):
    """All candidate features, on the training rows."""
    return ws.vif_trace


@query
def interaction_verdict(ws):
    return collinear.interaction_verdict(ws.vif_trace, features.INTERACTIONS)


# The interactions with SQL, each next to its own factors.
INTERACTION_TRIPLES = (
    ("mean_speed", "lanes", "speed_x_lanes"),
    ("precip", "n_curves", "rain_x_curves"),
)


@query
def interaction_verdict_three(ws):
    """Two interactions, each against its factors alone, in closed form."""
    traces = [collinear.vif_stepwise(ws.accidents(), cols) for cols in INTERACTION_TRIPLES]
    verdicts = [collinear.interaction_verdict(t, features.INTERACTIONS) for t in traces]
    return rounded(verdicts[0].unionByName(verdicts[1]), "vif")


# Split


@query
def split3(ws):
    return split.split3(ws.accidents(), KEY).select(KEY, "part")


@query
def split_audit(ws):
    return split.split_audit(split.split3(ws.accidents(), KEY), KEY)


# Models


@query
def fit_logistic(ws):
    """Coefficient of each feature."""
    fitted = ws.model("logistic").stages[-1]
    names = ["(intercept)", *ws.feature_names]
    values = [fitted.intercept, *fitted.coefficients.toArray()]
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return ws.spark.createDataFrame(rows, "feature string, coefficient double")


def _one_flag(ws: Workspace, flag: str = "rush_hour") -> DataFrame:
    """All accidents with the rush hour as the only feature. With a single 0/1
    feature every model below has a closed form."""
    return VectorAssembler(inputCols=[flag], outputCol="features").transform(ws.accidents())


def _logistic_table(ws: Workspace, flag: str) -> DataFrame:
    fitted = classifiers.fit_logistic(_one_flag(ws, flag), tolerance=1e-12).stages[-1]
    return ws.spark.createDataFrame(
        [("(intercept)", fitted.intercept), (flag, float(fitted.coefficients[0]))],
        "feature string, coefficient double",
    )


def _score_per_flag(ws: Workspace, model, digits: int = 6) -> DataFrame:
    scored = classifiers.add_score(_one_flag(ws), model, "p")
    levels = scored.groupBy("rush_hour").agg(
        F.count("*").alias("n_rows"), F.min("p").alias("lowest"), F.max("p").alias("highest")
    )
    return rounded(levels, "lowest", "highest", digits=digits)


@query
def fit_logistic_one_flag(ws):
    """The coefficients are log odds."""
    return rounded(_logistic_table(ws, "rush_hour"), "coefficient", digits=4)


@query
def wald_one_flag(ws):
    """Coefficients of one flag with their standard errors, which have a closed form."""
    tests = inference.wald_tests(_one_flag(ws), ["rush_hour"])
    return rounded(tests.select("feature", "coefficient", "std_error"), "coefficient", "std_error", digits=4)


@query
def wald_tests(ws):
    """Each feature beside all others: coefficient, error, z and p value."""
    return inference.wald_tests(ws.train, ws.feature_names)


@query
def fit_forest_one_flag(ws):
    """One tree over all rows scores the weighted severe share of each level."""
    model = classifiers.fit_forest(_one_flag(ws), sample=1.0, trees=1, depth=1, bootstrap=False)
    return _score_per_flag(ws, model)


@query
def fit_boosted_one_flag(ws):
    """One round scores the mean of the labels -1 and 1, through the logistic curve."""
    model = classifiers.fit_boosted(_one_flag(ws), trees=1, depth=1, balanced=False)
    return _score_per_flag(ws, model)


@query
def fit_mlp_one_flag(ws):
    """Without hidden layer the network's optimum is the severe share of each level."""
    model = classifiers.fit_mlp(_one_flag(ws), 1, KEY, hidden=(), balanced=False)
    return _score_per_flag(ws, model, 2)


@query
def base_scores_one_flag(ws):
    """Three fitted models side by side."""
    rows = _one_flag(ws)
    models = {
        "logistic": classifiers.fit_logistic(rows, tolerance=1e-12),
        "forest": classifiers.fit_forest(rows, sample=1.0, trees=1, depth=1, bootstrap=False),
        "boosted": classifiers.fit_boosted(rows, trees=1, depth=1, balanced=False),
    }
    scored = classifiers.base_scores(models, rows).select(KEY, "severe", *models)
    return rounded(scored, *models, digits=4)


@query
def score_one_flag(ws):
    """The whole way of a new row on one flag: preparation, a base model, the
    stack of it, and the class at the cut tuned on the meta holdout."""
    return _scored_one_flag(split.split3(ws.accidents(), KEY), KEY)


def _scored_one_flag(rows: DataFrame, key: str) -> DataFrame:
    train, meta = (rows.where(F.col("part") == p) for p in ("train", "meta"))
    cols, keep = ["rush_hour"], [key, "severe"]
    preparation = prepare.fit_preparation(train, cols, [])
    vectors = prepare.prepare(preparation, train, cols, keep)
    models = {"logistic": classifiers.fit_logistic(vectors, tolerance=1e-12)}
    unseen = classifiers.base_scores(models, prepare.prepare(preparation, meta, cols, keep))
    stacked = stack.fit_stack(unseen, list(models), tolerance=1e-12)
    cuts = threshold.tune_all(stack.stack_scores(stacked, unseen), [stack.STACK])
    scored = stack.score(rows, preparation, models, stacked, cuts, cols, [key])
    return rounded(scored, "logistic", stack.STACK, digits=4)


@query
def fit_stack_one_score(ws):
    """A stack of one score with two values: its weight is a slope of log odds."""
    meta = rule_scores(ws).where(F.col("part") == "meta")
    model = stack.fit_stack(meta, ["rule_time"], tolerance=1e-12)
    return rounded(stack.stack_weights(ws.spark, model, ["rule_time"]), "weight", digits=4)


@query
def fit_lda(ws):
    """Two columns, for which the discriminant has a closed form."""
    model = discriminant.fit_lda(ws.accidents(), ["precip", "bridge_len"])
    table = discriminant.discriminant_table(ws.spark, model).drop("position")
    return rounded(table, "coefficient")


@query
def lda_scores(ws):
    """P(severe) of every accident by the discriminant of two columns."""
    cols = ["precip", "bridge_len"]
    model = discriminant.fit_lda(ws.accidents(), cols)
    p = model.probability_of({c: F.col(c) for c in cols})
    return rounded(ws.accidents().select(KEY, p.alias("p")), "p")


@query
def fit_lda_all_features(ws):
    return discriminant.discriminant_table(ws.spark, ws.model("lda"))


@query
def fit_forest(ws):
    return explain.tree_importance(ws.spark, ws.model("forest").stages[-1], ws.feature_names)


@query
def fit_boosted(ws):
    return explain.tree_importance(ws.spark, ws.model("boosted").stages[-1], ws.feature_names)


@query
def fit_mlp(ws):
    """A network with a fixed number of iterations: its AUC per part."""
    model = classifiers.fit_mlp(ws.train, len(ws.accepted), KEY)
    unseen = ws.vectors().where(F.col("part") != "train")
    scored = classifiers.add_score(unseen, model, "p")
    return metrics.roc_auc(scored, ["part"])


@query
def fit_mlp_early_stop(ws):
    """Rounds of training with their loss on the validation slice."""
    return ws.spark.createDataFrame(
        ws.early_stop[1], "round int, iterations int, validation_loss double"
    )


@query
def fit_mlp_early_stop_one_flag(ws):
    """Early stopping without a hidden layer, all rows of equal weight: the
    network of the best round scores the severe share of the rows it learns from."""
    rows = _one_flag(ws).select(KEY, "severe", "rush_hour", "features")
    model, _ = classifiers.fit_mlp_early_stop(
        lay_out(rows, KEY).persist(), 1, KEY, hidden=(), step=100, tolerance=1e-7, balanced=False, block_rows=1
    )
    return _score_per_flag(ws, model, 2)


@query
def class_weights(ws):
    train = split.split3(ws.accidents(), KEY).where(F.col("part") == "train")
    return prepare.class_weights(train)


@query
def base_scores(ws):
    return ws.base_scores()


@query
def fit_stack(ws):
    """Stacked probability of every meta and test row."""
    return ws.scores().select(KEY, "part", "severe", stack.STACK)


@query
def stack_weights(ws):
    return stack.stack_weights(ws.spark, ws.stack)


@query
def score(ws):
    """Scores and classes of all rows of the clean base, from its raw columns."""
    return stack.score(
        ws.base(), ws.preparation, ws.models(), ws.stack, ws.thresholds(), ws.feature_names, [KEY]
    )


@query
def risk_hotspots(ws):
    """Cells and hours with the highest mean rule score."""
    df = ws.with_cells(ws.accidents()).withColumn("hour", temporal.hour_of_day(F.col("accident_ts")))
    return hypotheses.risk_hotspots(df, F.col("score"), ["cell_9", "hour"], 25)


@query
def risk_hotspots_stack(ws):
    """Cells and hours with the highest mean stacked probability."""
    return hypotheses.risk_hotspots(ws.scores(), F.col(stack.STACK), ["cell_9", "hour"], 25)


# Thresholds


def tune_rules(ws: Workspace) -> DataFrame:
    return threshold.tune_all(rule_scores(ws).where(F.col("part") == "meta"), RULES)


@query
def threshold_sweep(ws):
    return threshold.threshold_sweep(rules_long(ws))


@query
def best_threshold(ws):
    return threshold.best_threshold(threshold.threshold_sweep(rules_long(ws)))


@query
def tune_all(ws):
    """Cuts of the rule scores, tuned on the meta holdout."""
    return tune_rules(ws)


@query
def tune_models(ws):
    return ws.thresholds()


@query
def apply_threshold(ws):
    scored = rule_scores(ws).select(
        KEY, "severe", F.lit("rule").alias("model"), F.col("rule").alias("p")
    )
    return threshold.apply_threshold(scored, 0.3)


@query
def threshold_gain(ws):
    """Cuts from the meta holdout, F1 on the test rows."""
    return threshold.threshold_gain(rules_long(ws, "test"), tune_rules(ws))


@query
def threshold_gain_models(ws):
    return threshold.threshold_gain(ws.long_scores("test"), ws.thresholds())


# Evaluation


@query
def confusion(ws):
    return metrics.confusion(rules_predicted(ws))


@query
def confusion_models(ws):
    return metrics.confusion(
        threshold.apply_threshold(ws.long_scores("test"), ws.thresholds())
    )


@query
def accuracy(ws):
    return metrics.accuracy(metrics.confusion(rules_predicted(ws))).select("model", "accuracy")


@query
def balanced_accuracy(ws):
    conf = metrics.confusion(rules_predicted(ws))
    return metrics.balanced_accuracy(conf).select("model", "balanced_accuracy")


@query
def prf_severe(ws):
    conf = metrics.confusion(rules_predicted(ws))
    return metrics.prf_severe(conf).select("model", "precision", "recall", "f1")


@query
def matthews(ws):
    conf = metrics.confusion(rules_predicted(ws))
    return rounded(metrics.matthews(conf).select("model", "matthews"), "matthews")


@query
def roc_auc(ws):
    return metrics.roc_auc(rules_long(ws))


@query
def roc_points(ws):
    return metrics.roc_points(rules_long(ws))


@query
def pr_points(ws):
    return metrics.pr_points(rules_long(ws))


@query
def roc_points_models(ws):
    return metrics.roc_points(ws.long_scores("test"))


@query
def pr_points_models(ws):
    return metrics.pr_points(ws.long_scores("test"))


@query
def max_chance(ws):
    return metrics.max_chance(ws.accidents())


@query
def proportional_chance(ws):
    return metrics.proportional_chance(ws.accidents(), metrics.confusion(rules_predicted(ws)))


@query
def chance_models(ws):
    """Do the fitted models pass the chance bar?"""
    predicted = threshold.apply_threshold(ws.long_scores("test"), ws.thresholds())
    test = ws.scores().where(F.col("part") == "test")
    return metrics.proportional_chance(test, metrics.confusion(predicted))


@query
def paired_auc_rules(ws):
    """Do the rule scores differ in AUC on the test rows?"""
    return rounded(_paired_rules(ws), "auc_a", "auc_b", "difference", "std_error", "z", digits=7)


def _paired_rules(ws: Workspace) -> DataFrame:
    test = rule_scores(ws).where(F.col("part") == "test")
    return paired_auc.paired_auc(test, RULES, KEY)


@query
def paired_auc_models(ws):
    test = ws.scores().where(F.col("part") == "test")
    return paired_auc.paired_auc(test, stack.ALL_MODELS, KEY)


def _compare_rules(ws: Workspace, part: str) -> DataFrame:
    cuts = threshold.tune_all(rule_scores(ws).where(F.col("part") == "meta"), RULES)
    return metrics.compare_models(rules_long(ws, part), cuts)


@query
def compare_rules(ws):
    """Rule scores on the test rows, with cuts from the meta holdout."""
    return _compare_rules(ws, "test")


@query
def compare_models(ws):
    """The six models on the test rows, with cuts from the meta holdout."""
    return metrics.compare_models(ws.long_scores("test"), ws.thresholds())


@query
def overfit_gap(ws):
    return metrics.overfit_gap(_compare_rules(ws, "meta"), _compare_rules(ws, "test"))


@query
def overfit_gap_models(ws):
    cuts = ws.thresholds()
    return metrics.overfit_gap(
        metrics.compare_models(ws.long_scores("meta"), cuts),
        metrics.compare_models(ws.long_scores("test"), cuts),
    )


# Explanation


@query
def tree_importance(ws):
    return explain.tree_importance(ws.spark, ws.model("boosted").stages[-1], ws.feature_names)


# Two 0/1 features, named like the columns they are made of.
TWO_FLAGS = {"bridge_len": 200.0, "precip": 50.0}


@query
def tree_importance_two_flags(ws):
    """One boosted tree of depth 2: the variance that each flag removes."""
    flags = [(F.col(c) >= F.lit(least)).cast("int").alias(c) for c, least in TWO_FLAGS.items()]
    rows = ws.accidents().select("severe", *flags)
    rows = VectorAssembler(inputCols=list(TWO_FLAGS), outputCol="features").transform(rows)
    model = classifiers.fit_boosted(rows, trees=1, depth=2, balanced=False)
    return rounded(explain.tree_importance(ws.spark, model.stages[-1], list(TWO_FLAGS)), "importance")


@query
def group_importance_two_flags(ws):
    registry = features.registry_table(ws.spark, list(TWO_FLAGS))
    return explain.group_importance(tree_importance_two_flags(ws), registry)


@query
def group_importance(ws):
    return explain.group_importance(tree_importance(ws), ws.registry())


PERMUTED = ["bridge_len", "rush_hour", "precip", "country_flag"]


@query
def permutation_importance(ws):
    """AUC lost by the planted score when one of its columns is shuffled."""

    def rule(df: DataFrame) -> DataFrame:
        planted = derived.planted_score(
            F.col("bridge_len"), F.col("rush_hour"), F.col("precip"), F.col("road_type"),
            F.col("country_flag"),
        )
        return df.withColumn("p", planted.cast("double"))

    df = ws.accidents().select(KEY, "road_type", "severe", *PERMUTED)
    return explain.permutation_importance(df, PERMUTED, rule, KEY)


@query
def permutation_importance_boosted(ws):
    """AUC lost by the boosted trees when a feature is shuffled."""
    model = ws.model("boosted")
    cols = ws.feature_names

    def boosted(df: DataFrame) -> DataFrame:
        vectors = prepare.prepare(ws.preparation, df, cols, ["feature", "severe"])
        return classifiers.add_score(vectors, model, "p")

    test = ws.base().where(F.col("part") == "test").select("row_id", "severe", *cols)
    return explain.permutation_importance(
        prepare.as_doubles(test, cols), cols, boosted, "row_id"
    )


PLANTED_WEIGHTS = {"bridge_len": 2.0, "rush_hour": 200.0, "precip": 4.0, "country_flag": 60.0}


@query
def linear_shap(ws):
    shap = explain.linear_shap(ws.accidents(), PLANTED_WEIGHTS, KEY)
    return rounded(shap, *PLANTED_WEIGHTS)


@query
def shap_summary(ws):
    shap = explain.linear_shap(ws.accidents(), PLANTED_WEIGHTS, KEY)
    return rounded(explain.shap_summary(shap, list(PLANTED_WEIGHTS), KEY), "mean_abs")


@query
def shap_summary_logistic(ws):
    """Mean absolute contribution of each feature to the logistic model's log odds."""
    names = ws.feature_names
    entries = vector_to_array(F.col("features"))
    test = ws.vectors().where(F.col("part") == "test")
    columns = test.select(KEY, *[entries[i].alias(n) for i, n in enumerate(names)])
    weights = ws.model("logistic").stages[-1].coefficients.toArray()
    shap = explain.linear_shap(columns, {n: float(w) for n, w in zip(names, weights)}, KEY)
    return explain.shap_summary(shap, names, KEY)


@query
def effect_direction(ws):
    df = features.one_hot(ws.accidents(), "road_type", derived.ACCIDENT_ROADS, "road_")
    flags = ["rush_hour", "country_flag", *[f"road_{r}" for r in derived.ACCIDENT_ROADS]]
    return explain.effect_direction(df, flags)


@query
def effect_direction_models(ws):
    """Direction of each 0/1 feature in the data and in the logistic model."""
    weights = ws.model("logistic").stages[-1].coefficients.toArray()
    coefficients = {n: float(w) for n, w in zip(ws.feature_names, weights)}
    flags = [f.name for f in ws.accepted if not f.scaled]
    return explain.effect_direction(ws.base(), flags, coefficients)


def _planted_rule(df: DataFrame) -> DataFrame:
    planted = derived.planted_score(
        F.col("bridge_len"), F.col("rush_hour"), F.col("precip"), F.col("road_type"), F.col("country_flag")
    )
    return df.withColumn("p", planted.cast("double"))


@query
def accumulated_effects(ws):
    """How the planted score moves along two of its columns."""
    keep = ["rush_hour", "road_type", "country_flag"]
    found = explain.accumulated_effects(ws.accidents(), ["bridge_len", "precip"], _planted_rule, 5, keep)
    return rounded(found, "low", "high", "effect", "ale")


def _model_score(ws: Workspace, name: str):
    """Scores rows by a fitted model; columns other than the vector stay."""
    model, cols = ws.model(name), ws.feature_names

    def score(df: DataFrame) -> DataFrame:
        names = df.columns
        vectors = ws.preparation.transform(prepare.as_doubles(df, cols))
        return classifiers.add_score(vectors, model, "p").select(*names, "p")

    return score


@query
def accumulated_effects_boosted(ws):
    """Direction of the boosted trees along their most important numeric features."""
    scaled = [f.name for f in ws.accepted if f.scaled]
    ranked = explain.tree_importance(ws.spark, ws.model("boosted").stages[-1], ws.feature_names)
    top = [r["feature"] for r in ranked.orderBy("importance_rank").collect() if r["feature"] in scaled][:4]
    test = prepare.as_doubles(ws.base().where(F.col("part") == "test"), ws.feature_names)
    return explain.accumulated_effects(test, top, _model_score(ws, "boosted"), 10, ws.feature_names)


@query
def accumulated_effects_mlp(ws):
    """Direction of the network along weather and road length."""
    names = [f.name for f in ws.accepted if f.name in ("precip", "temp_c", "bridge_len")]
    test = prepare.as_doubles(ws.base().where(F.col("part") == "test"), ws.feature_names)
    return explain.accumulated_effects(test, names, _model_score(ws, "mlp"), 10, ws.feature_names)


@query
def project_2d(ws):
    cols = [f.name for f in ws.accepted if f.scaled]
    stats = features.fit_scaler(ws.train_rows(), cols)
    return explain.project_2d(features.apply_scaler(ws.base(), stats), cols, [KEY, "severe"])


@query
def project_2d_two_columns(ws):
    """Two scaled columns, whose components are their sum and difference; a
    component has no sign of its own."""
    cols = ["bridge_len", "road_len"]
    scaled = features.apply_scaler(ws.accidents(), features.fit_scaler(ws.accidents(), cols))
    points = explain.project_2d(scaled, cols, [KEY])
    return rounded(points.withColumns({c: F.abs(F.col(c)) for c in ("x", "y")}), "x", "y", digits=5)


# Hypotheses


@query
def hyp_road_over_climate_two_flags(ws):
    return hypotheses.road_over_climate(group_importance_two_flags(ws))


@query
def hyp_interactions_three(ws):
    return hypotheses.interactions_pass(interaction_verdict_three(ws))


@query
def hyp_country_one_flag(ws):
    tests = inference.wald_tests(_one_flag(ws, "country_flag"), ["country_flag"])
    return rounded(hypotheses.country_effect(tests), "left_value", digits=4)


def _cast_rules(ws: Workspace) -> DataFrame:
    """The rule scores in the parts of a tree model, a linear one and the stack."""
    parts = {"rule": "boosted", "rule_rain": "logistic", "rule_time": stack.STACK}
    compared = ws.table("compared_rules", lambda: compare_rules(ws))
    return compared.replace(parts, subset=["model"])


def _cast_pairs(ws: Workspace) -> DataFrame:
    parts = {"rule": "boosted", "rule_rain": "logistic", "rule_time": stack.STACK}
    pairs = ws.table("paired_rules", lambda: _paired_rules(ws))
    return pairs.replace(parts, subset=["model_a", "model_b"])


@query
def hyp_nonlinear_rules(ws):
    return hypotheses.nonlinear_over_linear(_cast_rules(ws), _cast_pairs(ws))


@query
def hyp_stack_rules(ws):
    return hypotheses.stack_over_best(_cast_rules(ws), _cast_pairs(ws))


@query
def hypothesis_report_rules(ws):
    """The five verdicts from tables that have SQL."""
    return hypotheses.report(
        hyp_road_over_climate_two_flags(ws), hyp_interactions_three(ws), hyp_country_one_flag(ws),
        hyp_nonlinear_rules(ws), hyp_stack_rules(ws),
    )


@query
def hyp_road_over_climate(ws):
    return hypotheses.road_over_climate(group_importance(ws))


@query
def hyp_interactions(ws):
    return hypotheses.interactions_pass(interaction_verdict(ws))


@query
def hyp_country(ws):
    return hypotheses.country_rates(ws.accidents())


@query
def hyp_country_control(ws):
    return hypotheses.country_controls(ws.accidents(), fit_logistic(ws))


@query
def hyp_country_wald(ws):
    """The country flag beside all other features."""
    return hypotheses.country_effect(wald_tests(ws))


def _pairs(ws: Workspace) -> DataFrame:
    return ws.table("paired", lambda: paired_auc_models(ws))


@query
def hyp_nonlinear(ws):
    return hypotheses.nonlinear_over_linear(compare_models(ws), _pairs(ws))


@query
def hyp_stack(ws):
    return hypotheses.stack_over_best(compare_models(ws), _pairs(ws))


@query
def hypothesis_report(ws):
    compared = ws.table("compared", lambda: compare_models(ws))
    return hypotheses.report(
        hypotheses.road_over_climate(group_importance(ws)),
        hypotheses.interactions_pass(interaction_verdict(ws)),
        hypotheses.country_effect(wald_tests(ws)),
        hypotheses.nonlinear_over_linear(compared, _pairs(ws)),
        hypotheses.stack_over_best(compared, _pairs(ws)),
    )
