import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from crashgrade.functions import hexgrid
from crashgrade.operators import clean, collinear, features, integrate, split
from crashgrade.sources import derived

EDGE = 400.0


def test_every_point_lies_nearest_its_own_cell_centre(spark):
    points = spark.range(2000).select(
        (F.rand(1) * 120 - 60).alias("lat"), (F.rand(2) * 300 - 150).alias("lon")
    )
    q, r = hexgrid.axial(F.col("lat"), F.col("lon"), EDGE, 30.0)
    x, y = hexgrid.project(F.col("lat"), F.col("lon"), 30.0)
    for row in points.select(x.alias("x"), y.alias("y"), q.alias("q"), r.alias("r")).collect():
        def distance(a, b):
            cx = EDGE * math.sqrt(3) * (a + b / 2)
            cy = EDGE * 1.5 * b
            return math.hypot(row["x"] - cx, row["y"] - cy)

        own = distance(row["q"], row["r"])
        around = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)]
        assert own <= EDGE * 1.0000001
        assert all(own <= distance(row["q"] + a, row["r"] + b) + 1e-6 for a, b in around)


def test_cell_ids_are_one_to_one_with_coordinates(spark):
    points = spark.range(5000).select(
        (F.rand(3) * 0.5 - 23.7).alias("lat"), (F.rand(4) * 0.5 - 46.8).alias("lon")
    )
    q, r = hexgrid.axial(F.col("lat"), F.col("lon"), EDGE, -23.5)
    cell = hexgrid.hex_cell(F.col("lat"), F.col("lon"), EDGE, -23.5)
    seen = points.select(q.alias("q"), r.alias("r"), cell.alias("cell"))
    assert seen.distinct().count() == seen.select("cell").distinct().count()
    assert seen.distinct().count() == seen.select("q", "r").distinct().count()


@given(res=st.integers(0, 14))
@settings(max_examples=10)
def test_each_level_has_a_seventh_of_the_area(res):
    assert (hexgrid.edge_length(res) / hexgrid.edge_length(res + 1)) ** 2 == pytest.approx(7)


def test_dominant_type_ties_go_to_the_first_name(spark):
    df = spark.createDataFrame(
        [(1, "b", 2.0), (1, "a", 1.0), (1, "a", 1.0), (2, "c", 5.0)],
        "cell long, road_type string, length_km double",
    )
    got = {r["cell"]: (r["dominant"], r["dominant_km"]) for r in integrate.dominant_type(df, "cell").collect()}
    assert got == {1: ("a", 2.0), 2: ("c", 5.0)}


def test_a_fence_may_remove_every_row(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    bounds = spark.createDataFrame([("x", 5.0, 6.0)], "feature string, lower double, upper double")
    assert clean.remove_outliers(df, bounds).count() == 0


def test_missing_values_are_no_outliers(spark):
    df = spark.createDataFrame([(1.0,), (None,), (50.0,)], "x double")
    bounds = spark.createDataFrame([("x", 0.0, 6.0)], "feature string, lower double, upper double")
    assert [r["x"] for r in clean.remove_outliers(df, bounds).orderBy("x").collect()] == [None, 1.0]


def test_fences_reach_the_scan(ws):
    plan = ws.base().select("accident_id")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(precip" in plan


def test_approximate_fences_are_near_the_exact_ones(ws):
    exact = {r["feature"]: r for r in clean.outlier_bounds(ws.joined(), ["precip"]).collect()}
    near = {r["feature"]: r for r in clean.outlier_bounds(ws.joined(), ["precip"], exact=False).collect()}
    assert near["precip"]["upper"] == pytest.approx(exact["precip"]["upper"], rel=0.02)


def test_constant_column_and_missing_value_scale_to_zero(spark):
    df = spark.createDataFrame([(3.0, 1.0), (3.0, None), (3.0, 3.0)], "c double, x double")
    scaled = features.apply_scaler(df, features.fit_scaler(df, ["c", "x"])).collect()
    assert [r["c"] for r in scaled] == [0.0, 0.0, 0.0]
    assert [r["x"] for r in scaled] == [-1.0, 0.0, 1.0]


def test_scaled_training_columns_have_mean_0_and_deviation_1(ws):
    stats = features.fit_scaler(ws.train_rows(), ["precip", "bridge_len"])
    row = features.apply_scaler(ws.train_rows(), stats).agg(
        F.avg("precip"), F.stddev_pop("precip"), F.avg("bridge_len"), F.stddev_pop("bridge_len")
    ).first()
    assert list(row) == pytest.approx([0, 1, 0, 1], abs=1e-9)


def test_a_level_absent_from_the_list_has_its_own_flag(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,), ("",)], "t string")
    got = features.one_hot(df, "t", ["a", "b"], "t_").select("t_a", "t_b", "t_other").collect()
    assert [tuple(r) for r in got] == [(1, 0, 0), (0, 0, 1), (0, 0, 1), (0, 0, 1)]


def test_cells_keep_their_shape_in_both_countries(spark):
    """A cell spans about as many metres on the ground east as north."""
    lats = (-23.5, 40.0)
    for lat in lats:
        df = spark.createDataFrame([(lat, -80.0)], "lat double, lon double")
        x, y = hexgrid.project(F.col("lat"), F.col("lon"), derived.STANDARD_LATS)
        x2, y2 = hexgrid.project(F.col("lat") + 0.01, F.col("lon") + 0.01, derived.STANDARD_LATS)
        row = df.select((x2 - x).alias("dx"), (y2 - y).alias("dy")).first()
        step = math.radians(0.01) * hexgrid.EARTH_RADIUS_M
        assert row["dx"] == pytest.approx(step * math.cos(math.radians(lat)), rel=0.02)
        assert row["dy"] == pytest.approx(step, rel=0.02)


def test_cells_of_the_two_grids_never_meet(spark):
    points = spark.range(4000).select(
        (F.rand(5) * 2 + hexgrid.BORDER_LAT - 1).alias("lat"), (F.rand(6) * 2 - 80).alias("lon")
    )
    cell = hexgrid.hex_cell(F.col("lat"), F.col("lon"), 40_000.0, derived.STANDARD_LATS)
    sides = points.select(cell.alias("cell"), (F.col("lat") >= hexgrid.BORDER_LAT).alias("north")).distinct()
    assert sides.count() == sides.select("cell").distinct().count() > 4


def test_statistics_per_column_do_not_multiply_the_rows(ws):
    plan = features.fit_scaler(ws.accidents(), ["precip", "bridge_len"])._jdf.queryExecution().toString()
    assert "Expand" not in plan


def test_parts_are_pruned_at_the_scan(ws):
    plan = ws.train_rows()._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(part" in plan


def test_parts_are_stable_disjoint_and_near_their_shares(ws):
    df = ws.accidents()
    parts = split.split3(df, "accident_id")
    again = split.split3(df.repartition(7), "accident_id")
    assert parts.select("accident_id", "part").exceptAll(again.select("accident_id", "part")).count() == 0
    audit = {r["part"]: r for r in split.split_audit(parts, "accident_id").collect()}
    assert {p: a["torn_keys"] for p, a in audit.items()} == {"train": 0, "meta": 0, "test": 0}
    assert [audit[p]["n_rows"] for p in ("train", "meta", "test")] == [5994, 1031, 2975]


def test_audit_finds_a_torn_key_among_copies(spark):
    df = spark.createDataFrame(
        [(1, "train", 1)] * 50 + [(1, "test", 1), (2, "meta", 0)], "k long, part string, severe int"
    )
    torn = {r["part"]: (r["torn_keys"], r["n_rows"]) for r in split.split_audit(df, "k").collect()}
    assert torn == {"train": (1, 50), "test": (1, 1), "meta": (0, 1)}


def test_split_with_an_empty_part(spark):
    df = split.split3(spark.range(50).withColumn("severe", F.lit(0)), "id", train=1000, meta=0)
    assert [r["part"] for r in split.split_audit(df, "id").collect()] == ["train"]


def test_vif_is_one_over_one_minus_r_squared(ws):
    cols = ["precip", "n_curves", "rain_x_curves", "bridge_len"]
    data = ws.accidents().select(*cols).toPandas().astype(float)
    got = {r["feature"]: r["vif"] for r in collinear.vif(ws.accidents(), cols).collect()}
    for c in cols:
        others = np.column_stack([np.ones(len(data)), data[[o for o in cols if o != c]]])
        fit = others @ np.linalg.lstsq(others, data[c], rcond=None)[0]
        r2 = 1 - ((data[c] - fit) ** 2).sum() / ((data[c] - data[c].mean()) ** 2).sum()
        assert got[c] == pytest.approx(1 / (1 - r2), rel=1e-6)


def test_stepwise_on_the_known_columns(ws):
    cols = ["precip", "bridge_len", "n_curves", "mean_speed", "lanes", "speed_x_lanes", "road_len",
            "n_segments", "rain_x_curves"]
    trace = collinear.vif_stepwise(ws.accidents(), cols).collect()
    removed = sorted((r["step"], r["feature"], round(r["vif"], 2)) for r in trace if not r["kept"])
    assert removed == [(1, "speed_x_lanes", 107.81), (2, "n_segments", 19.26)]
    assert max(r["vif"] for r in trace if r["kept"]) <= 10


def test_identical_and_constant_columns(spark):
    df = spark.range(200).select(
        F.col("id").cast("double").alias("a"), F.col("id").cast("double").alias("b"),
        F.lit(4).alias("c"), F.rand(5).alias("d"),
    )
    trace = {r["feature"]: r for r in collinear.vif_stepwise(df, ["a", "b", "c", "d"]).collect()}
    assert trace["c"]["step"] == 0 and not trace["c"]["kept"]
    assert sum(trace[x]["kept"] for x in "ab") == 1 and trace["d"]["kept"]
    assert math.isinf(max(trace[x]["vif"] for x in "ab"))
    assert collinear.vif(df.select("c"), ["c"]).count() == 0


def test_leaky_columns_never_reach_the_models(ws):
    hidden = {"lat", "lon", "accident_ts", "obs_ts", "h", "score", "zone_id", "accident_id"}
    names = set(ws.feature_names)
    assert not names & (hidden | set(clean.LEAKY))
    assert "speed_x_lanes" not in names
    assert {"rain_x_curves", "temp_x_curvature", "country_flag"} <= names


def test_derived_tables_hold_the_known_facts(ws):
    assert ws.accidents().count() == 10_000
    assert ws.accidents().agg(F.sum("severe")).first()[0] == 2074
    assert ws.raw_accidents("br").count() == 4849
    assert ws.raw_accidents("us").count() == 5151
    cells = ws.with_cells(ws.accidents()).agg(
        *[F.countDistinct(f"cell_{r}") for r in (9, 10, 11)]
    ).first()
    assert len(set(cells)) == 3 and cells[0] < cells[1] < cells[2]


def test_cell_statistics_equal_the_single_operators(ws):
    road = ws.with_cells(ws.road())
    single = integrate.infra_by_cell(road, "cell_10", derived.BRIDGE_TYPE)
    got = ws.cell_statistics(10, *[c for c in single.columns if c != "cell_10"])
    assert single.select(sorted(single.columns)).exceptAll(got.select(sorted(got.columns))).count() == 0


def test_lengths_by_type_add_up_to_the_road(spark):
    from crashgrade.operators import integrate

    rows = [("c", "PROMO", 2.0), ("c", "GRAVEL", 5.0), ("c", None, 1.0), ("d", "PROMO", 3.0)]
    df = spark.createDataFrame(rows, "cell string, road_type string, length_km double")
    got = {r["cell"]: r for r in integrate.length_by_type(df, "cell", ["PROMO", "ECONOMY"]).collect()}
    assert tuple(got["c"])[1:] == (2.0, 0.0, 6.0) and tuple(got["d"])[1:] == (3.0, 0.0, 0.0)


def test_unknown_severity_is_null(spark):
    from crashgrade.operators import clean

    df = spark.createDataFrame([("3",), ("1",), ("9",), (None,)], "severity string")
    got = [r["severe"] for r in clean.binarise_severity(df, ["3", "4"], ["1", "2"]).collect()]
    assert got == [1, 0, None, None]
