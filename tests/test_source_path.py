"""Weather at a place, road variables by cell, rejected rows, two-part keys, and
scoring of raw accidents."""

import datetime as dt

import pytest
from conftest import MEDIUM
from pyspark.sql import functions as F

from crashgrade.operators import cells, integrate, split
from crashgrade.operators.weather import VARIABLES, lattice_keys, to_utc, weather_at_place
from crashgrade.plans import artifacts
from crashgrade.plans.source_path import CASE, case_features, labelled, source_workspace
from crashgrade.plans.workspace import lay_out
from crashgrade.sources import derived, readers

NOON = dt.datetime(2024, 1, 1, 12)
PLACE = "row_id long, lat double, lon double, utc_ts timestamp_ntz"


def lattice(spark, points, hour=NOON):
    rows = [(hour, lat, lon, v, v - 1, v / 2, v * 2) for lat, lon, v in points]
    return lattice_keys(spark.createDataFrame(rows, readers.LATTICE_SCHEMA))


SQUARE = [(0.0, 0.0, 1.0), (0.0, 0.25, 2.0), (0.25, 0.0, 4.0), (0.25, 0.25, 8.0)]


def temps(places, weather):
    return {r["row_id"]: r["temp_c"] for r in weather_at_place(places, weather).collect()}


def test_weather_is_bilinear_between_the_corners(spark):
    late = NOON + dt.timedelta(minutes=59)
    rows = [(1, 0.0, 0.0, NOON), (2, 0.125, 0.125, late), (3, 0.0625, 0.1875, NOON), (4, 0.125, 0.125, late + dt.timedelta(minutes=1))]
    got = temps(spark.createDataFrame(rows, PLACE), lattice(spark, SQUARE))
    assert got == pytest.approx({1: 1.0, 2: 15 / 4, 3: (0.75 * 0.25 * 1 + 0.75 * 0.75 * 2 + 0.25 * 0.25 * 4 + 0.25 * 0.75 * 8)})
    whole = weather_at_place(spark.createDataFrame(rows[:1], PLACE), lattice(spark, SQUARE)).first()
    assert [whole[v] for v in VARIABLES] == [1.0, 0.0, 0.5, 2.0]


def test_a_place_on_a_lattice_line_needs_no_corner_beyond_it(spark):
    rows = [(1, 0.0, 0.125, NOON), (2, 0.25, 0.25, NOON)]
    got = temps(spark.createDataFrame(rows, PLACE), lattice(spark, [SQUARE[0], SQUARE[1], SQUARE[3]]))
    assert got == pytest.approx({1: 1.5, 2: 8.0})


def test_missing_corners_leave_their_weight_to_the_others(spark):
    places = spark.createDataFrame([(1, 0.125, 0.125, NOON), (2, None, 0.1, NOON), (3, 0.1, 0.1, None), (4, 50.0, 0.1, NOON)], PLACE)
    assert temps(places, lattice(spark, SQUARE[:3])) == pytest.approx({1: 7 / 3})
    assert temps(places, lattice(spark, [])) == {}
    holes = lattice(spark, SQUARE).withColumn("temp_c", F.when(F.col("step_lon") == 0, F.col("temp_c")))
    assert temps(places, holes) == pytest.approx({1: 2.5})


def test_weather_by_shuffled_join_and_crowded_hour(spark):
    """All places in one hour and square, with the weather joined by salted keys."""
    places = spark.range(3000).select(
        F.col("id").alias("row_id"), F.lit(0.125).alias("lat"), F.lit(0.125).alias("lon"), F.lit(NOON).cast("timestamp_ntz").alias("utc_ts")
    )
    found = weather_at_place(places, lattice(spark, SQUARE), limit=-1)
    assert found.count() == 3000 and found.where("abs(temp_c - 3.75) < 1e-12").count() == 3000


def test_southern_and_western_places_lie_above_their_corner(spark):
    near = [(-0.25, -0.25, 3.0), (0.0, -0.25, 5.0), (-0.25, 0.0, 7.0), (0.0, 0.0, 9.0)]
    places = spark.createDataFrame([(1, -0.25, -0.25, NOON), (2, -0.0625, -0.125, NOON)], PLACE)
    assert temps(places, lattice(spark, near)) == pytest.approx({1: 3.0, 2: (0.25 * 3 + 0.75 * 5 + 0.25 * 7 + 0.75 * 9) / 2})


def test_local_time_goes_to_utc_per_country(spark):
    df = spark.createDataFrame([(0, NOON), (1, NOON)], "country_flag int, t timestamp_ntz")
    got = {r[0]: r[1].hour for r in df.select("country_flag", to_utc(F.col("t"), readers.utc_offset())).collect()}
    assert got == {0: 15, 1: 17}


ROAD = "road_type string, kind string, length_km double, speed int, lanes long, cell_9 long, cell_10 long, cell_11 long"
ROADS = [
    ("ECONOMY", "curve", 2.0, 40, 2, 1, 10, 100),
    ("LARGE", "plain", 6.0, 80, 4, 1, 10, 101),
    ("LARGE", "signal", 4.0, None, None, 1, 11, 110),
    ("SMALL", "school", 7.0, 50, 1, 2, 20, 200),
]


def test_means_are_weighted_by_length_and_sums_merge(spark):
    df = spark.createDataFrame(ROADS, ROAD)
    whole = cells.cell_variables(cells.cell_sums(df, (9, 10, 11), "ECONOMY"))
    got = {(r["res"], r["cell"]): r for r in whole.collect()}
    assert got[9, 1]["mean_speed"] == (2 * 40 + 6 * 80) / 8 and got[9, 1]["lanes"] == (2 * 2 + 6 * 4) / 8
    assert got[9, 1]["dominant"] == "LARGE" and got[9, 1]["road_len"] == 12.0 and got[9, 1]["n_bridges"] == 1
    assert got[11, 110]["mean_speed"] is None and got[11, 110]["n_signals"] == 1
    parts = [cells.cell_sums(spark.createDataFrame([r], ROAD), (9, 10, 11), "ECONOMY") for r in ROADS]
    merged = cells.cell_variables(cells.merge_sums(*parts))
    assert merged.exceptAll(whole).count() == whole.exceptAll(merged).count() == 0


def test_an_empty_cell_falls_back_to_the_coarser_one(spark):
    table = cells.cell_variables(cells.cell_sums(spark.createDataFrame(ROADS, ROAD), (9, 10, 11), "ECONOMY"))
    rows = [(1, 1, 10, 100), (2, 1, 10, 999), (3, 2, 99, 999), (4, 9, 99, 999), (5, None, None, None)]
    places = spark.createDataFrame(rows, "row_id long, cell_9 long, cell_10 long, cell_11 long")
    for limit in (None, -1):
        found = cells.look_up_cells(places, table, (9, 10, 11), limit=limit)
        df = places.join(found, "row_id", "left")
        got = {r["row_id"]: r for r in df.withColumns(cells.road_variables(df, (9, 10, 11))).collect()}
        assert [got[i]["road_res"] for i in range(1, 6)] == [11, 10, 9, None, None]
        assert [got[i]["mean_speed"] for i in range(1, 6)] == [40.0, 70.0, 50.0, None, None]
        assert got[1]["road_len"] == 2.0 and got[2]["road_len"] == pytest.approx(8 / 7)
        assert got[3]["road_len"] == pytest.approx(7 / 49) and got[4]["road_len"] == 0.0 == got[5]["n_curves"]


def test_small_tables_are_looked_up_without_moving_wide_rows(spark, tmp_path):
    """One shuffle, of the narrow rows, and no sort; the same rows as by shuffled joins."""
    places = {"lat": [-23.5, -23.25, -23.4, 39.5, 60.0, None], "lon": [-46.6, -46.5, -46.75, -46.5, -46.5, -46.5]}
    points = list(zip(places["lat"], places["lon"], strict=True))
    rows = [
        (k, k, *points[k % 6], None if k % 11 == 5 else NOON + dt.timedelta(minutes=17 * (k % 9)), ("GRAVE", "LEVE")[k % 2], "br", 0)
        for k in range(66)
    ]
    schema = "row_id long, accident_id long, lat double, lon double, accident_ts timestamp_ntz, severity string, source string, country_flag int"
    steps = [(i / 4 - 24.0, j / 4 - 47.0) for i in range(4) for j in range(4)]
    weather = [(NOON + dt.timedelta(hours=h), a, o, a + h, o, 2.0, h + 0.5) for h in (3, 4, 5) for a, o in steps if (h + int(4 * a)) % 5]
    roads = [(("LARGE", "ECONOMY")[k % 2], "curve", 1.0 + k, 30 + k, 2, *points[k % 4]) for k in range(9)]
    road = spark.createDataFrame(roads, "road_type string, kind string, length_km double, speed int, lanes long, lat double, lon double")
    road = integrate.with_cells(road, derived.BASE_EDGE_M, derived.STANDARD_LATS)
    tables = {
        "cases": spark.createDataFrame(rows, schema),
        "lattice": lattice_keys(spark.createDataFrame(weather, readers.LATTICE_SCHEMA)),
        "cells": cells.cell_variables(cells.cell_sums(road, (9, 10, 11), "ECONOMY")),
    }
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}")
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    found = {}
    for limit in (before, "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            df = case_features(labelled(read("cases")), read("cells"), read("lattice"))
            plan = df._jdf.queryExecution().executedPlan().toString()
            found[limit] = df.columns, sorted(map(repr, df.collect()))
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        if limit == before:
            assert plan.count("Exchange hashpartitioning") == 1 and "Sort" not in plan
    assert found[before] == found["-1"] and len(found[before][1]) == 66
    assert any("temp_c=None" in r for r in found["-1"][1]) and any("road_res=11" in r for r in found["-1"][1])


def test_every_row_of_a_file_is_accepted_or_rejected(spark, tmp_path):
    good = "1;2024-01-01 10:00:00;-23.5;-46.5;GRAVE"
    lines = [
        good, good.replace("1;", "2;", 1).replace("GRAVE", "LEVE"), "3;2024-01-01 10:00:00;-23.5", "4;yesterday;-23.5;-46.5;GRAVE",
        "x;2024-01-01 10:00:00;-23.5;-46.5;GRAVE", ";2024-01-01 10:00:00;-23.5;-46.5;GRAVE", "6;;-23.5;-46.5;GRAVE",
        "7;2024-01-01 10:00:00;;-46.5;GRAVE", "8;2024-01-01 10:00:00;-23.5;200.5;GRAVE", "9;2024-01-01 10:00:00;-23.5;-46.5;IGNORADO",
        "10;2024-01-01 10:00:00;-23.5;-46.5;",
    ]
    path = tmp_path / "br.csv"
    path.write_text("\n".join(lines))
    audited = readers.read_accidents_audited(spark, str(path), "br", "csv", sep=";", timestampNTZFormat="yyyy-MM-dd HH:mm:ss").cache()
    counts = {r["outcome"]: r["n_rows"] for r in readers.audit_counts(audited).collect()}
    assert counts == {
        "accepted": 2, "short_line": 1, "bad_value": 2, "no_id": 1, "no_time": 1, "no_place": 2, "unknown_severity": 2,
    }
    assert sum(counts.values()) == len(lines) == readers.accepted(audited).count() + readers.rejects(audited).count()
    assert readers.rejects(audited).where("reject = 'short_line'").first()["raw"] == lines[2]
    assert sorted(readers.accepted(audited).columns) == sorted(
        ["accident_id", "accident_ts", "lat", "lon", "severity", "country_flag", "source"]
    )


def test_equal_ids_of_two_sources_stay_two_accidents(spark):
    schema = "source string, accident_id long, severity string"
    rows = [("br", 7, "GRAVE"), ("us", 7, "1"), ("us", 8, "3"), ("br", 8, "9")]
    cases = labelled(spark.createDataFrame(rows, schema))
    assert {(r[CASE], r["severe"]) for r in cases.collect()} == {("br-7", 1), ("us-7", 0), ("us-8", 1), ("br-8", None)}
    many = spark.range(400).selectExpr("explode(array('br', 'us')) AS source", "id AS accident_id", "'GRAVE' AS severity")
    parts = split.split3(labelled(many), CASE)
    audit = split.split_audit(parts, CASE).collect()
    assert sum(r["n_keys"] for r in audit) == 800 and sum(r["torn_keys"] for r in audit) == 0
    both = parts.groupBy("accident_id").agg(F.count_distinct("part").alias("n"))
    assert both.where("n = 2").count() > 50
    assert lay_out(parts.select(CASE), CASE).distinct().count() == 800


@pytest.fixture(scope="module")
def src(spark, ws):
    return source_workspace(spark, MEDIUM)


def test_no_model_input_comes_from_the_planted_table(src):
    planted = {"zone_id", "grid_id", "h", "score", "obs_ts", "lat", "lon", "accident_ts", "accident_id", CASE}
    assert not planted & set(src.feature_names)
    plan = src.joined()._jdf.queryExecution().toString()
    assert "zone_id" not in plan and "score" not in plan
    assert set(src.sources.accidents().columns) & set(src.cases().columns) <= {"accident_id", "accident_ts", "lat", "lon", "country_flag", "severe", "row_id"}


def test_fallback_and_weather_are_used_on_the_derived_tables(src):
    joined = src.joined()
    found = {r["road_res"]: r["count"] for r in joined.groupBy("road_res").count().collect()}
    assert found[11] > 0 and found[10] > 0
    with_weather = joined.where("precip IS NOT NULL").count()
    assert 0.97 * joined.count() < with_weather <= joined.count() == 10_000


def test_raw_accidents_score_as_in_the_batch(spark, src, tmp_path):
    """In another session, from the store, the reports and the weather alone."""
    folder = str(tmp_path / "store")
    artifacts.store_source_results(src, folder)
    reports, weather = str(tmp_path / "reports"), src.lattice_path()
    readers.accepted(src.audited()).drop("row_id").repartition(3).write.parquet(reports)
    fresh = spark.newSession()
    fresh.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    got = artifacts.score_accidents(
        fresh, folder, fresh.read.parquet(reports), readers.read_lattice_weather(fresh, weather), [CASE, "rush_hour"]
    )
    path = str(tmp_path / "scored")
    got.write.parquet(path)
    scored = spark.read.parquet(path)
    unseen = src.scores().select(CASE, F.col("stack").alias("before"))
    both = scored.join(unseen, CASE)
    gap = both.agg(F.count("*"), F.max(F.abs(F.col("stack") - F.col("before")))).first()
    assert scored.count() == src.cases().count()
    assert gap[0] == unseen.count() and gap[1] == 0
    broken = str(tmp_path / "broken")
    spark.createDataFrame([('{"resolutions": [5]}',)], "layout string").write.json(f"{broken}/layout")
    with pytest.raises(ValueError):
        artifacts.accident_features(spark, broken, fresh.read.parquet(reports), fresh.read.parquet(weather))
