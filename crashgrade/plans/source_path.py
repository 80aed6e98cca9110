"""From the sources to the models: accidents as their sources report them, with
weather at their place, road variables by map cell, and their own label.

Nothing here reads the planted table of accidents: an accident's key is its
source and id, its label comes from the source's codes, its weather from the
lattice, and its road variables from the cells.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crashgrade.functions.hexgrid import RESOLUTIONS
from crashgrade.operators import cells, clean, features, integrate, split
from crashgrade.operators.joins import is_small
from crashgrade.operators.weather import add_weather, lattice_keys, to_utc, weather_at_place
from crashgrade.plans.workspace import Workspace, opened, workspace
from crashgrade.sources import derived, readers

CASE = "case_id"


def labelled(accidents: DataFrame) -> DataFrame:
    """Accidents of any sources (the common columns and `source`) with their key
    and label. The key joins source and id, so equal ids of two sources are two
    accidents. Codes that no source lists have no label."""
    specs = readers.ACCIDENT_SOURCES.values()
    severe, light = ([c for s in specs for c in getattr(s, k)] for k in ("severe_codes", "light_codes"))
    key = F.concat_ws("-", "source", F.col("accident_id").cast("string"))
    return clean.binarise_severity(accidents.withColumn(CASE, key), severe, light)


def case_features(cases: DataFrame, cell_table: DataFrame, lattice: DataFrame) -> DataFrame:
    """All candidate features of accidents with a place, a local time and a
    country, from the tables of cells and of lattice weather alone. `row_id`
    must be unique and stored, as rows are looked up by it.

    Where both tables are under the broadcast limit, the narrow rows are dealt
    evenly once, and then looked up in place. Larger tables are looked up in two
    narrow joins, which are joined to the wide rows by `row_id`."""
    small = is_small(cell_table) and is_small(lattice)
    # Of few large files, few tasks would read all rows.
    cases = cases.repartition("row_id") if small else cases
    places = integrate.with_cells(cases, derived.BASE_EDGE_M, derived.STANDARD_LATS).withColumn(
        "utc_ts", to_utc(F.col("accident_ts"), readers.utc_offset())
    )
    if small:
        df = cells.add_cells(add_weather(places, lattice), cell_table, RESOLUTIONS)
        df = df.select("row_id", *[c for c in df.columns if c != "row_id"])
    else:
        weather = weather_at_place(places, lattice)
        found = cells.look_up_cells(places, cell_table, RESOLUTIONS)
        df = places.join(weather, "row_id", "left").join(found, "row_id", "left")
    df = df.withColumns(cells.road_variables(df, RESOLUTIONS))
    df = df.withColumns(
        {
            **{n: cells.of_cell(9, n) for n in ("n_hospitals", "n_schools", "n_fuel", "urban")},
            **{f"hex{r}_road_len": cells.of_cell(r, "road_len", 0.0) for r in RESOLUTIONS},
            "hex9_n_curves": cells.of_cell(9, "n_curves"),
            "hex10_bridge_len": cells.of_cell(10, "bridge_len", 0.0),
            "dominant": F.col("at_10.dominant"),
        }
    ).drop("utc_ts", *[f"at_{r}" for r in RESOLUTIONS])
    df = features.interaction_features(features.temporal_features(df))
    return features.one_hot(df, "dominant", derived.ROAD_TYPES, "dominant_")


class SourceWorkspace(Workspace):
    """The analysis on the source path; all that follows `joined` is the same."""

    key = CASE
    registry_list = features.SOURCE_REGISTRY

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder)
        # Only the raw shapes of the sources are taken from there.
        self.sources = workspace(spark, folder)

    def audited(self) -> DataFrame:
        """All rows of the sources, those that are no accidents marked."""

        def build() -> DataFrame:
            br, us = (
                readers.read_accidents_audited(self.spark, self.sources.raw_accidents_path(s), s)
                for s in ("br", "us")
            )
            return integrate.consolidate(br, us).withColumn("row_id", F.monotonically_increasing_id())

        return self.table("audited", build)

    def cases(self) -> DataFrame:
        return labelled(readers.accepted(self.audited()))

    def lattice_path(self) -> str:
        return self.stored("lattice_raw", lambda: derived.lattice_weather(self.sources.accidents()))

    def lattice(self) -> DataFrame:
        """Weather by lattice point and hour, in whole steps."""
        raw = lambda: readers.read_lattice_weather(self.spark, self.lattice_path())
        return self.table("lattice", lambda: lattice_keys(raw()))

    def cell_sums(self) -> DataFrame:
        return self.table(
            "cell_sums",
            lambda: cells.cell_sums(self.with_cells(self.sources.road()), RESOLUTIONS, derived.BRIDGE_TYPE),
        )

    def cell_table(self) -> DataFrame:
        return self.table("cell_table", lambda: cells.cell_variables(self.cell_sums()))

    def joined(self) -> DataFrame:
        def build() -> DataFrame:
            df = case_features(self.cases(), self.cell_table(), self.lattice())
            return split.split3(df.where(F.col("severe").isNotNull()), CASE)

        return self.table("joined", build, by="part")


def source_workspace(spark: SparkSession, folder: str) -> SourceWorkspace:
    return opened(spark, folder, "sources", lambda: SourceWorkspace(spark, folder.rstrip("/")))


