"""From raw documents to packed bins: language, exact copies, near copies, mix,
packing. Each stage reads what the one before has written.

In all stages rows go by themselves: an id that is missing, or that several rows
share, takes no other text along. No rows give no rows, and columns of any name
come through to the last stage, which has its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crashgrade.llm.common import stored, table
from crashgrade.llm.exact_dedup import drop_exact_copies
from crashgrade.llm.language import keep_identified
from crashgrade.llm.mixing import apply_mix
from crashgrade.llm.packing import pack
from crashgrade.llm.shingle_join import drop_near_copies


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised go, and with them null texts and
    texts without a letter. If no row has a language, all stay."""
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, up to white space, the row with the smallest id stays, a
    null id after all others; of rows that repeat the id too, one stays."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked near copies, the row with the smallest id stays; of several such
    rows one. Rows with a null id, or without words, are linked with nothing."""
    return drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target wants it, 3 times at most. A null
    source is a source; rows without words are not taken."""
    return apply_mix(docs)


def bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a row, with its bin; rows without words have none."""
    return pack(docs)


STAGES = [
    ("language", language),
    ("exact", exact),
    ("near", near),
    ("mix", mix),
    ("pack", bins),
]

# The language model has no SQL form, so the rows are tested otherwise.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
