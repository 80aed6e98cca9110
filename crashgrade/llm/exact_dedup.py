"""Exact duplicates by skew-safe combining, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashgrade.llm.common import normalised, with_rows

SALTS = 16


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Rows are deduplicated within their task and then per (digest, salt), where
    the salt comes from the id; the winners of all salts are combined per
    digest. At both stages the whole text is part of the grouping key, so two
    texts are one group only if they are the same text. Only groups of two or
    more travel back to their rows, by (digest, salt), so that the rows of a
    large group stay spread. The way back goes by SHA-256, a second hash and
    the length; should two different texts ever agree in all three, the query
    ends with an error instead of merging them.

    A null text counts as empty; all empty texts are one group. A null id
    never stays before another id. Rows that repeat the id that stays count as
    that document and stay as well. No rows give no rows. Other columns are
    not read, whatever their names.
    """
    keyed = docs.select(
        F.col(id_col).alias("doc_id"),
        normalised(text_col).alias("content"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(salts)).alias("salt"),
    ).select(
        "*",
        F.unhex(F.sha2("content", 256)).alias("digest"),
        F.xxhash64("content", F.length("content")).alias("second"),
    )
    key = ["digest", "second"]
    local = keyed.groupBy(*key, "salt", "content").agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")
    )
    whole = local.groupBy(*key, "content").agg(
        F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    groups = whole.groupBy(*key).agg(
        F.min("keep_id").alias("keep_id"),
        F.sum("group_size").alias("group_size"),
        F.count("*").alias("n_texts"),
    )
    groups = groups.select(
        *key,
        "keep_id",
        F.when(
            F.col("n_texts") > 1, F.raise_error(F.lit("two texts share all their hashes")).cast("long")
        )
        .otherwise(F.col("group_size"))
        .alias("group_size"),
    ).where(F.col("group_size") > 1)
    spread = groups.withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))
    )
    rows = keyed.select("doc_id", "salt", *key)
    return rows.join(spread, [*key, "salt"], "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(F.col("group_size").isNull(), F.lit(True))
        .otherwise(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns: one of each text.

    Of equal texts (see `exact_groups`) the row with the smallest id stays, a
    null id after all others; of several such rows the first one. A repeated
    id takes no other text along. All empty and null texts are one text. No rows
    give no rows; columns of any name stay as they are."""
    rows, key = _with_places(docs)
    rank = F.struct(F.col(id_col).isNull(), F.col(id_col), F.col(key))
    ranked = rows.select(rank.alias("rank"), F.col(text_col).alias("body"))
    gone = exact_groups(ranked, "rank", "body").where(~F.col("kept")).select(F.col(f"doc_id.{key}").alias(key))
    return rows.join(gone, key, "left_anti").drop(key)


def _with_places(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a key per row, and its name. Rows read straight from
    files are known by their file and place in it, which no rerun changes;
    others are written once and numbered."""
    plan = docs._jdf.queryExecution().analyzed() if hasattr(docs, "_jdf") else None
    key = "_place"
    while key in {c.lower() for c in docs.columns}:
        key += "_"
    if plan is None or plan.nodeName().split(" ")[0] != "LogicalRelation" or "_metadata" in docs.columns:
        return with_rows(docs, "exact")
    place = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
    return docs.withColumn(key, place), key
