"""Mixing sources to target weights by Sainte-Lague apportionment of blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crashgrade.llm.common import numbered, stored, with_rows, word_count
from crashgrade.operators.joins import join_dimension

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
BLOCK_WORDS = 8
SHARD_WORDS = 250_000
SEED = 20


def _source_key(column: str) -> Column:
    """Never null: null has a key of its own, after all others."""
    return F.when(F.col(column).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(column).cast("string")))


def source_targets(
    sources: DataFrame, weights: Sequence[float], most_repeats: int
) -> DataFrame:
    """Adds `target` to (source_key, source_size): the sources, by code point,
    weigh `weights` in turn and share the sum of all sizes; no target exceeds
    `most_repeats` times its source, and what is cut off is shared again.

    Equal to target = min(cap, rate * weight) with the one rate at which the
    targets add up. Each step reads three sums over the table of sources.
    """
    pattern = F.array(*map(F.lit, weights))
    ranked = stored(
        numbered(sources, [F.col("source_key")], "place").select(
            "source_key",
            "source_size",
            F.element_at(pattern, (F.col("place") % len(weights) + 1).cast("int")).alias("weight"),
            (F.col("source_size") * most_repeats).cast("double").alias("most"),
        ),
        "sources",
    )
    rate, n_capped = 0.0, -1
    while True:
        capped = F.col("weight") * F.lit(rate) > F.col("most")
        got = ranked.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(capped, F.col("most")).otherwise(0.0)).alias("used"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("open"),
            F.count_if(capped).alias("n"),
        ).first()
        if not got["all"] or got["n"] == n_capped or not got["open"]:
            break
        rate, n_capped = (got["all"] - got["used"]) / got["open"], got["n"]
    return ranked.withColumn("target", F.least("most", F.col("weight") * F.lit(rate)))


def apportion(df: DataFrame, part: list[str], key: list[str], weight: str, seats: str) -> DataFrame:
    """Integer quotas `quota` by the highest quotients weight / 1, 3, 5, ...;
    `seats` are to be given in each `part`; `key` breaks ties.

    With m rows and s seats the last quotient that wins lies between
    2 * total / (2 * s + m) and 2 * total / (2 * s - m) (halved), so the seats
    above that range are sure and only about three seats per row have to be
    ranked against each other.
    """
    within = W.partitionBy(*part)
    total, n = F.sum(weight).over(within), F.count("*").over(within)
    sized = df.withColumn("_total", total.cast("double")).withColumn("_n", n)
    low = F.greatest(
        F.lit(0),
        F.floor(F.col(weight) / F.col("_total") * (F.col(seats) - F.col("_n") / 2.0) - 1.5),
    )
    high = F.ceil(F.col(weight) / F.col("_total") * (F.col(seats) + F.col("_n") / 2.0) + 1.5)
    sure = sized.withColumn("_sure", F.when(F.col("_total") > 0, low).otherwise(F.lit(0)).cast("long"))
    open_seats = (
        sure.withColumn("_left", F.col(seats) - F.sum("_sure").over(within))
        .where(F.col(weight) > 0)
        .withColumn("_k", F.explode(F.sequence(F.col("_sure"), high.cast("long"))))
        .withColumn("_quotient", F.col(weight) / (2 * F.col("_k") + 1))
    )
    order = [F.desc("_quotient"), *key]
    won = (
        open_seats.withColumn("_rank", F.row_number().over(within.orderBy(*order)))
        .where(F.col("_rank") <= F.col("_left"))
        .groupBy(*key)
        .agg(F.count("*").alias("_won"))
    )
    return (
        sure.join(won, key, "left")
        .withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0)))
        .drop("_total", "_n", "_sure", "_won")
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    most_repeats: int = MOST_REPEATS,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = SEED,
    row_col: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    The words of a source are laid out in shards (by a seeded hash of id and
    text, about `shard_words` each) and, within a shard, in a seeded order of its
    documents. All words of the mix are cut into blocks of `block_words`;
    the sources get whole blocks by the highest quotients of their targets,
    and each source's shards get theirs in the same way by their sizes. A
    shard's quota is a number of full passes over it and one run of blocks
    from a seeded block on, around the end if need be. So a source's words are
    within a block of its target (but for the cap), nearly all documents are
    taken whole, and none more than `most_repeats` times.

    `copies` is `taken` in whole documents, rounded half up. A null text has
    size 0 and is never taken. A null source is a source, the last one. Rows
    that repeat an id are documents of their own; `row_col` is carried along to
    tell them apart. No rows, or no words at all, give targets of 0. Other columns
    are not read.
    """
    carried = [row_col] if row_col else []
    base = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            _source_key(source_col).alias("source_key"),
            word_count(text_col).alias("size"),
            # By the text too, so that the rows of a repeated or null id are spread.
            F.xxhash64(id_col, text_col, F.lit(seed)).alias("spot"),
            *carried,
        ),
        "sizes",
    )
    sources = base.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, weights, most_repeats)
    n_blocks = F.round(F.sum("source_size").over(W.partitionBy("one")) / block_words)
    # One row per source.
    quotas = apportion(
        targets.withColumn("one", F.lit(1)).withColumn("blocks", n_blocks.cast("long")),
        ["one"],
        ["source_key"],
        "target",
        "blocks",
    ).select(
        "source_key",
        "source_size",
        "target",
        F.col("quota").alias("source_quota"),
        F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long").alias("n_shards"),
    )
    quotas = stored(quotas, "quotas")
    placed = join_dimension(base, quotas, ["source_key"], ["spot"]).withColumn(
        "shard", F.pmod(F.col("spot"), F.col("n_shards"))
    )
    cell = ["source_key", "shard"]
    shards = apportion(
        placed.groupBy(*cell).agg(
            F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota")
        ),
        ["source_key"],
        cell,
        "shard_size",
        "source_quota",
    ).select(*cell, "shard_size", "quota")
    shuffled = W.partitionBy(*cell).orderBy(F.xxhash64("spot", F.lit(seed + 1)), "doc_id", "size", *carried)
    begin = F.sum("size").over(shuffled.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    laid = placed.withColumn("begin", begin).join(shards, cell)
    whole = F.col("shard_size")
    words = F.least(F.col("quota") * block_words, whole * most_repeats)
    laid = (
        laid.withColumn("words", words)
        .withColumn("passes", F.when(whole > 0, F.floor(F.col("words") / whole)).otherwise(F.lit(0)))
        .withColumn("rest", F.col("words") - F.col("passes") * whole)
        .withColumn(
            "run",
            F.lit(block_words)
            * F.pmod(F.xxhash64(*cell, F.lit(seed + 2)), F.greatest(F.lit(1), F.ceil(whole / block_words))),
        )
    )
    end, zero = F.col("begin") + F.col("size"), F.lit(0)
    run_end = F.col("run") + F.col("rest")
    overlap = F.greatest(zero, F.least(end, run_end) - F.greatest("begin", "run")) + F.greatest(
        zero, F.least(end, run_end - whole) - F.col("begin")
    )
    taken = (F.col("passes") * F.col("size") + overlap).cast("long")
    return laid.select(
        "doc_id",
        F.col("size").cast("long").alias("size"),
        F.col("source_size").cast("long").alias("source_size"),
        F.col("target").cast("double").alias("target"),
        taken.alias("taken"),
        F.when(F.col("size") > 0, F.floor(taken / F.col("size") + 0.5)).otherwise(zero).cast("long").alias("copies"),
        *carried,
    )


def apply_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns.

    Each row goes by itself, also where ids repeat or are null. Rows without words
    are never taken. No rows give no rows; columns of any name stay as they
    are."""
    rows, key = with_rows(docs, "mix")
    copies = (
        mix_sources(rows, id_col, text_col, source_col, row_col=key, **options)
        .where(F.col("copies") > 0)
        .select(key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"))
        .select(key)
    )
    return rows.join(copies, key).drop(key)
