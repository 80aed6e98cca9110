"""Conflict-constrained best-fit packing of documents into bins of words."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashgrade.llm.common import normalised, stored, word_count

CAPACITY = 2048
SHARD_ITEMS = 2000
COPIES_AT_ONCE = 10_000


def best_fit(
    sizes: Sequence[int], sources: Sequence, clusters: Sequence, capacity: int
) -> tuple[list[int], list[int]]:
    """Bin and place in the bin of each item, in the order given.

    Open bins are kept by (residual, number), each with a bitmap of the
    sources and one of the clusters it holds. The successor of the item's size
    is the tightest bin; while it holds the item's source or cluster, the
    search goes on to the next one. Full bins leave the list.
    """
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(sources))}
    cluster_bit = {c: 1 << i for i, c in enumerate(dict.fromkeys(clusters))}
    open_bins: list[tuple[int, int]] = []
    holds: list[list[int]] = []
    bins, places = [], []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        s, c = source_bit[source], cluster_bit[cluster]
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins):
            held = holds[open_bins[at][1]]
            if not (held[0] & s or held[1] & c):
                break
            at += 1
        if at < len(open_bins):
            residual, number = open_bins.pop(at)
        else:
            residual, number = capacity, len(holds)
            holds.append([0, 0])
        holds[number][0] |= s
        holds[number][1] |= c
        bins.append(number)
        places.append(capacity - residual)
        if residual > size:
            insort(open_bins, (residual - size, number))
    return bins, places


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    capacity: int = CAPACITY,
    shard_items: int = SHARD_ITEMS,
    seed: int = 6,
) -> DataFrame:
    """One row per piece: doc_id, piece, first_word, n_words, bin_id, bin_at.

    A document longer than `capacity` words is cut into full bins, which stand
    alone, and one last piece. Last pieces and shorter documents are dealt by a
    seeded hash into shards of about `shard_items`, and each shard is packed by
    itself, largest items first: the tightest open bin that fits and holds
    neither the item's source nor a copy of it (equal text but for white
    space). So no group, however large, meets in one task.

    A document without words has one piece of 0 words and no bin. A null
    source is a source. Rows that repeat an id are packed as documents of their
    own. No rows give no rows. Other columns are not read.
    """
    items = stored(
        docs.select(
            # As text, which pandas keeps as it is, null or not.
            F.col(id_col).cast("string").alias("doc_id"),
            F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("")).alias("source"),
            F.xxhash64(normalised(text_col)).alias("cluster"),
            word_count(text_col).alias("words"),
        ),
        "items",
    )
    shards = max(1, -(-items.count() // shard_items))
    # Equal rows are counted and numbered, so that copies of a row stay apart and
    # the bins do not depend on files or cores. A row that comes very often is
    # numbered by several tasks.
    row = ["doc_id", "source", "cluster", "words"]
    part = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES_AT_ONCE).cast("long"))
    last = F.least(F.col("n"), (F.col("part") + 1) * COPIES_AT_ONCE) - 1
    dealt = (
        items.groupBy(*row)
        .agg(F.count("*").alias("n"))
        .select("*", F.explode(part).alias("part"))
        .repartition(*row, "part")
        .select(*row, F.explode(F.sequence(F.col("part") * COPIES_AT_ONCE, last)).alias("copy"))
        .withColumn("salt", F.xxhash64(*row, "copy", F.lit(seed)))
        .withColumn("shard", F.pmod("salt", F.lit(shards)))
    )
    full = (F.col("words") / capacity).cast("long")
    full = F.when(F.col("words") % capacity == 0, full).otherwise(full)
    cut = dealt.withColumn("n_full", full).withColumn("rest", F.col("words") - full * capacity)

    def pack_shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rest", "doc_id", "source", "cluster"], ascending=[False, True, True, True])
        bins, places = best_fit(
            pdf["rest"].tolist(), pdf["source"].tolist(), pdf["cluster"].tolist(), capacity
        )
        return pd.DataFrame(
            {
                "doc_id": pdf["doc_id"],
                "piece": pdf["n_full"],
                "first_word": pdf["n_full"] * capacity,
                "n_words": pdf["rest"],
                "bin_id": [f"{s}-{b}" for s, b in zip(pdf["shard"], bins, strict=True)],
                "bin_at": places,
            }
        )

    schema = "doc_id string, piece long, first_word long, n_words long, bin_id string, bin_at long"
    packed = (
        cut.where(F.col("rest") > 0)
        .select("doc_id", "source", "cluster", "n_full", "rest", "shard")
        .groupBy("shard")
        .applyInPandas(pack_shard, schema)
    )
    alone = (
        cut.where(F.col("n_full") > 0)
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_full") - 1)))
        .select(
            "doc_id",
            "piece",
            (F.col("piece") * capacity).alias("first_word"),
            F.lit(capacity).cast("long").alias("n_words"),
            F.concat_ws("-", "shard", "doc_id", "copy", F.hex("salt"), F.concat(F.lit("full"), F.col("piece"))).alias("bin_id"),
            F.lit(0).cast("long").alias("bin_at"),
        )
    )
    none = cut.where(F.col("words") == 0).select(
        "doc_id",
        F.lit(0).cast("long").alias("piece"),
        F.lit(0).cast("long").alias("first_word"),
        F.lit(0).cast("long").alias("n_words"),
        F.lit(None).cast("string").alias("bin_id"),
        F.lit(None).cast("long").alias("bin_at"),
    )
    kind = dict(docs.select(id_col).dtypes)[id_col]
    whole = packed.unionByName(alone).unionByName(none)
    return whole.withColumn("doc_id", F.col("doc_id").cast(kind))
