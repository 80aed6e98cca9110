"""Text columns as byte arrays, shared tables, and a distributed row number."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crashgrade.session import shared_folder

# White space and words, for Java's and DuckDB's patterns alike.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back: its lineage ends here, and
    a lost executor does not make it run again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def with_rows(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The documents with a number for each row, and the number's column name,
    which no other column has. Stored, so that the numbers stay the same
    whatever is read of them. So rows that repeat an id, or all of another row,
    can be told apart."""
    key = "_row"
    while key in {c.lower() for c in docs.columns}:
        key += "_"
    return stored(docs.withColumn(key, F.monotonically_increasing_id()), name), key


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_of(column), F.lit(WORD)).cast("long")


def normalised(column: str = "text") -> Column:
    """The text with each run of white space replaced by one space."""
    return F.regexp_replace(text_of(column), SPACE, " ")


def learn_bucket(key: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; ids that are null count as
    the text "null"."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("null"))), F.lit(modulus))


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds `name`: 0, 1, ... in the given order, which must be total. Sorted by
    range, so that no task has to hold all rows."""
    ranged = stored(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        "numbered",
    )
    # One row per partition.
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select(
        "_part",
        (F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).alias("_before"),
    )
    return (
        ranged.join(before, "_part")
        .withColumn(name, F.col("_at") + F.coalesce("_before", F.lit(0)))
        .drop("_part", "_at", "_before")
    )


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.empty(max(n, 1 << 16), dtype=np.uint64)
        out[0], done, step = 1, 1, base
        while done < len(out):
            more = min(done, len(out) - done)
            out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
            done += more
        if len(out) <= 1 << 22:
            _POWERS[base] = out
        have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(
    column: pa.Array, limit: int = 1 << 20
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of a string column, about `limit`
    bytes at a time; a longer text comes alone and whole. Null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        end = min(end, len(column))
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


class Words:
    """The words of a slice: starts and ends (bytes), the text each is in, and
    per text the number of words and where they begin in the list."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        space = IS_SPACE[data]
        first = np.zeros(len(data), dtype=bool)
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        before = np.empty(len(data), dtype=bool)
        if len(data):
            before[0] = True
            before[1:] = space[:-1]
        self.starts = np.flatnonzero(~space & (before | first))
        after = np.empty(len(data), dtype=bool)
        if len(data):
            after[-1] = True
            after[:-1] = space[1:] | first[1:]
        self.ends = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.starts, offsets[:-1])
        self.counts = np.diff(np.append(self.first, len(self.starts)))
        self.text = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def hashes(self, data: np.ndarray, lower: bool = True) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, dtype=np.uint64)
        symbols = (LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(symbols * powers(_BASE, len(data)), out=sums[1:])
        own = (sums[self.ends] - sums[self.starts]) * powers(_INVERSE, len(data))[self.starts]
        return mix(own + (self.ends - self.starts).astype(np.uint64))


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` bytes that follow one another."""
    if len(data) < width:
        return np.zeros(0, dtype=np.uint64)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=sums[1:])
    n = len(data) - width + 1
    return mix((sums[width:] - sums[:n]) * powers(_INVERSE, n))


_FILTER_BITS = 26


def bitmap_of(keys: DataFrame, column: str) -> np.ndarray:
    """Bit set for each key (a long, well mixed), in an array of fixed size."""
    slot = F.shiftrightunsigned(F.col(column), 64 - _FILTER_BITS)
    words = (
        keys.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    )
    # At most 2 ** 20 rows, whatever the number of keys.
    got = words.toArrow()
    bits = np.zeros(1 << (_FILTER_BITS - 6), dtype=np.uint64)
    bits[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return bits


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys >> np.uint64(64 - _FILTER_BITS)
    return (bits[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
