"""Exact top-k by integer inner product: threshold algorithm on sorted lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crashgrade.llm.common import stored

BLOCK_ROWS = 8192
QUERY_ROWS = 16384
QUERY_STEP = 256
_EXACT = float(1 << 53)
_NONE = -np.inf  # score of a place that no row has taken yet
_LONG = (1 << 63) - 1


class SortedLists:
    """A block of rows by id, and per dimension the rows by value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.up = np.argsort(self.vectors, axis=0, kind="stable")
        self.n = len(ids)

    def named(self, depth: int, before: int) -> np.ndarray:
        """Rows that some list names, from either end, between two depths."""
        deep = np.concatenate([self.up[before:depth], self.up[self.n - depth : self.n - before]])
        return np.unique(deep)

    def edge(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Per dimension the largest and the smallest value behind a depth."""
        column = np.arange(self.vectors.shape[1])
        return self.vectors[self.up[self.n - 1 - depth], column], self.vectors[self.up[depth], column]


def _best(scores: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each line the k highest scores and their rows, ties to smaller rows."""
    if scores.shape[1] > k:
        kth = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        line, at = np.nonzero(scores >= kth[:, None])
    else:
        line, at = (x.ravel() for x in np.indices(scores.shape))
    value, row = scores[line, at], rows[line, at]
    order = np.lexsort((row, -value, line))
    line, value, row = line[order], value[order], row[order]
    place = np.arange(len(line)) - np.searchsorted(line, line)
    first = place < k
    out = np.full((len(scores), k), _NONE), np.full((len(scores), k), len(rows[0]) if len(rows) else 0)
    out[0][line[first], place[first]], out[1][line[first], place[first]] = value[first], row[first]
    return out


def threshold_search(
    lists: SortedLists, queries: np.ndarray, own: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, int]:
    """Scores and rows of the k best of a block for many queries at once, and
    how many (query, row) pairs were scored. Rows with a query's own id do not count;
    places that no row takes score minus infinity.

    All lists are read from both ends, to a depth that grows. The rows they
    name are scored for all queries that are still open. A row not named yet
    scores at most the products with the values behind the present depth, from
    the end that each sign prefers; a query leaves when that bound is below its
    kth score (at a tie an unnamed row with a smaller id could still win).
    Where the lists would name every row, the rest is scored in one product.
    All sums must stay below 2 ** 53, so doubles are exact."""
    n_queries, width = queries.shape
    best = np.full((n_queries, k), _NONE), np.full((n_queries, k), lists.n)
    open_, met, before, depth, scored = np.arange(n_queries), np.zeros(lists.n, dtype=bool), 0, 4, 0
    while len(open_) and not met.all():
        last = 4 * depth * width >= lists.n
        new = np.flatnonzero(~met) if last else lists.named(depth, before)
        new = new[~met[new]]
        met[new] = True
        q = queries[open_]
        scores = q @ lists.vectors[new].T
        scored += scores.size
        scores[lists.ids[new][None, :] == own[open_][:, None]] = _NONE
        rows = np.broadcast_to(new, scores.shape)
        best[0][open_], best[1][open_] = _best(
            np.hstack([best[0][open_], scores]), np.hstack([best[1][open_], rows]), k
        )
        if not last:
            high, low = lists.edge(depth)
            bound = np.maximum(q, 0) @ high + np.minimum(q, 0) @ low
            open_ = open_[bound >= best[0][open_][:, k - 1]]
        before, depth = depth, 4 * depth
    return *best, scored


def block_best(ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query id, row id, score) of the k best rows of a block for each query.

    Vectors so large that a sum could pass 2 ** 53 are scored in whole numbers of
    any size, row by row; their scores are given as the nearest long."""
    width = max(1, vectors.shape[1])
    limit = np.sqrt(_EXACT / width) - 1
    small, plain = (np.abs(x).max(axis=1, initial=0) < limit for x in (vectors, queries))
    lists = SortedLists(ids[small], vectors[small])
    found: list[tuple[int, int, int]] = []
    for first in range(0, int(plain.sum()), QUERY_STEP):
        at = np.flatnonzero(plain)[first : first + QUERY_STEP]
        scores, rows, _ = threshold_search(lists, queries[at], own[at], k)
        line, place = np.nonzero(scores > _NONE)
        found += zip(
            own[at][line].tolist(),
            lists.ids[rows[line, place]].tolist(),
            scores[line, place].astype(np.int64).tolist(),
            strict=True,
        )
    for q in range(len(queries)):
        rest = np.flatnonzero((ids != own[q]) & ~(small & plain[q]))
        whole = [int(x) for x in queries[q]] if len(rest) else []
        pairs = [(-sum(a * int(b) for a, b in zip(whole, vectors[r], strict=True)), int(ids[r])) for r in rest]
        found += [(int(own[q]), i, max(-_LONG - 1, min(_LONG, -s))) for s, i in sorted(pairs)[:k]]
    return found


def vectors_of(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: the whole-number vectors of all rows that take part."""
    x = F.col(vector_col)
    scaled = F.transform("v", lambda e: _floor(e.cast("double") * 256))
    return (
        table.select(F.col(id_col).alias("vec_id"), x.alias("v"))
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
        .select("vec_id", F.when(sound_of("v"), scaled).alias("v"))
        .where(F.col("v").isNotNull())
        .where(sound_of("v"))
    )


def sound_of(column: str) -> Column:
    return F.forall(
        column, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))), F.lit(False))
    )


def _floor(x: Column) -> Column:
    # F.floor gives a long, which a large double does not fit.
    cut = x - x % 1
    return F.when(F.abs(x) >= _EXACT, x).otherwise(F.when(cut > x, cut - 1).otherwise(cut))


def exact_top_k(
    embeddings: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    every: int = 50,
    k: int = 5,
    block_rows: int = BLOCK_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query.

    Queries are the rows whose id is divisible by `every`; candidates are all
    other rows. Candidates are dealt into blocks and queries into blocks; each
    pair of blocks is one group, in which the threshold algorithm runs on the
    block's sorted lists. The k best per block meet in a ranking per query.

    Vectors that are null or hold a null, NaN or infinity take no part, nor do
    null ids, nor components of which 256 times is beyond a double. Where an id
    repeats, each row is a candidate, and each row of a query's id asks; their
    answers are ranked together. Scores beyond a long are given, and ranked, as
    the nearest long. Vectors of another length than the query's are no
    candidates; vectors of length 0 score 0. No rows give no rows.

    An exact search compares each query with each row unless the bound spares
    it, so with n / `every` queries the work is quadratic in n. What is sent
    around is n * (n / (`every` * `query_rows`)) candidates.
    """
    vectors = stored(vectors_of(embeddings, id_col, vector_col), "vectors")
    n = max(1, vectors.count())
    # Even blocks, and as many tasks as blocks of candidates.
    n_blocks, n_query_blocks = -(-n // block_rows), -(-n // (every * query_rows))
    size = F.size("v")
    # The vector too, so that rows of one id do not meet in one block.
    block = lambda salt, m: F.pmod(F.xxhash64("vec_id", "v", F.lit(salt)), F.lit(m)).cast("int")
    candidates = vectors.select(
        "vec_id",
        "v",
        size.alias("length"),
        block(1, n_blocks).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(n_query_blocks - 1))).alias("part"),
    )
    queries = vectors.where(F.col("vec_id") % every == 0).select(
        "vec_id",
        "v",
        size.alias("length"),
        F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"),
        block(2, n_query_blocks).alias("part"),
    )

    def search(key: tuple, q: pa.Table, c: pa.Table) -> pa.Table:
        found: list[tuple[int, int, int]] = []
        if q.num_rows and c.num_rows:
            length = key[0].as_py()
            found = block_best(_ids(c), _matrix(c, length), _ids(q), _matrix(q, length), k)
        names = ["query_id", "vec_id", "score"]
        return pa.table(
            {n: pa.array([x[j] for x in found], pa.int64()) for j, n in enumerate(names)}
        )

    keys = ["length", "block", "part"]
    near = (
        queries.groupBy(*keys)
        .cogroup(candidates.groupBy(*keys))
        .applyInArrow(search, "query_id long, vec_id long, score long")
    )
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        near.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _ids(t: pa.Table) -> np.ndarray:
    return t.column("vec_id").to_numpy()


def _matrix(t: pa.Table, length: int) -> np.ndarray:
    if not length:
        return np.zeros((t.num_rows, 0))
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in t.column("v").chunks]
    return np.concatenate(flat).astype(np.float64).reshape(-1, length)
