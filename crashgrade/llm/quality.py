"""Quality: additive model with pairwise interactions, from boosted stumps."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashgrade.llm.common import Words, learn_bucket, text_slices

FEATURES = (
    "log_words",
    "word_length",
    "distinct_words",
    "top_word",
    "repeated_next",
    "upper",
    "digits",
    "symbols",
    "exclamations",
    "bars",
    "stops",
    "long_words",
)
BINS = 32
COARSE = 8
MOST_SAMPLED = 20_000
CUT = 0.7

_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = _UPPER | np.roll(_UPPER, 32)
_LETTER[0xC3:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#$%&*+<=>@\\^_`{}~[]/"]] = True


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text. An empty text has 0 everywhere."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1)

    def share(flags: np.ndarray, of: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(of, 1)

    letters = share(_LETTER[data], np.ones(n))
    words = Words(data, offsets)
    hashes = words.hashes(data, lower=False)
    count = np.maximum(words.counts, 1)
    lengths = words.ends - words.starts
    order = np.lexsort((hashes, words.text))
    text, hashed = words.text[order], hashes[order]
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (hashed[1:] != hashed[:-1])
    begins = np.flatnonzero(new)
    runs = np.diff(np.append(begins, len(text)))
    top = np.zeros(n)
    np.maximum.at(top, text[begins], runs)
    same = np.zeros(len(hashes), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.text[1:] == words.text[:-1])

    def per_text(values: np.ndarray) -> np.ndarray:
        return np.bincount(words.text, weights=values, minlength=n)

    distinct = np.bincount(text[begins], minlength=n)
    return np.column_stack(
        [
            np.log1p(words.counts),
            per_text(lengths) / count,
            distinct / count,
            top / count,
            per_text(same) / count,
            share(_UPPER[data], letters),
            share(_DIGIT[data], size),
            share(_SYMBOL[data], size),
            share(data == ord("!"), size),
            share(data == ord("|"), size),
            share(data == ord("."), size),
            per_text(lengths > 16) / count,
        ]
    ).astype(np.float64)


@dataclass
class Additive:
    """Lookup tables: one per feature, and one per pair on coarser bins."""

    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fine = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.coarse)]
        return np.array(fine), np.array(rough)

    def score(self, x: np.ndarray) -> np.ndarray:
        fine, rough = self.bins(x)
        z = np.full(len(x), self.base)
        for table, b in zip(self.tables, fine, strict=True):
            z += table[b]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[rough[i], rough[j]]
        return 1.0 / (1.0 + np.exp(-z))


def _tree(g: np.ndarray, h: np.ndarray, depth: int, l2: float) -> np.ndarray:
    """Value per bin of a tree on one feature's ordered bins."""
    out = np.full(len(g), g.sum() / (h.sum() + l2))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + l2) + gr**2 / (hr + l2)
    gain[(hl < 1) | (hr < 1)] = -1
    cut = int(gain.argmax())
    if gain[cut] <= g.sum() ** 2 / (h.sum() + l2) + 1e-9:
        return out
    cut += 1
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1, l2), _tree(g[cut:], h[cut:], depth - 1, l2)])


def _pair_tree(g: np.ndarray, h: np.ndarray, l2: float) -> tuple[np.ndarray, float]:
    """Value per cell of the best tree that cuts one feature and then, on
    either side, the other; and its gain."""
    best, top = np.zeros_like(g), 0.0
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        for cut in range(1, len(a)):
            value, gain = np.zeros_like(a), 0.0
            for part in (slice(None, cut), slice(cut, None)):
                line = _tree(a[part].sum(axis=0), b[part].sum(axis=0), 1, l2)
                value[part] = line
                gain += float((2 * a[part].sum(axis=0) * line - b[part].sum(axis=0) * line**2).sum())
            if gain > top:
                best, top = (value.T if turned else value), gain
    return best, top


def fit_additive(
    x: np.ndarray,
    y: np.ndarray,
    rounds: int = 150,
    pair_rounds: int = 30,
    n_pairs: int = 6,
    rate: float = 0.1,
    l2: float = 1.0,
) -> Additive:
    """Boosts one feature after the other, round by round, so that each table
    gets its share; then the pairs of largest gain on what is left."""

    def cuts(column: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.zeros(0)

    edges = [cuts(c, BINS) for c in x.T]
    coarse = [cuts(c, COARSE) for c in x.T]
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    model = Additive(edges, coarse, float(np.log(share / (1 - share))), [np.zeros(len(e) + 1) for e in edges])
    fine, rough = model.bins(x)
    z = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds if len(y) else 0):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(
                np.bincount(fine[j], g, len(table)), np.bincount(fine[j], h, len(table)), 2, l2
            )
            table += step
            z += step[fine[j]]
    if not len(y):
        return model

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = len(coarse[i]) + 1, len(coarse[j]) + 1
        at = rough[i] * shape[1] + rough[j]
        g, h = slopes()
        return tuple(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    gains = sorted(((-_pair_tree(*cells(i, j), l2)[1], (i, j)) for i, j in combinations(range(x.shape[1]), 2)))
    model.pairs = [p for gain, p in gains[:n_pairs] if gain < 0]
    model.pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            step = rate * _pair_tree(*cells(i, j), l2)[0]
            table += step
            z += step[rough[i], rough[j]]
    return model


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    held_out: tuple[int, int] = (4, 2),
    most_sampled: int = MOST_SAMPLED,
) -> Additive:
    """Learns from labelled documents outside the held-out rows, the first
    `most_sampled` by a hash of the id. An id with several labels counts with
    the smallest one; null labels and ids do not count."""
    modulus, out = held_out
    chosen = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
        .where(F.col("_y").isin(0, 1) & F.col("_id").isNotNull() & (learn_bucket("_id", modulus) != out))
        .groupBy("_id")
        .agg(F.min("_y").alias("_y"))
        .orderBy(F.xxhash64("_id", F.lit(11)), "_id")
        .limit(most_sampled)
    )
    names = [f"f{i}" for i in range(len(FEATURES))]

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(2)):
                x = text_features(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(first, end - first) for k in (0, 1)] + [pa.array(c) for c in x.T],
                    ["id", "y", *names],
                )

    # At most `most_sampled` short rows are sent to the executors and come back.
    got = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), F.col("id") == F.col("_id"))
        .select(F.col("id").cast("string"), "_y", "text")
        .mapInArrow(features, "id string, y int, " + ", ".join(f"{n} double" for n in names))
        .toArrow()
        .to_pandas()
        .sort_values(["id", *names])
    )
    return fit_additive(got[names].to_numpy(), got["y"].to_numpy(dtype=np.float64))


def score_quality(
    docs: DataFrame,
    model: Additive,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out: tuple[int, int] = (4, 2),
    cut: float = CUT,
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Null and empty
    texts are scored as texts without words. Rows that repeat an id each give
    a row; no rows give no rows; other columns are not read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(2)):
                p = shared.value.score(text_features(data, offsets))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(k).slice(first, end - first) for k in (0, 1)]
                    + [pa.array(p), pa.array((p >= cut).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    modulus, out = held_out
    return docs.select(
        F.col(id_col).alias("doc_id"), (learn_bucket(id_col, modulus) == out).alias("held_out"), text_col
    ).mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")


def classify_quality(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """Fits on the labelled documents and scores every whole text."""
    return score_quality(docs, fit_quality(docs, labels, **columns))
