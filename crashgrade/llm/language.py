"""Language ID: sparse multinomial regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crashgrade.llm.common import learn_bucket, mix

BUCKETS = 1 << 15
SIZES = (1, 2, 3)
PER_LANGUAGE = 600
SALTS = 64
MOST_SAMPLED = 6000
UNKNOWN = "und"
LEAST_SCORE = 0.5


def ngram_counts(text: str) -> np.ndarray:
    """How often each hashed n-gram of 1 to 3 characters occurs, lower case."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    counts = np.zeros(BUCKETS)
    code = np.zeros(len(x), dtype=np.uint64)
    for n in SIZES:
        if len(x) < n:
            break
        code = (code[: len(x) - n + 1] << np.uint64(21)) | x[n - 1 :]
        slots = mix(code + np.uint64(n)) >> np.uint64(49)
        counts += np.bincount(slots.astype(np.int64), minlength=BUCKETS)
    return counts


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def weigh(slots: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf[slots]
    norm = np.sqrt((x * x).sum())
    return x / norm if norm else x


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, slots: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[slots] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        counts = ngram_counts(text)
        slots = np.flatnonzero(counts)
        p = softmax(self.logits(slots, weigh(slots, counts[slots], self.idf)) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit_ftrl(
    rows: list[tuple[np.ndarray, np.ndarray]],
    target: np.ndarray,
    n_classes: int,
    epochs: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.01,
    seed: int = 10,
) -> tuple[np.ndarray, np.ndarray]:
    """Follow the regularised leader, per coordinate, with elastic net; the
    last row is the bias, which is not penalised by l1."""
    z = np.zeros((BUCKETS + 1, n_classes))
    n = np.zeros_like(z)

    def weights(slots: np.ndarray, l1: float) -> np.ndarray:
        zs = z[slots]
        w = -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[slots])) / alpha + l2)
        return np.where(np.abs(zs) <= l1, 0.0, w)

    last, order = np.array([BUCKETS]), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            slots, x = rows[i]
            at = np.append(slots, last)
            w = np.vstack([weights(slots, l1), weights(last, 0.0)])
            x = np.append(x, 1.0)
            error = softmax(x @ w)
            error[target[i]] -= 1.0
            g = x[:, None] * error
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(BUCKETS), l1), weights(last, 0.0)[0]


def fit_temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm.
    One more row, with all languages alike, keeps it above 0 where the sample
    is told apart without error."""
    if not len(target):
        return 1.0
    blur = 1.0 / (len(target) + 1)

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        own = (1 - blur) * z[np.arange(len(target)), target] + blur * z.mean(axis=1)
        return float((np.log(np.exp(z).sum(axis=1)) - own).mean())

    low, high, ratio = -4.0, 4.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(texts: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many of all texts each n-gram bucket occurs, and their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total += ngram_counts(text) > 0
                n += 1
        slots = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(slots, -1)), pa.array(np.append(total[slots], n))], ["slot", "n"]
        )

    # One row per bucket at most, whatever the number of texts.
    got = (
        texts.select(text_col)
        .mapInArrow(count, "slot long, n long")
        .groupBy("slot")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    slots, n = got.column("slot").to_numpy(), got.column("n").to_numpy()
    found = np.zeros(BUCKETS)
    found[slots[slots >= 0]] = n[slots >= 0]
    return found, int(n[slots < 0].sum())


def fit_languages(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    held_out: tuple[int, int] = (3, 1),
    per_language: int = PER_LANGUAGE,
    most_sampled: int = MOST_SAMPLED,
) -> Model:
    """Inverse document frequencies over all documents that may be learned
    from; regression and temperature on a sample of them, bounded by
    `per_language` and `most_sampled` documents (the first by a hash of the
    id; a fifth of it sets the temperature)."""
    modulus, out = held_out
    usable = docs.where(
        F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (learn_bucket(id_col, modulus) != out)
    ).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    found, n = document_frequencies(usable, "text")
    idf = np.log((1.0 + n) / (1.0 + found)) + 1.0
    by_hash = [F.xxhash64("id", F.lit(7)), F.col("id")]
    first = F.row_number().over(W.partitionBy("lang", "salt").orderBy(*by_hash))
    chosen = (
        usable.select("id", "lang", F.pmod(F.xxhash64("id", F.lit(8)), F.lit(SALTS)).alias("salt"))
        .withColumn("place", first)
        .where(F.col("place") <= per_language)
        # A language has at most `SALTS` times `per_language` rows from here on.
        .withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(*by_hash)))
        .where(F.col("place") <= per_language)
        .orderBy("place", *by_hash)
        .limit(most_sampled)
        .select(F.col("id").alias("_id"), F.col("lang").alias("_lang"), "place")
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slots, values = [], []
            for text in batch.column(2).to_pylist():
                c = ngram_counts(text)
                s = np.flatnonzero(c)
                slots.append(s.astype(np.int32))
                values.append(c[s].astype(np.float32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(slots, pa.list_(pa.int32())),
                    pa.array(values, pa.list_(pa.float32())),
                ],
                ["lang", "place", "slots", "counts"],
            )

    # At most `most_sampled` short rows are sent to the executors.
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang"))
    sample = (
        usable.join(F.broadcast(chosen), same)
        .select("lang", "place", "text")
        .mapInArrow(features, "lang string, place int, slots array<int>, counts array<float>")
        .toArrow()
        .to_pylist()
    )
    sample.sort(key=lambda r: (r["place"], r["lang"], len(r["slots"]), r["slots"][:9]))
    languages = sorted({r["lang"] for r in sample})
    target = np.array([languages.index(r["lang"]) for r in sample], dtype=np.int64)
    rows = []
    for r in sample:
        s = np.array(r["slots"], dtype=np.int64)
        rows.append((s, weigh(s, np.array(r["counts"], dtype=np.float64), idf)))
    held = np.arange(len(rows)) % 5 == 4
    weights, bias = fit_ftrl(
        [r for r, h in zip(rows, held, strict=True) if not h], target[~held], len(languages)
    )
    model = Model(languages, idf, weights, bias)
    logits = np.array([model.logits(*r) for r, h in zip(rows, held, strict=True) if h])
    model.temperature = fit_temperature(logits.reshape(-1, max(1, len(languages))), target[held])
    return model


def predict_languages(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = (3, 1)
) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score. A null text,
    one without a letter, and any text if nothing could be learned, is `und`
    with score 0. Rows that repeat an id each give a row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got = [model.predict(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([g[0] for g in got], pa.string()),
                    pa.array([g[1] for g in got], pa.float64()),
                ],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    modulus, out = held_out
    return docs.select(
        F.col(id_col).alias("doc_id"), (learn_bucket(id_col, modulus) == out).alias("held_out"), text_col
    ).mapInArrow(score, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame, **columns) -> DataFrame:
    """Fits on `docs` and predicts every whole text of it.

    Rows with a null text, null language or held-out id are not learned from.
    No rows give no rows. Other columns are not read."""
    model = fit_languages(docs, **columns)
    plain = {k: v for k, v in columns.items() if k in ("id_col", "text_col")}
    return predict_languages(docs, model, **plain)


def keep_identified(docs: DataFrame, least_score: float = LEAST_SCORE, text_col: str = "text", **columns) -> DataFrame:
    """The documents whose language is recognised: not `und`, and with a score
    of `least_score` or more. Null texts and texts without a letter go. Rows go
    by themselves, whatever their id, and rows that repeat another one stay with
    it. Where no row has a language to learn from, nothing can be told apart and
    all documents stay. No rows give no rows. All columns stay, whatever their
    names."""
    model = fit_languages(docs, text_col=text_col, **columns)
    if not model.languages:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def sure(texts):
        import pandas as pd

        got = (shared.value.predict(t) for t in texts)
        return pd.Series([lang != UNKNOWN and score >= least_score for lang, score in got])

    return docs.where(sure(F.col(text_col)))
