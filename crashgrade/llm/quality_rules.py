"""Quality rules by weak supervision: rules vote good, bad or not at all, and
expectation-maximisation weighs their votes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashgrade.llm.common import _BASE, _INVERSE, Words, mix, powers, stored, text_slices

WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30  # percent of the words
KEEP = 0.5
LEAST_RIGHT = 0.55

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# name, numerator, denominator, which end is good, good from there on, bad from
# there on. A rule is silent between its two bounds, and where its denominator
# is 0. None: the rule never says so; a text without capitals need not be good.
RULES = (
    ("plain_words", "n_plain", "n_words", "high", 0.90, 0.70),
    ("bare_marks", "n_bare", "n_words", "low", 0.05, 0.25),
    ("letters", "n_letters", "word_chars", "high", 0.92, 0.88),
    ("symbols", "n_symbols", "n_words", "low", 0.02, 0.10),
    ("sentences", "n_stops", "n_words", "high", 0.03, 0.01),
    ("word_length", "word_chars", "n_words", "low", None, 12.0),
    ("repeated_lines", "n_dup_lines", "n_lines", "low", None, 0.30),
    ("repeated_words", "n_repeat_words", "n_words", "low", None, 0.30),
    ("capitals", "n_upper", "n_letters", "low", None, 0.40),
    ("loud", "n_loud", "n_words", "low", None, 0.20),
)
_SILENT, _BAD, _GOOD = 0, 1, 2

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_LETTER = _UPPER | np.roll(_UPPER, 32)
_LETTER[0xC3:] = True  # first bytes of all other letters, and of some signs
_IN_WORD = _LETTER.copy()
_IN_WORD[0x80:] = True
_IN_WORD[[ord("'"), ord("-")]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?"]] = True
_MARK = _STOP.copy()
_MARK[[ord(c) for c in ",;:"]] = True


def _repeats(text: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For entries (text, key): is the same entry found elsewhere, and earlier?"""
    order = np.lexsort((keys, text))
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = (keys[order][1:] == keys[order][:-1]) & (text[order][1:] == text[order][:-1])
    again, earlier = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    again[order] = same[:-1] | same[1:]
    earlier[order] = same[:-1]  # lexsort is stable: the first of equal ones comes first
    return again, earlier


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS and _MORE per text. Equal lines and windows are told by 64-bit
    hashes of their bytes within one text."""
    n = len(offsets) - 1
    words = Words(data, offsets)
    per_text = lambda flags: np.bincount(words.text, weights=flags, minlength=n).astype(np.int64)

    def total(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    in_word = np.zeros(len(data) + 1, dtype=np.int8)
    in_word[words.starts] += 1
    in_word[words.ends] -= 1
    in_word = np.cumsum(in_word[:-1], dtype=np.int8) > 0
    out = {
        "n_words": words.counts.astype(np.int64),
        "word_chars": total(in_word & ((data & 0xC0) != 0x80)),
        "n_symbols": total(_SYMBOL[data]),
        "n_letters": total(_LETTER[data]),
        "n_upper": total(_UPPER[data]),
        "n_loud": total(data == ord("!")),
    }

    # Plain words have letters only, and one mark at the end at most.
    sums = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(~_IN_WORD[data], out=sums[1:])
    foreign = sums[words.ends] - sums[words.starts]
    last = data[words.ends - 1] if len(words.ends) else data[:0]
    out["n_plain"] = per_text((foreign == 0) | ((foreign == 1) & _MARK[last]))
    out["n_bare"] = per_text(foreign == words.ends - words.starts)
    out["n_stops"] = per_text((foreign == 1) & _STOP[last])

    # Lines that hold a word: from the newline before to the one after it.
    breaks = np.flatnonzero(data == ord("\n"))
    line = np.searchsorted(breaks, words.starts)
    new = np.ones(len(line), dtype=bool)
    new[1:] = (line[1:] != line[:-1]) | (words.text[1:] != words.text[:-1])
    line, text = line[new], words.text[new]
    begin = np.maximum(np.append(-1, breaks)[line] + 1, offsets[text])
    end = np.minimum(np.append(breaks, len(data))[line], offsets[text + 1])
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=sums[1:])
    keys = mix((sums[end] - sums[begin]) * powers(_INVERSE, len(data) + 1)[begin] + (end - begin).astype(np.uint64))
    _, earlier = _repeats(text, keys)
    out["n_lines"] = np.bincount(text, minlength=n).astype(np.int64)
    out["n_dup_lines"] = np.bincount(text, weights=earlier, minlength=n).astype(np.int64)

    # Windows of words; those that reach into the next text do not count.
    hashes = words.hashes(data, lower=False)
    covered = np.zeros(len(hashes), dtype=bool)
    if len(hashes) >= WINDOW:
        sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * powers(_BASE, len(hashes)), out=sums[1:])
        first = np.arange(len(hashes) - WINDOW + 1)
        keys = mix((sums[WINDOW:] - sums[:-WINDOW]) * powers(_INVERSE, len(first)))
        whole = words.text[first] == words.text[first + WINDOW - 1]
        first, keys = first[whole], keys[whole]
        again, _ = _repeats(words.text[first], keys)
        edge = np.zeros(len(hashes) + 1, dtype=np.int64)
        np.add.at(edge, first[again], 1)
        np.add.at(edge, first[again] + WINDOW, -1)
        covered = np.cumsum(edge[:-1]) > 0
    out["n_repeat_words"] = per_text(covered)
    return out


def votes(counts: dict[str, np.ndarray]) -> np.ndarray:
    """One column per rule: silent, bad or good."""
    out = []
    for _, above, below, better, good, bad in RULES:
        value = counts[above].astype(np.float64)
        known = np.ones(len(value), dtype=bool)
        if below is not None:
            known = counts[below] > 0
            value = value / np.maximum(counts[below], 1)
        sign = 1.0 if better == "high" else -1.0
        vote = np.where(sign * value <= sign * bad, _BAD, _SILENT)
        if good is not None:
            vote = np.where(sign * value >= sign * good, _GOOD, vote)
        out.append(np.where(known, vote, _SILENT))
    return np.column_stack(out)


_PLACES = 3 ** np.arange(len(RULES))


@dataclass
class Accuracies:
    """Share of good texts, and per rule the chance that its vote is right."""

    share: float
    right: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Chance that a text is good, given its votes. Silence says nothing."""
        says = (votes == _GOOD).astype(float) - (votes == _BAD)
        odds = np.log(self.share) - np.log1p(-self.share)
        return 1.0 / (1.0 + np.exp(-(odds + says @ (np.log(self.right) - np.log1p(-self.right)))))


def estimate(votes: np.ndarray, weight: np.ndarray, rounds: int = 200, belief: float = 0.25) -> Accuracies:
    """Expectation-maximisation over distinct vote patterns and their numbers.

    Starts at the share of good among a text's votes. Each accuracy has a Beta
    prior of mean 0.8 that counts as `belief` times the rule's own votes and one
    more, so it acts alike at every size, and stays above LEAST_RIGHT: a rule
    is better than chance. A rule that never votes, and an empty table, have
    an estimate too."""
    good, bad = (votes == _GOOD).astype(float), (votes == _BAD).astype(float)
    cast = weight @ (good + bad)
    prior = belief * cast + 1.0
    q = (good.sum(axis=1) + 1.0) / (good.sum(axis=1) + bad.sum(axis=1) + 2.0)
    for _ in range(rounds):
        up, down = weight * q, weight * (1.0 - q)
        share = (up.sum() + 1.0) / (weight.sum() + 2.0)
        right = np.maximum((up @ good + down @ bad + 0.8 * prior) / (cast + prior), LEAST_RIGHT)
        found = Accuracies(float(share), right)
        now = found.posterior(votes)
        done = not len(q) or np.abs(now - q).max() < 1e-9
        q = now
        if done:
            break
    return found


def vote_patterns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, and the votes as one number in base 3."""
    kind = dict(docs.select(id_col).dtypes)[id_col]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in text_slices(batch.column(1)):
                got = text_counts(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first)]
                    + [pa.array(got[c]) for c in COUNTS]
                    + [pa.array((votes(got) @ _PLACES).astype(np.int32))],
                    ["doc_id", *COUNTS, "pattern"],
                )

    # A new name first: a column may be both id and text, or differ in case.
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body")).mapInArrow(
        count, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", pattern int"
    )


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept, posterior.

    All texts are counted whole and once; the estimate runs over the numbers
    of texts per vote pattern, of which there are at most 3 ** len(RULES). A
    null text counts as empty: it has no words, so base_failed. Rows that
    repeat an id or a whole row each give a row and each count in the
    estimate. No rows give no rows. Columns other than id and text are not
    read, whatever their names. `kept` means that the base holds and
    the posterior is at least `keep`, ties included."""
    counted = stored(vote_patterns(docs, id_col, text_col), "votes")
    # At most 3 ** len(RULES) rows, whatever the number of documents.
    seen = counted.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toArrow()
    pattern = seen.column("pattern").to_numpy().astype(np.int64)
    found = pattern[:, None] // _PLACES % 3
    chance = estimate(found, seen.column("n").to_numpy().astype(float)).posterior(found)
    verdicts = docs.sparkSession.createDataFrame(
        pa.table({"pattern": pa.array(pattern, pa.int32()), "posterior": pa.array(chance, pa.float64())})
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (
        counted.join(F.broadcast(verdicts), "pattern")
        .withColumn("base_failed", failed)
        .select(
            "doc_id", *COUNTS, "base_failed", (~failed & (F.col("posterior") >= keep)).alias("kept"), "posterior"
        )
    )
