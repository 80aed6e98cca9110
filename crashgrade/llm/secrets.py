"""Secrets: fixed patterns, and strings that a tokenizer cannot shorten."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# The three base patterns.
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    r"|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "ratio")

# Strings that the token test looks at, and what is known not to be a secret.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
KNOWN = re.compile(
    r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"  # digests
    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"  # identifiers
    r"|[0-9+/_=-]+)"  # numbers and rules
)
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pre-tokenizer of the vocabulary: contractions, words, numbers, signs, spaces.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
MOST_CHARS_PER_TOKEN = 2.2
# Without a digit it may be a word, so the ratio has to be lower.
MOST_WITHOUT_DIGIT = 1.95
DIGIT = re.compile(r"[0-9]")

_ENCODINGS: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer, read once per worker."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _ENCODINGS[path] = tiktoken.Encoding(
            "own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}
        )
    return _ENCODINGS[path]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    # Neither pattern can match without one of these.
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    # A greedy run is whole, so only runs of 32 or more have to be looked at.
    found += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return found


LONG_HEX = re.compile(r"[0-9a-f]{32,}")


def token_spans(text: str, vocabulary: str, most: float) -> list[tuple[int, int, str]]:
    """Long strings with few characters per token."""
    out = []
    for m in CANDIDATE.finditer(text):
        if KNOWN.fullmatch(m[0]):
            continue
        cut = most if DIGIT.search(m[0]) else min(most, MOST_WITHOUT_DIGIT)
        if len(m[0]) / len(encoding(vocabulary).encode_ordinary(m[0])) <= cut:
            out.append((m.start(), m.end(), "ratio"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    ordered = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in ordered)


def find_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    most_chars_per_token: float = MOST_CHARS_PER_TOKEN,
) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_ratio,
    base_sha256, spans.

    Spans are kind:start:end in code points, end exclusive, of the whole match.
    Kind `ratio` is what the token test adds: strings of 16 or more characters
    with letters that take a token for every `most_chars_per_token` characters
    or fewer (without a digit, MOST_WITHOUT_DIGIT at most, so that words do not
    count), unless the whole string has the form of a digest or an identifier. `vocabulary` must exist on every
    executor.

    A null or empty text has no spans (base_sha256 is that of the empty
    string). Rows that repeat an id each give a row. No rows give no rows.
    Other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                base = base_spans(text) if text else []
                added = token_spans(text, vocabulary, most_chars_per_token) if text else []
                kinds = [k for _, _, k in base]
                rows.append(
                    (
                        kinds.count("assign"),
                        kinds.count("access"),
                        kinds.count("hex"),
                        len(added),
                        hashlib.sha256(joined(base).encode()).hexdigest(),
                        joined(base + added),
                    )
                )
            cols = list(zip(*rows, strict=True)) or [()] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            arrays = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *arrays],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_ratio", "base_sha256", "spans"],
            )

    kind = dict(docs.select(id_col).dtypes)[id_col]
    schema = (
        f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_ratio long,"
        " base_sha256 string, spans string"
    )
    return docs.select(id_col, text_col).mapInArrow(scan, schema)
