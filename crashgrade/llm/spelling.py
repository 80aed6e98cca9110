"""Spelling variants: words one edit apart, found by scanning sorted lists with
banded edit-matrix rows that words with a common prefix share."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crashgrade.llm.common import stored

RUN = "[A-Za-zÀ-ÿ]"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH = 7
LEAST_COUNT = 2
MARGIN = 10
NOISE = 31

# A group of more words than this is cut further. One that cannot be cut has one
# open letter, or two: at most 90 + 90 ** 2 words over the letters of RUN.
MOST_IN_GROUP = 1024
BLOCK = 1 << 14
FRONT = 1 << 19

_FAR = 2  # two edits or more
_KEY = ["least", "short", "head", "tail"]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: letter runs in lower case (A to Z only), with one letter out
    where the checksum of id and run says so, that are long and frequent
    enough. A null id counts as the text "null"."""
    # A run that is too short gives no word, and a match cannot be part of a run.
    runs = F.regexp_extract_all(F.translate(text_col, CAPITALS, SMALL), F.lit(f"({RUN}{{{LEAST_LENGTH},}})"), 1)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    h = F.crc32(F.concat_ws(":", "key", "run"))
    cut = F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))
    return (
        docs.select(key.alias("key"), F.explode(runs).alias("run"))
        .select("run", h.alias("h"), F.pmod(h, F.length("run")).cast("int").alias("at"))
        .select(F.when(F.col("h") % NOISE == 0, cut).otherwise(F.col("run")).alias("word"))
        .where(F.length("word") >= LEAST_LENGTH)
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= LEAST_COUNT)
    )


def _cut(entries: DataFrame) -> DataFrame:
    """Each entry in two groups. One edit leaves the first or the last half of
    what is open in the shorter word as it is, so the two words of a pair meet
    in one of them at least. `short` keeps those apart that meet in both: in a
    group of last halves a pair counts only if fewer first letters agree."""
    open_ = "(least - length(head) - length(tail))"
    sized = entries.withColumns(
        {
            "half": F.expr(f"{open_} div 2"),
            "rest": F.expr(f"{open_} - {open_} div 2"),
            "middle": F.expr("substring(word, length(head) + 1, length(word) - length(head) - length(tail))"),
        }
    )
    first = "struct(short, concat(head, substring(middle, 1, half)) AS head, tail)"
    last = "struct(least(short, length(head) + half) AS short, head, concat(right(middle, rest), tail) AS tail)"
    return sized.selectExpr("word", "n", "least", f"inline(array({first}, {last}))")


def grouped(words: DataFrame, most: int = MOST_IN_GROUP) -> DataFrame:
    """word, n and a key, so that two words one edit apart share a key: `least`
    letters of the shorter word, and the `head` and `tail` that both have.
    Groups of over `most` words are cut again, until they are small or only one
    letter of the shorter word is open."""
    sized = words.withColumn("least", F.explode(F.array(F.length("word") - 1, F.length("word")))).where(
        F.col("least") >= LEAST_LENGTH
    )
    left = _cut(sized.withColumns({"short": F.col("least") + 1, "head": F.lit(""), "tail": F.lit("")}))
    can_cut = F.expr("least - length(head) - length(tail) > 1")
    parts = []
    while True:
        marked = left.withColumn("group_key", F.xxhash64(*_KEY))
        large = (
            marked.where(can_cut)
            .groupBy("group_key")
            .agg(F.count("*").alias("size"))
            .where(F.col("size") > most)
            .select("group_key", F.lit(True).alias("is_large"))
        )
        large = stored(large, "large")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, [*parts, left])
        marked = marked.join(large, "group_key", "left")
        again = F.coalesce("is_large", F.lit(False)) & can_cut
        parts.append(marked.where(~again).select(*left.columns))
        left = stored(_cut(marked.where(again).select(*left.columns)), "finer")


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each begins."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.int32)
    return flat, np.append(0, np.cumsum(sizes))


def shared_prefixes(flat: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Per entry, the length of the prefix shared with the one before; -1 where
    a group begins."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    lcp = np.full(n, -1, dtype=np.int64)
    rows = np.flatnonzero(group[1:] == group[:-1]) + 1
    lcp[rows] = 0
    depth = 0
    while len(rows):
        inside = (size[rows] > depth) & (size[rows - 1] > depth)
        rows = rows[inside]
        rows = rows[flat[offsets[rows] + depth] == flat[offsets[rows - 1] + depth]]
        depth += 1
        lcp[rows] = depth
    return lcp


def scan(
    flat: np.ndarray, offsets: np.ndarray, group: np.ndarray, asking: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """(query, entry) for all entries one edit from a query of the same group.

    The entries of a group are distinct and sorted. Row d of the edit matrix of
    a query and an entry depends on the entry's first d letters only, so entries
    whose shared prefixes reach d have one row: `node`, the first of them,
    stands for all. Rows hold three cells, at -1, 0 and +1 from the diagonal.
    Where all three are two edits or more, the whole range is left out. All
    queries go one letter further at a time."""
    size = np.diff(offsets)
    lcp = shared_prefixes(flat, offsets, group)
    n = len(size)
    begins = np.flatnonzero(lcp < 0)
    ends = np.append(begins[1:], n)
    own = np.cumsum(lcp < 0) - 1  # group number of each entry
    query = asking
    node, last = begins[own[query]], ends[own[query]]
    cells = np.tile(np.array([_FAR, 0, 1], dtype=np.int8), (len(query), 1))
    cells[size[query] == 0, 2] = _FAR
    pad = np.append(flat, np.zeros(1, dtype=flat.dtype))

    def letter(q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Letter `at` (from 0) of the queries; -1 outside."""
        inside = (at >= 0) & (at < size[q])
        return np.where(inside, pad[np.where(inside, offsets[q] + at, 0)], -1)

    out_q, out_e = [], []
    depth = 0
    while len(query):
        # Entries that end here: the first of a range, as the shortest sorts first.
        gap = size[query] - depth + 1
        whole = (size[node] == depth) & (gap >= 0) & (gap <= 2)
        hit = np.flatnonzero(whole)
        hit = hit[cells[hit, gap[hit]] == 1]
        out_q.append(query[hit])
        out_e.append(node[hit])
        # The ranges one letter further: they begin where the shared prefix is no longer than this.
        starts = np.flatnonzero(lcp <= depth)
        first, behind = np.searchsorted(starts, node), np.searchsorted(starts, last)
        count = behind - first
        parent = np.repeat(np.arange(len(query)), count)
        child = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
        low = starts[child]
        high = np.minimum(np.append(starts, n)[child + 1], last[parent])
        going = size[low] > depth
        parent, low, high = parent[going], low[going], high[going]
        q, old = query[parent], cells[parent]
        c = flat[offsets[low] + depth]
        # Cells of the next row: at diagonal offset k it holds the query's first depth + 1 + k letters.
        a = old[:, 0] + (letter(q, np.full(len(q), depth - 1)) != c)
        a = np.minimum(a, old[:, 1] + 1)
        b = old[:, 1] + (letter(q, np.full(len(q), depth)) != c)
        b = np.minimum(np.minimum(b, old[:, 2] + 1), a + 1)
        d = old[:, 2] + (letter(q, np.full(len(q), depth + 1)) != c)
        d = np.minimum(d, b + 1)
        new = np.minimum(np.column_stack([a, b, d]), _FAR).astype(np.int8)
        new[depth > size[q], 0] = _FAR
        new[depth + 1 > size[q], 1] = _FAR
        new[depth + 2 > size[q], 2] = _FAR
        alive = new.min(axis=1) < _FAR
        query, node, last, cells = q[alive], low[alive], high[alive], new[alive]
        depth += 1
    return np.concatenate(out_q), np.concatenate(out_e)


def agreeing(flat: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many first letters the entries of each pair have in common."""
    size = np.minimum(np.diff(offsets)[a], np.diff(offsets)[b])
    found = np.zeros(len(a), dtype=np.int64)
    rows, depth = np.arange(len(a)), 0
    while len(rows):
        rows = rows[size[rows] > depth]
        rows = rows[flat[offsets[a[rows]] + depth] == flat[offsets[b[rows]] + depth]]
        depth += 1
        found[rows] = depth
    return found


def _nearest(block: pa.Table) -> pa.RecordBatch:
    """The answers of whole groups, sorted by key and middle."""
    heads, middles, tails = (block.column(c).to_pylist() for c in ("head", "middle", "tail"))
    least, short, n = (block.column(c).to_numpy() for c in ("least", "short", "n"))
    flat, offsets = _points(middles)
    group = np.cumsum(np.append(False, _new_group(block)))
    head = np.fromiter(map(len, heads), dtype=np.int64, count=len(heads))
    tail = np.fromiter(map(len, tails), dtype=np.int64, count=len(tails))
    open_ = least - head - tail
    size = np.diff(offsets)
    # A query meets at most as many ranges at a time as its group has entries.
    load = np.cumsum(np.minimum(np.bincount(group)[group], 1024))
    found = []
    for part in np.split(np.arange(len(load)), np.searchsorted(load, np.arange(FRONT, load[-1], FRONT))):
        q, e = scan(flat, offsets, group, part)
        shorter = np.minimum(size[q], size[e]) == open_[q]
        q, e = q[shorter], e[shorter]
        once = head[q] + agreeing(flat, offsets, q, e) < short[q]
        found.append((q[once], e[once]))
    q, e = (np.concatenate(x) for x in zip(*found, strict=True))
    words = list(map("".join, zip(heads, middles, tails, strict=True)))
    place = np.empty(len(words), dtype=np.int64)
    place[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((place[e], -n[e], q))
    q, e = q[order], e[order]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])[: len(q)])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([words[i] for i in q[first]], pa.string()),
            pa.array(np.diff(np.append(first, len(q))), pa.int64()),
            pa.array(n[e[first]], pa.int64()),
            pa.array([words[i] for i in e[first]], pa.string()),
        ],
        ["word", "n_near", "best_n", "best"],
    )


def _new_group(block: pa.Table) -> np.ndarray:
    """Per entry but the first: is its key another than that of the one before?"""
    out = np.zeros(max(0, block.num_rows - 1), dtype=bool)
    for name in _KEY:
        column = block.column(name).combine_chunks()
        out |= pc.not_equal(column.slice(1), column.slice(0, len(out))).to_numpy(zero_copy_only=False)
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups, about BLOCK entries at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK:
            block = pa.Table.from_batches(held).combine_chunks()
            cuts = np.flatnonzero(_new_group(block)) + 1
            if len(cuts):
                yield block.slice(0, int(cuts[-1]))
                held = block.slice(int(cuts[-1])).to_batches()
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks()


def near_words(words: DataFrame, most: int = MOST_IN_GROUP) -> DataFrame:
    """word, n_near, best_n, best: how many words are one edit away, and the
    most frequent of them (ties: smallest in code-point order). Words that have
    none are left out. Pairs never leave their task: each group sends one row
    per word that found any."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            yield _nearest(block)

    middle = F.expr("substring(word, length(head) + 1, length(word) - length(head) - length(tail))")
    per_group = (
        grouped(words, most)
        .select(F.xxhash64(*_KEY).alias("group_key"), *_KEY, middle.alias("middle"), "n")
        .repartition("group_key")
        .sortWithinPartitions("group_key", *_KEY, "middle")
        .mapInArrow(answer, "word string, n_near long, best_n long, best string")
    )
    top = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return (
        per_group.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), top.alias("top"))
        .select("word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best"))
    )


def roots(links: DataFrame) -> DataFrame:
    """word, root: the end of the chain word -> form -> ... of the links (word,
    form). A form is at least MARGIN times as frequent as its word, so there are
    no rings, and chains are as short as a count has digits; each round doubles
    the stretch that is known."""
    found = stored(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(found.join(ahead, "root", "left").select("word", "root", "next"), "moved")
        if moved.where(F.col("next").isNotNull()).isEmpty():
            return found
        found = moved.select("word", F.coalesce("next", "root").alias("root"))


def spelling_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_IN_GROUP
) -> DataFrame:
    """One row per word of the whole texts: word, n, n_near, form, form_n, root.

    Null and empty texts have no words, and no words give no rows. A null id
    counts as the text "null". Rows that repeat count each time. Of near words
    with equal n, the smallest in code-point order is the form. Columns other than id
    and text are not read, whatever their names."""
    words = stored(word_counts(docs, id_col, text_col), "words")
    best = near_words(words, most)
    is_form = F.col("best_n") >= MARGIN * F.col("n")
    judged = stored(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(is_form, F.col("best")).alias("form"),
            F.when(is_form, F.col("best_n")).alias("form_n"),
        ),
        "judged",
    )
    ends = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(ends, "word", "left").withColumn("root", F.coalesce("root", "word"))
