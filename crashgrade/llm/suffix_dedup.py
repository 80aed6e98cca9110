"""Repeated 200-byte strings: suffix arrays built by linear grouping."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crashgrade.llm.common import IS_SPACE, bitmap_of, in_bitmap, mix, powers, stored, text_of, text_slices, window_hashes

LENGTH = 200
ANCHOR = 48
LOOK_BACK = 64
BUCKET_SEGMENTS = 5_000
MOST_SEGMENTS = 4_000
# As often a group can be cut by a further anchor that does not touch those before.
MOST_ANCHORS = 4
_PLACE = np.uint64((1 << 24) - 1)


def suffix_ranks(symbols: Sequence[int]) -> list[int]:
    """The rank of each suffix, by grouping suffixes by their Lyndon prefixes.

    Groups start as the suffixes of one symbol and are processed from the
    largest down. Each suffix of the group points to the next one before it
    that lies in a smaller group, its previous smaller suffix; that one's known
    prefix grows by the group's word, once for each suffix that points to it.
    So the suffixes pointed to leave their groups for new ones just above,
    by how often they were pointed to. When all groups are done, each is the
    set of suffixes with one Lyndon prefix. Then suffixes are given out from
    the smallest on: each lets those which it follows (the one before it, and
    along the pointers) take the next place of their groups.
    """
    n = len(symbols)
    names = {s: g for g, s in enumerate(sorted(set(symbols)))}
    group = [names[s] for s in symbols]
    members: list[list[int]] = [[] for _ in names]
    for i, g in enumerate(group):
        members[g].append(i)
    above = list(range(1, len(members))) + [-1]
    below = list(range(-1, len(members) - 1))
    prev = [-1] * n
    done = bytearray(n)
    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        for i in own:
            done[i] = 1
        times: dict[int, int] = {}
        for i in own:
            p = i - 1
            while p >= 0 and done[p]:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            new: dict[tuple[int, int], list[int]] = {}
            for p in sorted(times):
                new.setdefault((group[p], times[p]), []).append(p)
            # Often before seldom, as each goes directly above the old group.
            for (old, _), moved in sorted(new.items(), key=lambda x: -x[0][1]):
                at = len(members)
                members.append(moved)
                up = above[old]
                above.append(up)
                below.append(old)
                above[old] = at
                if up >= 0:
                    below[up] = at
                for p in moved:
                    group[p] = at
        g = below[g]
    place, free = 0, [0] * len(members)
    g = 0
    while below[g] >= 0:
        g = below[g]
    while g >= 0:
        free[g] = place
        place += sum(1 for i in members[g] if group[i] == g)
        g = above[g]
    rank, order = [-1] * n, [0] * n
    for at in range(-1, n):
        s = (n if at < 0 else order[at]) - 1
        while s >= 0 and rank[s] < 0:
            r = free[group[s]]
            free[group[s]] = r + 1
            rank[s] = r
            order[r] = s
            s = prev[s]
    return rank


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` values that follow one another."""
    n = len(x) - width + 1
    if n <= 0:
        return x[:0]
    pad = np.full(-len(x) % width, np.iinfo(np.uint64).max, dtype=np.uint64)
    blocks = np.concatenate([x, pad]).reshape(-1, width)
    fore = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], fore[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows of LENGTH bytes that have the same anchor,
    the leftmost ANCHOR bytes of smallest hash in the window: text, first
    window (from the text's begin), number of windows, fingerprint. Windows
    with the same bytes have the same fingerprint."""
    empty = tuple(np.zeros(0, dtype=np.int64) for _ in range(3)) + (np.zeros(0, dtype=np.uint64),)
    if len(data) < LENGTH:
        return empty
    hashes = window_hashes(data, ANCHOR)
    keys = (hashes & ~_PLACE) | (np.arange(len(hashes), dtype=np.uint64) & _PLACE)
    least = sliding_least(keys, LENGTH - ANCHOR + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    n = len(data) - LENGTH + 1
    whole = text[:n] == text[LENGTH - 1 :]
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (least[1:] != least[:-1]) | (text[1:n] != text[: n - 1]) | ~whole[:-1]
    begins = np.flatnonzero(fresh & whole)
    if not len(begins):
        return empty
    ends = np.flatnonzero(np.append((fresh | ~whole)[1:], True) & whole) + 1
    at = least[begins] & _PLACE
    low = begins.astype(np.uint64) & _PLACE
    anchor = begins + ((at - low) & _PLACE).astype(np.int64)
    # The least hashes are small, so they are scattered anew for the bitmap.
    return text[begins], begins - offsets[text[begins]], ends - begins, mix(hashes[anchor])


def cut_further(segment: bytes, used: list[int]) -> list[tuple[int, int, int, list[int]]]:
    """Runs of neighbouring windows of a segment that have the same next anchor:
    first window, number of windows, fingerprint of the anchor and of its distance
    from the one before, and the places of all anchors from the run's first byte on.

    The next anchor is the leftmost of smallest hash that does not touch those
    that are known, at `used`; the first one is the smallest of the segment, as
    it is that of all its windows. Equal windows have equal next anchors.
    Where there is none left, the fingerprint is 0."""
    data = np.frombuffer(segment, dtype=np.uint8)
    hashes = window_hashes(data, ANCHOR)
    place = np.arange(len(hashes), dtype=np.uint64)
    keys = (hashes & ~_PLACE) | place
    used = used or [int(keys.argmin())]
    none = np.iinfo(np.uint64).max
    for p in used:
        keys[max(0, p - ANCHOR + 1) : p + ANCHOR] = none
    least = sliding_least(keys, LENGTH - ANCHOR + 1)
    begins = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    out = []
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(least)], strict=True):
        shifted = [p - a for p in used]
        if least[a] == none:
            out.append((a, b - a, 0, shifted))
            continue
        at = int(least[a] & _PLACE)
        far = np.array([hashes[at] + np.uint64(LENGTH + at - used[-1])], dtype=np.uint64)
        out.append((a, b - a, int(mix(far)[0]), [*shifted, at - a]))
    return out


def repeated_windows(segments: list[bytes]) -> list[np.ndarray]:
    """Per segment, for each window of LENGTH bytes whether it occurs in
    another place of these segments.

    The suffix array is built over pieces, cut where a word begins (or after
    LOOK_BACK bytes of one kind), in the order of their bytes. A window starts
    somewhere within a piece; it is sorted by the bytes up to the first cut
    that lies LOOK_BACK bytes or more on, which its own bytes decide, and then
    by the rank of the suffix there. So windows with the same bytes are
    neighbours, and two neighbours are compared by a hash of all their bytes.
    """
    data = np.frombuffer(b"".join(segments), dtype=np.uint8)
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    begins = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(segments)), sizes)
    space = IS_SPACE[data]
    changed = np.ones(len(data), dtype=bool)
    changed[1:] = (space[1:] != space[:-1]) | (owner[1:] != owner[:-1])
    index = np.arange(len(data))
    run = index - np.maximum.accumulate(np.where(changed, index, 0))
    # At a change the run before it counts, which never reaches over a border.
    word = changed & ~space
    word[begins[sizes > 0]] = False
    cuts = np.flatnonzero(word | (run >= LOOK_BACK))
    ends = np.append(cuts[1:], len(data))
    last = np.append(owner[cuts[1:]] != owner[cuts[:-1]], True) if len(cuts) else np.zeros(0, bool)
    ends = np.where(last, (begins + sizes)[owner[cuts]], ends) if len(cuts) else ends
    raw = data.tobytes()
    pieces = [raw[a:b] for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
    # Each segment ends with a symbol of its own, below all pieces.
    base = len(segments)
    name = {p: base + i for i, p in enumerate(sorted(set(pieces)))}
    symbols, at_symbol = [], []
    for piece, final, seg in zip(pieces, last.tolist(), owner[cuts].tolist(), strict=True):
        at_symbol.append(len(symbols))
        symbols.append(name[piece])
        if final:
            symbols.append(seg)
    rank = np.array(suffix_ranks(symbols), dtype=np.int64)[at_symbol]

    counts = np.maximum(sizes - LENGTH + 1, 0)
    starts = np.arange(counts.sum()) + np.repeat(begins - (np.cumsum(counts) - counts), counts)
    cut = np.searchsorted(cuts, starts + LOOK_BACK)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    factor = 0xD6E8FEB86659FD93
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(factor, len(data)), out=sums[1:])
    inverse = powers(pow(factor, -1, 1 << 64), len(data))[starts]
    tail = mix((sums[cuts[cut]] - sums[starts]) * inverse)
    whole = mix((sums[starts + LENGTH] - sums[starts]) * inverse)
    order = np.lexsort((rank[cut], tail))
    twin = whole[order][1:] == whole[order][:-1]
    found = np.zeros(len(starts), dtype=bool)
    found[order[1:][twin]] = True
    found[order[:-1][twin]] = True
    return np.split(found, np.cumsum(counts)[:-1]) if len(segments) else []


def _twice(where: Column) -> Column:
    return F.min(where) != F.max(where)


def repeated_spans(
    texts: DataFrame, bucket_segments: int = BUCKET_SEGMENTS, most_segments: int = MOST_SEGMENTS
) -> DataFrame:
    """t, start, end: bytes covered by repeated strings, for `texts` (t, text),
    where t is a digest of the text."""
    spark = texts.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in text_slices(batch.column(1)):
                text, start, _, mark = anchors(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mark.view(np.int64)), batch.column(0).take(pa.array(text + first)), pa.array(start)],
                    ["mark", "t", "start"],
                )

    seen = texts.mapInArrow(count, "mark long, t binary, start long")
    marks = (
        seen.select("mark", F.xxhash64("t", "start").alias("place"))
        .groupBy("mark")
        .agg(_twice(F.col("place")).alias("twice"))
        .where("twice")
    )
    filtered = spark.sparkContext.broadcast(bitmap_of(marks, "mark"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, data, offsets in text_slices(batch.column(1)):
                text, start, n, mark = anchors(data, offsets)
                keep = in_bitmap(filtered.value, mark)
                text, start, n, mark = text[keep], start[keep], n[keep], mark[keep]
                at = offsets[text] + start
                raw = data.tobytes()
                parts = [raw[a:b] for a, b in zip(at.tolist(), (at + n + LENGTH - 1).tolist(), strict=True)]
                # The bytes go along once per slice, later copies without.
                known, segments = set(), []
                names = [hash_of(p) for p in parts]
                for p, name, m in zip(parts, names, mark.tolist(), strict=True):
                    segments.append(None if (m, name) in known else p)
                    known.add((m, name))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(mark.view(np.int64)),
                        pa.array(names, pa.int64()),
                        batch.column(0).take(pa.array(text + first)),
                        pa.array(start),
                        pa.array(n),
                        pa.array(segments, pa.binary()),
                    ],
                    ["mark", "name", "t", "start", "n", "segment"],
                )

    found = stored(
        texts.mapInArrow(cut, "mark long, name long, t binary, start long, n long, segment binary"), "segments"
    )
    # Equal segments at two places: all their windows are repeated.
    kinds = stored(
        found.groupBy("mark", "name").agg(
            _twice(F.xxhash64("t", "start")).alias("twice"),
            F.min("t").alias("t"),
            F.min("start").alias("start"),
        ),
        "kinds",
    )
    alike = found.select("mark", "name", "t", "start", "n").join(
        kinds.where("twice").select("mark", "name"), ["mark", "name"]
    )
    spans = alike.select("t", "start", (F.col("start") + F.col("n") + (LENGTH - 1)).alias("end"))
    # Others have to be told apart from the rest of their group.
    groups = (
        kinds.groupBy("mark")
        .agg(F.count("*").alias("size"), F.count_if(~F.col("twice")).alias("single"))
        .where("size > 1 and single > 0")
    )
    groups = stored(groups, "groups")
    open_kinds = kinds.join(groups.select("mark", "size"), "mark")
    bytes_of = (
        found.where(F.col("segment").isNotNull())
        .select("mark", "name", "segment")
        .join(open_kinds, ["mark", "name"])
        .groupBy("mark", "name", "segment")
        .agg(*[F.first(c).alias(c) for c in ("twice", "t", "start", "size")])
    )
    place = ["mark", "twice", "t", "start", "segment"]
    # Sizes are read from small tables, the segments themselves once where they are used.
    fits = F.col("size") <= most_segments
    parts, level = [], bytes_of.withColumn("used", F.array().cast("array<int>"))
    sizes, n_small = groups.select("size", F.col("size").alias("n")), 0
    for cuts in range(MOST_ANCHORS + 1):
        n_small += sizes.where(fits).agg(F.sum("n")).first()[0] or 0
        parts.append(level.where(fits).select(*place))
        if sizes.where(~fits).isEmpty():
            break
        if cuts == MOST_ANCHORS:
            spans = spans.unionByName(_by_window(level.where(~fits)))
            break
        level, more = _split(level.where(~fits))
        spans = spans.unionByName(more)
        sizes = level.select("size", F.lit(1).alias("n"))
    n_tasks = 1 + n_small // bucket_segments
    small = reduce(DataFrame.unionByName, parts).withColumn(
        "task", F.pmod(F.xxhash64("mark", F.lit(2)), F.lit(n_tasks))
    ).drop("mark")

    def search(t: pa.Table) -> pa.Table:
        twice, place, start = (t.column(c).to_pylist() for c in ("twice", "t", "start"))
        out: tuple[list, list, list] = ([], [], [])
        for i, flags in enumerate(repeated_windows(t.column("segment").to_pylist())):
            if twice[i] or not flags.any():
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                out[0].append(place[i])
                out[1].append(start[i] + a)
                out[2].append(start[i] + b - 1 + LENGTH)
        types = (pa.binary(), pa.int64(), pa.int64())
        return pa.table({n: pa.array(x, k) for n, x, k in zip(("t", "start", "end"), out, types, strict=True)})

    return spans.unionByName(small.groupBy("task").applyInArrow(search, "t binary, start long, end long"))


def _split(large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups cut by their next anchor, and the spans of the pieces that are
    found at two places whole."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["mark", "name", "twice", "t", "start", "n", "segment", "used"]
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()))
        for batch in batches:
            rows: list[tuple] = []
            for r in batch.to_pylist():
                for first, n, key, used in cut_further(r["segment"], r["used"]):
                    part = r["segment"][first : first + n + LENGTH - 1]
                    mark = int(np.array([r["mark"]]).view(np.uint64)[0]) ^ key
                    mark = int(mix(np.array([mark], dtype=np.uint64)).view(np.int64)[0])
                    rows.append((mark, hash_of(part), r["twice"], r["t"], r["start"] + first, n, part, used))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names)

    cut = stored(
        large.select("mark", "twice", "t", "start", "segment", "used").mapInArrow(
            pieces,
            "mark long, name long, twice boolean, t binary, start long, n long, segment binary, used array<int>",
        ),
        "pieces",
    )
    kinds = stored(
        cut.groupBy("mark", "name").agg(
            (F.max("twice") | _twice(F.xxhash64("t", "start"))).alias("twice"),
            F.min("t").alias("t"),
            F.min("start").alias("start"),
            F.first("segment").alias("segment"),
            F.first("used").alias("used"),
        ),
        "kinds",
    )
    # The spans of segments that are found twice are known already.
    alike = cut.where(~F.col("twice")).select("mark", "name", "t", "start", "n").join(
        kinds.where("twice").select("mark", "name"), ["mark", "name"]
    )
    spans = alike.select("t", "start", (F.col("start") + F.col("n") + (LENGTH - 1)).alias("end"))
    groups = (
        kinds.groupBy("mark")
        .agg(F.count("*").alias("size"), F.count_if(~F.col("twice")).alias("single"))
        .where("size > 1 and single > 0")
    )
    return stored(kinds.join(groups.select("mark", "size"), "mark"), "cut"), spans


def hash_of(part: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(part) - (1 << 63)


def _by_window(large: DataFrame) -> DataFrame:
    """The way for groups that are too large for one task: each window by
    itself, counted by digest, which combines before the shuffle. A segment found
    at two places stands for all of them: it makes its windows repeated, and its
    own spans are known already."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            t, start, twice, segment = (batch.column(i).to_pylist() for i in range(4))
            rows = [
                (x, s + i, w, xxhash.xxh3_128_digest(part[i : i + LENGTH]))
                for x, s, w, part in zip(t, start, twice, segment, strict=True)
                for i in range(len(part) - LENGTH + 1)
            ]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            types = (pa.binary(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, types, strict=True)], ["t", "start", "twice", "digest"]
            )

    each = stored(
        large.select("t", "start", "twice", "segment").mapInArrow(
            windows, "t binary, start long, twice boolean, digest binary"
        ),
        "windows",
    )
    repeated = (
        each.groupBy("digest")
        .agg((_twice(F.xxhash64("t", "start")) | F.max("twice")).alias("repeated"))
        .where("repeated")
    )
    return each.where(~F.col("twice")).join(repeated.select("digest"), "digest").select(
        "t", "start", (F.col("start") + LENGTH).alias("end")
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    and `removed`, the maximal removed runs as [begin, end) bytes.

    1. Each window of 200 bytes has an anchor, its 48 bytes of smallest hash;
       equal windows have equal anchors. Anchors found once are left out, by a
       bitmap of fixed size (a full one leaves more to the next steps).
    2. The neighbouring windows of an anchor make a segment. Equal segments at
       two places are repeated whole. Where a group of one anchor has several
       segments, tasks of about `bucket_segments` of them build a suffix array
       by linear grouping (`suffix_ranks`) and find which windows of single
       segments occur elsewhere (`repeated_windows`).
    3. A group of more than `most_segments` different segments (a line common
       to very many texts) does not meet in one task: it is cut by the next
       anchor of its windows, one that does not touch the first, and so on. Groups
       that stay large after 4 cuts, whose windows have nearly all bytes in
       common, are counted window by window by digest.
    4. Texts with copies go whole, if they have 200 bytes.

    A null text counts as empty (0 bytes). Texts below 200 bytes lose nothing.
    Rows that repeat an id are documents of their own, so equal ones remove
    each other. No rows give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    digest = F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("t")
    texts = rows.select(digest, "text")
    size = F.octet_length("text").cast("long")
    spans = repeated_spans(texts.where(size >= LENGTH), **options)
    copies = (
        texts.where(size >= LENGTH)
        .select("t", size.alias("end"))
        .groupBy("t", "end")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select("t", F.lit(0).cast("long").alias("start"), "end")
    )
    # Per text at most as many spans as it has anchors.
    per_text = stored(
        spans.unionByName(copies)
        .distinct()
        .groupBy("t")
        .agg(F.collect_list(F.struct("start", "end")).alias("spans")),
        "spans",
    )
    touched = spark.sparkContext.broadcast(bitmap_of(per_text.select(F.xxhash64("t").alias("h")), "h"))

    @F.pandas_udf("boolean")
    def maybe(h):
        import pandas as pd

        return pd.Series(in_bitmap(touched.value, h.to_numpy().view(np.uint64)))

    flagged = rows.select("*", digest).withColumn("maybe", maybe(F.xxhash64("t")))
    out = "doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed".split(", ")
    none = F.lit("[]")
    zero = F.lit(0).cast("long")
    untouched = flagged.where(~F.col("maybe")).select(
        "doc_id",
        size.alias("n_bytes"),
        zero.alias("n_removed"),
        zero.alias("n_spans"),
        F.sha2("text", 256).alias("kept_sha256"),
        none.alias("removed"),
    )
    kind = dict(rows.dtypes)["doc_id"]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            got = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw, kept, runs, at = text.encode(), hashlib.sha256(), [], 0
                for s in sorted(spans or (), key=lambda s: s["start"]):
                    if runs and s["start"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s["end"])
                    else:
                        runs.append([s["start"], s["end"]])
                for a, b in runs:
                    kept.update(raw[at:a])
                    at = b
                kept.update(raw[at:])
                got.append((len(raw), sum(b - a for a, b in runs), len(runs), kept.hexdigest(), runs))
            removed = [json.dumps([{"start": a, "end": b} for a, b in g[4]]) for g in got]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)]
                + [pa.array([g[k] for g in got], pa.int64()) for k in range(3)]
                + [pa.array([g[3] for g in got], pa.string()), pa.array(removed, pa.string())],
                out,
            )

    cleaned = (
        flagged.where("maybe")
        .join(per_text, "t", "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(
            remove,
            f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed string",
        )
    )
    return untouched.select(*out).unionByName(cleaned.select(*out))
