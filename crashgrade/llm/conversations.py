"""Conversation repair: turns aligned to the alternating grammar s?(ua)+ by
banded Wagner-Fischer matrices, and the cheapest audits compared."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from crashgrade.llm.common import stored

BLOCK = 512  # turns per matrix; longer conversations are composed of blocks
DELETE, INSERT, REROLE, CUT_OFF = 3, 2, 2, 1
_SPACES = " \t\n\x0b\x0c\r"
_FULL = {"u": "user", "a": "assistant"}
_LEGAL = {"su", "ua", "au"}
_S, _U, _A = 1, 2, 3
_CODE = {"s": _S, "u": _U, "a": _A}
_INF = 1 << 40
_NARROW = 4

Found = tuple[int, str]  # cost and audit; the least one wins


class Alignment:
    """Costs of aligning the turns r, r + 1, ... of a block to the last m letters
    of an alternating string that ends with `end`. What stands before does not
    matter, so one matrix holds the alignments to targets of every length.

    Kept are the diagonals from -low to high. `forced` turns must go; `late`
    ones cost one more where they stay."""

    def __init__(self, code: np.ndarray, forced: np.ndarray, late: np.ndarray, end: int, low: int, high: int):
        self.code, self.forced, self.late, self.end, self.low, self.high = code, forced, late, end, low, high
        n, width = len(code), low + high + 1
        steps = INSERT * np.arange(width)
        diagonal = np.arange(width) - low
        other = _U + _A - end
        self.rows = [np.empty(0, np.int64)] * (n + 1)
        self.rows[n] = row = np.where(diagonal >= 0, INSERT * diagonal, _INF)
        for r in range(n - 1, -1, -1):
            m = diagonal + (n - r)
            new = np.full(width, _INF)
            new[:-1] = row[1:] + DELETE
            if not forced[r]:
                # A target letter is met, or given to the turn.
                met = np.where(m % 2 == 1, end, other) == code[r]
                stays = row + np.where(met, 0, REROLE) + CUT_OFF * int(late[r])
                new = np.minimum(new, np.where(m >= 1, stays, _INF))
            new = np.where(m >= 0, new, _INF)
            # Insertions run along the row.
            row = np.minimum.accumulate(new - steps) + steps
            row = np.minimum(np.where(m >= 0, row, _INF), _INF)
            self.rows[r] = row

    def at(self, r: int, m: int) -> int:
        k = m - (len(self.code) - r) + self.low
        return int(self.rows[r][k]) if 0 <= k <= self.low + self.high and m >= 0 else _INF

    def targets(self, r: int, odd: bool) -> list[tuple[int, int]]:
        """The least cost over the target lengths of a kind, from one letter on,
        with each length that reaches it."""
        m = np.arange(self.low + self.high + 1) - self.low + (len(self.code) - r)
        fit = (m >= 1) & (m % 2 == int(odd))
        costs = np.where(fit, self.rows[r], _INF)
        best = int(costs.min())
        return [(best, int(x)) for x in m[costs == best]] if best < _INF else []

    def audit(self, r: int, m: int) -> str:
        """The ASCII-least of the cheapest audits, traced from the first turn on:
        an edit decides where the trace goes on, so the least one is taken."""
        out, n = [], len(self.code)
        while r < n or m > 0:
            cost = self.at(r, m)
            if r < n and self.at(r + 1, m) + DELETE == cost:
                out.append("D")
                r += 1
            elif m > 0 and self.at(r, m - 1) + INSERT == cost:
                out.append("I")
                m -= 1
            else:
                letter = self.end if m % 2 == 1 else _U + _A - self.end
                out.append("K" if self.code[r] == letter else "R")
                r, m = r + 1, m - 1
        return "".join(out)

    def best(self, odd: bool, lead: bool) -> Found:
        """Over all target lengths of a kind. `lead`: the first turn that stays
        may also be a kept system turn, before the first letter of the target."""
        starts = [(0, "", 0)]
        if lead:
            starts += [
                (DELETE * int(j) + CUT_OFF * int(self.late[j]), "D" * int(j) + "K", int(j) + 1)
                for j in np.flatnonzero((self.code == _S) & ~self.forced)
            ]
        found = [(before + cost, head, r, m) for before, head, r in starts for cost, m in self.targets(r, odd)]
        least = min(f[0] for f in found)
        return least, min(head + self.audit(r, m) for cost, head, r, m in found if cost == least)


Kind = tuple[int, bool, bool]  # end letter, odd length, with lead


def align(code: np.ndarray, forced: np.ndarray, late: np.ndarray, kinds: list[Kind], cap: int) -> dict[Kind, Found]:
    """The best of each kind, if it costs `cap` at most, else anything dearer.

    Bands after Ukkonen: what the kinds cost in narrow ones is the incumbent.
    A path pays for each step away from the diagonal, and for the turns that
    must go, so one no dearer than the incumbent stays within a band; if that is
    wider, the matrices are filled once more."""
    low = high = _NARROW
    while True:
        by_end = {end: Alignment(code, forced, late, end, low, high) for end, _, _ in kinds}
        found = {kind: by_end[kind[0]].best(*kind[1:]) for kind in kinds}
        bound = min(cap, max(cost for cost, _ in found.values()))
        need_low = min(len(code), bound // DELETE)
        need_high = max(0, bound - DELETE * int(forced.sum())) // INSERT
        if low >= need_low and high >= need_high:
            return found
        low, high = max(low, need_low), max(high, need_high)


def repair(code: np.ndarray, forced: np.ndarray, late: np.ndarray, block: int = BLOCK) -> Found:
    """The cheapest edits of a conversation that leave initials s?(ua)+ or no
    turn at all; of equally cheap ones those that are least in ASCII.

    Up to `block` turns are aligned at once. Of more, each block gives the best
    edits from what the target may have before it to what it may have after it:
    nothing, s alone, whole pairs, or a pair begun. These are put together
    in order. Of two audits with equal cost for the same turns none is the
    beginning of the other, so the least one stays least whatever follows."""
    n = len(code)
    pairs, begun = (_A, False), (_U, True)
    if n <= block:
        none = (DELETE * n, "D" * n)
        return min(none, align(code, forced, late, [(*pairs, True)], DELETE * n)[(*pairs, True)])
    states: dict[str, Found] = {"none": (0, "")}
    for first in range(0, n, block):
        part = slice(first, min(n, first + block))
        c, f, t = code[part], forced[part], late[part]
        gone = (DELETE * len(c), "D" * len(c))
        wide = DELETE * len(c) + 2 * (REROLE + INSERT)
        kinds = [(end, odd, lead) for end, odd in (pairs, begun) for lead in (False, True)]
        best = align(c, f, t, [*kinds, (_A, True, False), (_U, False, False)], wide)
        steps: dict[tuple[str, str], list[Found]] = {
            ("none", "none"): [gone],
            ("none", "s"): [
                (DELETE * (len(c) - 1) + CUT_OFF * int(t[j]), "D" * int(j) + "K" + "D" * (len(c) - 1 - int(j)))
                for j in np.flatnonzero((c == _S) & ~f)
            ],
            ("none", "pairs"): [best[(*pairs, True)]],
            ("none", "begun"): [best[(*begun, True)]],
            ("s", "s"): [gone],
            ("s", "pairs"): [best[(*pairs, False)]],
            ("s", "begun"): [best[(*begun, False)]],
            ("pairs", "pairs"): [gone, best[(*pairs, False)]],
            ("pairs", "begun"): [best[(*begun, False)]],
            ("begun", "begun"): [gone, best[(_U, False, False)]],
            ("begun", "pairs"): [best[(_A, True, False)]],
        }
        after: dict[str, Found] = {}
        for (before, to), ways in steps.items():
            for cost, audit in ways if before in states else []:
                way = (states[before][0] + cost, states[before][1] + audit)
                after[to] = min(after.get(to, way), way)
        states = after
    return min(states[x] for x in ("none", "pairs") if x in states)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by a checksum of conv_id and turn,
    and the order within a conversation: turn (null first), then a digest of
    the row as it was, then the copy. Dropped rows stay, marked `gone`."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    role, text = F.col("role"), F.col("text")
    return (
        conversations.select(
            "conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind")
        )
        .withColumn("row_key", _digest("role", "text"))
        .withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select(
            "conv_id",
            "turn",
            "row_key",
            "copy",
            (F.col("kind") == 0).alias("gone"),
            F.when(F.col("kind") == 4, F.lit("user")).otherwise(role).alias("role"),
            F.when(F.col("kind") == 1, F.lit(""))
            .when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", ""))
            .otherwise(text)
            .alias("text"),
        )
    )


def _digest(*columns: str) -> Column:
    """Of two texts; the first one's length keeps them apart."""
    a, b = map(F.col, columns)
    return F.unhex(F.sha2(F.concat_ws(":", F.length(a).cast("string"), a, b), 256))


_ORDER = ["conv_id", "part", "turn", "row_key", "copy"]
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _streamed(
    batches: Iterator[pa.RecordBatch], start: Callable[[dict[str, Any]], Any], names: list[str]
) -> Iterator[pa.RecordBatch]:
    """Results of the conversations of a sorted stream; `start` gets the first
    row of each, and every row that is there after damage is added."""
    out: list[list[Any]] = []
    state, conv, kind = None, None, None

    def flush() -> pa.RecordBatch:
        columns = [list(c) for c in zip(*out, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *map(pa.array, columns[1:])], names)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for row in batch.to_pylist():
            if state is None or row["conv_id"] != conv:
                if state is not None:
                    out.append([conv, *state.result()])
                state, conv = start(row), row["conv_id"]
            if row["gone"] is False:
                state.add(row)
        if len(out) >= 1000:
            yield flush()
    if state is not None:
        out.append([conv, *state.result()])
        yield flush()


class _Turns:
    """What is known of a conversation while its turns pass: a few bytes a turn."""

    def __init__(self) -> None:
        self.low = self.high = self.last = None
        self.distinct = self.illegal = 0
        self.before: str | None = None
        self.code, self.fault = bytearray(), bytearray()

    def add(self, row: dict[str, Any]) -> None:
        turn, initial = row["turn"], row["initial"]
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.distinct += turn != self.last
            self.high = self.last = turn
        if self.before is not None:
            self.illegal += self.before + initial not in _LEGAL
        self.before = initial
        self.code.append(_CODE.get(initial, 0))
        self.fault.append(row["fault"])

    def result(self) -> list[Any]:
        code, fault = (np.frombuffer(bytes(x), dtype=np.uint8) for x in (self.code, self.fault))
        cost, audit = repair(code, (fault == 1) | (fault == 2), fault == 3)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return [gaps, *(int((fault == k).sum()) for k in (1, 2, 3)), self.illegal, cost, audit]


class _Written:
    """Digest of the repaired conversation, fed turn by turn."""

    def __init__(self, head: dict[str, Any]) -> None:
        self.head, self.sha, self.at, self.started = head, hashlib.sha256(), 0, False
        kept = len(head["audit"]) - head["audit"].count("D")
        # An odd number of turns begins with s, which is always a kept one.
        self.next = None if kept % 2 else "u"

    def line(self, role: str, text: str) -> None:
        self.sha.update((("\n" if self.started else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
        self.started = True
        self.next = "a" if self.next == "u" else "u"

    def insertions(self) -> None:
        audit = self.head["audit"]
        while self.at < len(audit) and audit[self.at] == "I":
            self.line(_FULL[self.next], "")
            self.at += 1

    def add(self, row: dict[str, Any]) -> None:
        self.insertions()
        edit = self.head["audit"][self.at]
        self.at += 1
        if edit == "K":
            self.line(row["role"], row["text"])
        elif edit == "R":
            self.line(_FULL[self.next], row["text"])

    def result(self) -> list[Any]:
        self.insertions()
        return [*(self.head[c] for c in _COUNTS), self.head["audit"], self.sha.hexdigest()]


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conv_id: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256, of the rows after damage in their order.

    Nulls in role and text, and in conv_id and turn for the checksum, count as
    one space; a null conv_id is a conversation like others. A role's initial is
    its first character; an empty role has none and is legal nowhere. Rows of
    equal turn come in the order of a digest of role and text, and copies follow
    one another; a row given twice is a duplicate. No rows give no rows. Other
    columns are not read, whatever their names. Ids and turns that are not
    integers: any id works, turns are cast.

    The rows of a conversation pass sorted through one task, twice: first a few
    bytes a turn, of which the audit is made, then the texts, which are
    hashed as they pass and never held. The digest of the whole wants them in
    order. Duplicates are found in a window by conversation and digest."""
    rows = damaged(conversations)
    kind = dict(rows.dtypes)["conv_id"]
    bare = F.rtrim("text", F.lit(_SPACES))
    place = [F.col("turn").asc_nulls_first(), F.col("row_key"), F.col("copy")]
    seen = F.row_number().over(W.partitionBy("conv_id", "gone", "said").orderBy(*place)) > 1
    short = rows.select(
        "conv_id",
        F.lit(0).alias("part"),
        "turn",
        "row_key",
        "copy",
        "gone",
        F.left("role", F.lit(1)).alias("initial"),
        (bare == "").alias("is_blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("is_cut"),
        _digest("role", "text").alias("said"),
    ).withColumn(
        "fault",
        F.when(F.col("is_blank"), 1).when(seen, 2).when(F.col("is_cut"), 3).otherwise(0),
    )

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _streamed(batches, lambda row: _Turns(), ["conv_id", *_COUNTS, "audit"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _streamed(batches, _Written, ["conv_id", *_COUNTS, "audit", "repaired_sha256"])

    counts = ", ".join(f"{c} long" for c in _COUNTS)
    summary = f"conv_id {kind}, {counts}, audit string"
    final = f"{summary}, repaired_sha256 string"
    sort = [F.col(c).asc_nulls_first() for c in _ORDER]
    heads = (
        short.select(*_ORDER, "gone", "initial", "fault")
        .repartition("conv_id")
        .sortWithinPartitions(*sort)
        .mapInArrow(summarise, summary)
    )
    heads = stored(heads, "audits")
    body = rows.withColumn("part", F.lit(1)).select(*_ORDER, "gone", "role", "text")
    return (
        heads.withColumn("part", F.lit(0))
        .unionByName(body, allowMissingColumns=True)
        .repartition("conv_id")
        .sortWithinPartitions(*sort)
        .mapInArrow(write, final)
    )
