"""Quality rules, conversation repair and spelling variants: brute force and edges."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict


import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from crashgrade.llm import conversations, passages, quality_rules, spelling
from crashgrade.llm.oracle import CRC_TABLE, crc32_of
from crashgrade.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts_frame(spark, texts, clash=()):
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({n: F.lit("x") for n in clash})


# Quality rules


def brute_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered |= set(range(i, i + 8))
    lines, seen, repeated = [x for x in (text or "").split("\n") if WORD.search(x)], set(), 0
    for line in lines:
        repeated += line in seen
        seen.add(line)
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), symbols, repeated, len(covered), failed


RULES_EDGE = [
    None, "", " \t\n\v ", "one", "a\na\na\n\na", "é ñ ß 日本", "x " * 19, "x " * 20, "a b c d e f g h " * 3, "a b c d e f g h i\n" * 2,
    "\n\nline one\nline one \n line one\nline one", "$$$ ### <> |\n" * 5, "w" * 50_000, " ".join(f"w{i}" for i in range(30_000)),
    "x y z", "a\r\nb\r\na\r\nb",
]


def test_base_counts_equal_brute_force(spark):
    docs = [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    texts = RULES_EDGE + RULES_EDGE[:4] + docs
    df = texts_frame(spark, texts, ("pattern", "n", "posterior", "kept", "body", "n_words"))
    got = {r["doc_id"]: r for r in quality_rules.judge_quality(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        assert (*(r[c] for c in quality_rules.COUNTS), r["base_failed"]) == brute_counts(t), (i, (t or "")[:60])
        assert not (r["base_failed"] and r["kept"]) and 0 <= r["posterior"] <= 1


def test_estimated_accuracies_are_those_planted():
    r = np.random.default_rng(3)
    good = r.random(40_000) < 0.7
    right = np.array([0.95, 0.9, 0.8, 0.7, 0.85])
    votes = np.where(r.random((len(good), 5)) < right, good[:, None], ~good[:, None]) + 1
    votes[r.random(votes.shape) < 0.3] = 0
    pattern, n = np.unique(votes, axis=0, return_counts=True)
    found = quality_rules.estimate(pattern, n.astype(float), belief=0.001)
    assert found.right == pytest.approx(right, abs=0.02) and found.share == pytest.approx(0.7, abs=0.02)
    # A slow form of the same: one text at a time.
    q = found.posterior(votes[:50])
    for v, p in zip(votes[:50], q, strict=True):
        yes, no = found.share, 1 - found.share
        for vote, a in zip(v, found.right, strict=True):
            if vote:
                yes, no = yes * (a if vote == 2 else 1 - a), no * (1 - a if vote == 2 else a)
        assert p == pytest.approx(yes / (yes + no))


def test_estimate_does_not_depend_on_size_and_bears_nothing():
    pattern = np.array([[2, 2, 0, 1], [1, 1, 2, 0], [2, 0, 2, 2]])
    small, large = (quality_rules.estimate(pattern, np.array([800.0, 100.0, 500.0]) * k) for k in (1, 1000))
    assert small.right == pytest.approx(large.right, abs=0.01)
    none = quality_rules.estimate(np.zeros((0, 4), dtype=int), np.zeros(0))
    assert none.share == 0.5 and (none.right == 0.8).all()


def test_rules_keep_good_texts_and_drop_bad_ones(spark):
    """The estimate never sees a label; those of the table tell how good it is."""
    docs, labels = (spark.read.parquet(f"{MEDIUM}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.judge_quality(docs).join(labels, "doc_id").where("not base_failed").toPandas()
    good = got["quality"] == 1
    assert got["kept"][good].mean() > 0.99 and (~got["kept"])[~good].mean() > 0.8


def test_rules_count_each_repeated_row_and_id(spark):
    rows = [(1, "a b"), (1, "a b"), (1, "c"), (None, "d e f")]
    got = quality_rules.judge_quality(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in got.collect()) == [("1", 1), ("1", 2), ("1", 2), ("None", 3)]


# Conversation repair


def brute_repair(rows):
    """rows: (initial, blank or duplicate, cut off). All ways, one turn after the
    other, with the best per state; turns may be inserted anywhere."""
    best = {"": (0, "")}

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit) in list(best.items()):
                to = "a" if state != "a" else "p"
                best[to] = min(best.get(to, (cost + 2, audit + "I")), (cost + 2, audit + "I"))
        return best

    for initial, forced, late in rows:
        after = {}
        for state, (cost, audit) in inserted(best).items():
            ways = [(state, 3, "D")]
            if not forced:
                wanted, to = ("a", "p") if state == "a" else ("u", "a")
                ways.append((to, late, "K") if initial == wanted else (to, 2 + late, "R"))
                if state == "" and initial == "s":
                    ways.append(("s", late, "K"))
            for to, more, edit in ways:
                way = (cost + more, audit + edit)
                after[to] = min(after.get(to, way), way)
        best = after
    best = inserted(best)
    return min(best[s] for s in ("", "p") if s in best)


def exhaustive(rows):
    found = []

    def go(i, roles, cost, audit, added):
        if cost > 3 * len(rows):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            found.append((cost, audit))
        if i < len(rows):
            initial, forced, late = rows[i]
            go(i + 1, roles, cost + 3, audit + "D", 0)
            if not forced:
                go(i + 1, roles + initial, cost + late, audit + "K", 0)
                for x in "ua":
                    go(i + 1, roles + x, cost + late + 2, audit + "R", 0)
        for x in "ua" if added < 3 else "":
            go(i, roles + x, cost + 2, audit + "I", added + 1)

    go(0, "", 0, "", 0)
    return min(found)


def _arrays(rows):
    code = np.array([{"s": 1, "u": 2, "a": 3}.get(r[0], 0) for r in rows], dtype=np.uint8)
    return code, np.array([r[1] for r in rows], dtype=bool), np.array([bool(r[2]) for r in rows], dtype=bool)


def _random_rows(r, n, bad):
    out = []
    for _ in range(n):
        forced = r.random() < bad
        out.append((r.choice("suuuaaax"), forced, int(not forced and r.random() < 0.2)))
    return out


def test_cheapest_edits_are_those_of_all_ways():
    r = random.Random(1)
    for _ in range(150):
        rows = _random_rows(r, r.randint(0, 4), 0.25)
        want = exhaustive(rows)
        assert brute_repair(rows) == want == conversations.repair(*_arrays(rows)), rows


def test_long_conversations_and_blocks_equal_brute_force():
    r = random.Random(2)
    for k in range(150):
        rows = _random_rows(r, r.randint(5, 60), r.choice([0.0, 0.1, 0.6]))
        want = brute_repair(rows)
        for block in (512, 1, 7):
            assert conversations.repair(*_arrays(rows), block) == want, (block, rows)
    rows = _random_rows(r, 1300, 0.1)
    assert conversations.repair(*_arrays(rows)) == brute_repair(rows)
    allowed = [("s", True, 0)] * 600
    assert conversations.repair(*_arrays(allowed)) == (1800, "D" * 600)


def test_banded_matrix_is_that_of_wagner_and_fischer():
    """Every cell within a band wide enough, against the plain recursion."""
    r = random.Random(3)
    for _ in range(60):
        rows = _random_rows(r, r.randint(0, 6), 0.2)
        code, forced, late = _arrays(rows)
        for end in (2, 3):
            found = conversations.Alignment(code, forced, late, end, 12, 14)
            for m in range(0, 9):
                target = [end if (m - j) % 2 == 1 else 5 - end for j in range(m)]
                cost = [[10**9] * (m + 1) for _ in range(len(rows) + 1)]
                for i in range(len(rows), -1, -1):
                    for j in range(m, -1, -1):
                        ways = [0] if i == len(rows) and j == m else []
                        if i < len(rows):
                            ways.append(3 + cost[i + 1][j])
                            if j < m and not forced[i]:
                                ways.append((0 if code[i] == target[j] else 2) + int(late[i]) + cost[i + 1][j + 1])
                        if j < m:
                            ways.append(2 + cost[i][j + 1])
                        cost[i][j] = min(ways)
                assert found.at(0, m) == cost[0][0]


CONV = "conv_id long, turn long, role string, text string"


def brute_conversations(rows):
    out = {}
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        by_conv[conv].append((turn, role, text))
    for conv, turns in by_conv.items():
        kept = []
        for turn, role, text in turns:
            role, text = " " if role is None else role, " " if text is None else text
            named = [" " if x is None else str(x) for x in (conv, turn)]
            kind = zlib.crc32(":".join(named).encode()) % 20
            key = hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()
            after = ("user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            kept += [((turn is not None, turn or 0, key, c), turn, *after) for c in range(0 if kind == 0 else 2 if kind == 3 else 1)]
        kept.sort(key=lambda x: x[0])
        seen, faults = set(), []
        for _, _, role, text in kept:
            bare = text.rstrip(" \t\n\v\f\r")
            fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
        known = [t for _, t, _, _ in kept if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [role[:1] for _, _, role, _ in kept]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        cost, audit = brute_repair([(i, f in "bd" and f != "", int(f == "t")) for i, f in zip(initials, faults, strict=True)])
        lines, at, n = [], 0, len(audit) - audit.count("D")
        for edit in audit:
            if edit != "D":
                role = ("user", "assistant")[(len(lines) - n % 2) % 2]
                text = "" if edit == "I" else kept[at][3]
                lines.append(f"{kept[at][2] if edit == 'K' else role}:{text}")
            at += edit != "I"
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in "bdt"), illegal, cost, audit, digest)
    return out


def check_conversations(spark, rows, clash=()):
    df = spark.createDataFrame(rows, CONV).withColumns({n: F.lit("x") for n in clash})
    got = conversations.repair_conversations(df.repartition(3)).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == brute_conversations(rows) and len(got) == len({x[0] for x in rows})


def test_conversations_equal_brute_force(spark):
    table = spark.read.parquet(f"{MEDIUM}/conversations.parquet").select("conv_id", "turn", "role", "text")
    check_conversations(spark, list(map(tuple, table.collect())), ("part", "gone", "fault", "said", "audit", "kind", "copy"))


def test_conversations_with_odd_rows(spark):
    r = random.Random(5)
    roles = ["system", "user", "assistant", "tool", None, "", "User", "ü"]
    texts = ["Fine.", "cut", None, "", " \t", "Two lines.\nEnd!", "é?  \n", "x" * 40_000 + ".", ".", "Fine."]
    rows = [
        (r.choice([*range(30), None]), r.choice([*range(6), None]), r.choice(roles), r.choice(texts)) for _ in range(400)
    ]
    rows += rows[:40]
    rows += [(1000, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(700)]
    rows += [(2000 + k, k, "user", "Alone.") for k in range(60)]
    check_conversations(spark, rows)


# Spelling variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_spelling(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{low}".encode())
            if h % 31 == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    buckets = defaultdict(set)
    for w in words:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            buckets[v].add(w)
    form, found = {}, {}
    for w in words:
        around = {v for x in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for v in buckets[x] if near(w, v)}
        best = min(around, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
        found[w] = len(around)

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, n, found[w], form[w], words.get(form[w]), root(w)) for w, n in words.items()}


def rows_of(df):
    return {(r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@pytest.mark.parametrize("most", [1024, 3])
def test_spelling_equals_brute_force(spark, most):
    r = random.Random(6)
    base = ["".join(r.choice("abcé") for _ in range(r.randint(7, 10))) for _ in range(40)]
    bag = []
    for w in base:
        for _ in range(r.choice([1, 3, 40])):
            bag.append(w if r.random() < 0.8 else w[:3] + r.choice("abcé") + w[3 + r.randint(0, 1) :])
    r.shuffle(bag)
    texts = [" ".join(bag[i : i + 30]) for i in range(0, len(bag), 30)]
    edge = [None, "", "  ", "ABCDEFG abcdefg Àbcdefgh ÀBCDEFGH", "x" * 4000 + " " + "x" * 4000, "a1b2c3", "×÷×÷×÷× ×÷×÷×÷×", "naïveté—naïvetés"]
    df = texts_frame(spark, texts + edge * 2, ("word", "n", "key", "run", "head", "tail", "middle", "least"))
    df = df.unionByName(df.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    want = brute_spelling([(x["doc_id"], x["text"]) for x in df.collect()])
    assert rows_of(spelling.spelling_groups(df, most=most)) == want and len(want) > 40


def test_spelling_of_the_table_equals_brute_force(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    want = brute_spelling([tuple(x) for x in df.collect()])
    assert rows_of(spelling.spelling_groups(df)) == want


def test_chains_of_forms_end_at_the_root(spark):
    """Each step ten times as frequent as the one before."""
    words = ["abcdefgh", "abcdefgx", "abcdefxx", "abcdexxx"]
    rows = [(w, 3 * 10**i) for i, w in enumerate(words)] + [("unrelated", 5)]
    table = spark.createDataFrame(rows, "word string, n long")
    best = {r["word"]: (r["n_near"], r["best"]) for r in spelling.near_words(table).collect()}
    assert best["abcdefgx"] == (2, "abcdefxx") and "unrelated" not in best
    links = spark.createDataFrame([(a, b) for a, b in zip(words, words[1:])], "word string, form string")
    assert {r["word"]: r["root"] for r in spelling.roots(links).collect()} == {w: words[-1] for w in words[:-1]}
    assert spelling.roots(links.limit(0)).count() == 0


def test_scan_equals_all_pairs():
    r = random.Random(7)
    for letters in ("ab", "abcdé"):
        lists = [sorted({"".join(r.choice(letters) for _ in range(r.randint(0, 7))) for _ in range(n)}) for n in (1, 5, 150)]
        words = [w for ws in lists for w in ws]
        group = np.repeat(np.arange(3), [len(ws) for ws in lists])
        flat, offsets = spelling._points(words)
        q, e = spelling.scan(flat, offsets, group, np.arange(len(words)))
        want = {(i, j) for i in range(len(words)) for j in range(len(words)) if group[i] == group[j] and near(words[i], words[j])}
        assert len(q) == len(want) and set(zip(q.tolist(), e.tolist(), strict=True)) == want


def test_groups_stay_small_and_hold_every_pair(spark):
    """All words share their first half, so the first cut leaves one large group."""
    r = random.Random(8)
    words = sorted({"common" + "".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(3000)})
    table = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    keys = ["least", "short", "head", "tail"]
    sizes = [x["count"] for x in spelling.grouped(table, 64).groupBy(*keys).count().collect()]
    assert max(sizes) <= 64
    got = {x["word"]: x["n_near"] for x in spelling.near_words(table, 64).collect()}
    deleted = defaultdict(list)
    for w in words:
        for i in range(len(w)):
            deleted[i, w[:i] + w[i + 1 :]].append(w)
    want = Counter()
    for ws in deleted.values():
        for w in ws:
            want[w] += len(ws) - 1
    assert got == {w: n for w, n in want.items() if n}


def test_crc_in_sql():
    texts = ["", "123456789", "é:ü", "5:1"]
    con = duckdb.connect()
    for t in texts[1:]:
        got = con.execute(f"WITH crc AS ({CRC_TABLE}) SELECT {crc32_of('x')} FROM (SELECT ? AS x), crc", [t]).fetchone()[0]
        assert got == zlib.crc32(t.encode())


@pytest.mark.parametrize("name", ["op11_quality_rules", "op12_conversation_repair", "op13_spelling_variants"])
def test_empty_tables(spark, tmp_path, name):
    for t in ("documents", "conversations"):
        spark.read.parquet(f"{SMALL}/{t}.parquet").limit(0).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert QUERIES[name](spark, str(tmp_path)).count() == 0


def test_windows_of_one_function_tie_once():
    def w(left, right, f):
        return {"l": left, "r": right, "hl": left, "hr": right, "f": f}

    nested = [w(0, 60, 0), w(5, 55, 0), w(6, 54, 0), w(0, 60, 1)]
    assert passages.tied_regions(nested) == []
    assert passages.tied_regions([*nested, w(10, 90, 2)]) == [(0, 90, 0, 90)]


def test_dense_windows_equal_brute_force():
    rng = np.random.default_rng(8)
    for n, letters in [(0, 3), (45, 3), (46, 2), (90, 9), (120, 40), (150, 10**6)]:
        x = rng.integers(0, letters, n).astype(np.int32)
        known = np.isin(x, x[rng.random(n) < 0.45])
        want = []
        for i in range(n - 45):
            common = len(set(x[i : i + 46][known[i : i + 46]].tolist()))
            if common and 46 * common >= 28 * len(set(x[i : i + 46].tolist())):
                want.append(i)
        assert passages.dense_windows(x, known).tolist() == want


def test_passages_do_not_depend_on_the_order_in_which_texts_meet(spark, monkeypatch):
    """Overlapping stretches of three texts: a text's own passage goes on behind what the
    first text it meets covers, and two texts' ties come in different rounds."""

    def prose(seed, n):
        return [f"w{x}" for x in np.random.default_rng(seed).integers(0, 5000, n)]

    r = np.random.default_rng(2)
    sources, rows = [prose(200 + k, 400) for k in range(3)], []
    for k in range(40):
        source, at, n = sources[r.integers(3)], int(r.integers(0, 300)), int(r.integers(52, 100))
        before, behind = (prose(seed + k, int(r.integers(20, 60))) for seed in (2500, 52000))
        rows.append(" ".join([*before, *source[at : at + n], *behind]))
    df, words = texts_frame(spark, rows), []
    for first, more in ((10**9, 2), (1, 2)):
        monkeypatch.setattr(passages, "FIRST_HEADS", first)
        monkeypatch.setattr(passages, "MORE_HEADS", more)
        words.append({r["doc_id"]: r["n_words"] for r in passages.near_passages(df).collect()})
    # A run below 46 places takes in a few words that are not common, which differ by the pair.
    assert sum(n > 0 for n in words[0].values()) > 30
    assert [(k, n, words[1][k]) for k, n in words[0].items() if n > words[1][k] + 4] == []


def test_few_bare_places_keep_a_window_open():
    x = np.arange(1, 101, dtype=np.int32) << 6
    bits = np.zeros(1 << 20, dtype=np.uint64)
    for slot in x.view(np.uint32) >> np.uint32(6):
        bits[slot >> 6] |= np.uint64(1) << np.uint64(slot & 63)
    spans = [{"begin": 0, "end": 90}]
    # Words 90 to 103 are bare, so are the shingles from 86 on.
    assert passages.meeting_places(x, bits, spans).tolist() == list(range(41, 55))
    assert passages.meeting_places(x, bits, [*spans, {"begin": 88, "end": 104}]).tolist() == []
    # Unknown places count between known ones only.
    known = np.array([False, True, False, False, True, False])
    assert passages.bare_places(known, []).tolist() == [False, True, True, True, True, False]


def test_only_texts_with_a_value_in_common_are_dealt_again(spark, monkeypatch):
    """The shingles of all others stay where they are after the first round."""
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    every, seen = passages._open_windows, []

    def counted(found, *args):
        seen.append(found.count())
        return every(found, *args)

    monkeypatch.setattr(passages, "_open_windows", counted)
    got = passages.near_passages(docs)
    assert seen[0] > 300 and seen[1] < 0.9 * seen[0]
    assert got.count() == docs.count()
