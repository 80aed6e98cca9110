"""The stages of the pipeline, one after the other, on rows made to break them."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crashgrade.llm import language, packing
from crashgrade.llm.common import stored

SMALL = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, letters="abcdefgh"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(letters) for _ in range(r.randrange(2, 8))) for _ in range(n))


def xx(seed, n=60):
    return prose(seed, n, "qrstuvwz")


A, B, C, D, E1 = (prose(900 + i, 60) for i in range(5))
A2 = A.replace(" ", "\n", 3)
E2 = E1.replace(E1.split()[30], "changed", 1)
ODD = [
    (1, A), (1, A), (1, A2),  # a row given twice, and once with other white space
    (2, B), (2, xx(7)),  # one id, two texts
    (None, C), (None, D), (5, D), (None, xx(8)),  # no id; the second one is a copy
    (7, E1), (6, E2), (6, xx(9)),  # near copies, and another text of the id that stays
    (20, None), (21, ""), (22, " \t\n"), (23, "12 34 !!"), (None, None),
]
GONE_AS_UNKNOWN = {20, 21, 22, 23}


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, t, "aa", None if i % 5 == 0 else f"s{i % 3}", None) for i, t in ODD if i is not None]
    rows += [(None, t, "aa", None, None) for i, t in ODD if i is None]
    rows += [(100 + k, prose(k, 50), "aa", "s0", 1) for k in range(60)] + [(200 + k, xx(k + 50), "xx", "s1", 1) for k in range(60)]
    df = spark.createDataFrame(rows, DOC)
    return df.withColumn("lang", F.when(F.col("text").rlike("[q-z]{3}"), "xx").otherwise(F.col("lang")))


def content(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_every_stage_takes_what_it_should(spark, frame):
    clashing = frame.withColumns({n: F.lit("x") for n in ("_row", "copies", "_copy", "t", "rank", "words", "row", "body", "doc", "n")})
    steps = dict(corpus_pipeline.STAGES)
    before = content(frame)
    after = stored(steps["language"](spark, clashing, SMALL), "a")
    assert after.columns == clashing.columns
    unknown = {k for k in before if k[1] is None or not any(map(str.isalpha, k[1]))}
    assert content(after) == Counter({k: n for k, n in before.items() if k not in unknown})

    after = stored(steps["exact"](spark, after, SMALL), "b")
    assert after.columns == clashing.columns
    want = Counter({k: 1 for k in before if k not in unknown})
    del want[(None, D)]
    kept = content(after)
    # Which of the equal rows of id 1 stays does not matter.
    assert sum(kept[1, t] for t in (A, A2)) == 1
    for c in (kept, want):
        c.pop((1, A), None), c.pop((1, A2), None)
    assert kept == want

    before_near = content(after)
    after = stored(steps["near"](spark, after, SMALL), "c")
    assert content(after) == before_near - Counter({(7, E1): 1})

    before_mix = content(after)
    after = stored(steps["mix"](spark, after, SMALL), "d")
    taken = content(after)
    assert after.columns == clashing.columns and set(taken) <= set(before_mix) and max(taken.values()) <= 3
    # By code point: s0, s1, s2, and no source last, weigh 5, 2, 1 and 5.
    assert len(set(taken)) > 0.5 * len(before_mix)

    bins = steps["pack"](spark, after, SMALL).collect()
    words = Counter()
    for r in bins:
        words[r["doc_id"]] += r["n_words"]
    want = Counter()
    for (i, t), n in taken.items():
        want[i] += n * len(t.split())
    assert words == want
    assert max(Counter({b: sum(x["n_words"] for x in bins if x["bin_id"] == b) for b in {x["bin_id"] for x in bins}}).values()) <= packing.CAPACITY


def test_without_any_language_nothing_is_lost(spark, frame):
    bare = frame.withColumn("lang", F.lit(None).cast("string"))
    assert content(language.keep_identified(bare)) == content(bare)


def test_no_rows_give_no_rows(spark, tmp_path):
    spark.read.parquet(f"{SMALL}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_packing_does_not_depend_on_layout(spark, frame):
    rows = frame.unionByName(frame.limit(20))
    one, many = (Counter(map(tuple, packing.pack(rows.repartition(n), capacity=128).collect())) for n in (1, 8))
    assert one == many


def test_bins_are_full(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = packing.pack(docs).where("n_words > 0").groupBy("bin_id").agg(F.sum("n_words").alias("n"), F.count("*").alias("pieces"))
    filled = got.where("pieces > 1").agg(F.avg("n")).first()[0]
    assert filled > 0.85 * packing.CAPACITY
