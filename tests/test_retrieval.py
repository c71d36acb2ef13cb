import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.text import collapse, rolling_hash, summary_terms, terms
from millrace.operators import retrieval as R

DOCS = [(1, "County health services and county services"), (2, "The board meets"), (3, None), (4, ""), (5, "health health health of the county"), (5, "health health health of the county")]


def frame(spark):
    return spark.createDataFrame([(i, t, 0) for i, t in DOCS], "doc_id long, text string, score int")


def test_tokens_and_hashes(spark):
    rows = spark.createDataFrame([("égouts café naïve the cat_dog abc1",), ("",)], "t string").select(terms(F.col("t")).alias("w")).collect()
    assert [r.w for r in rows] == [["gouts", "caf", "the"], []] or rows[0].w == ["gouts", "caf", "the"]
    got = spark.createDataFrame([("health",), ("occupational",), ("zzzzzzzzzzzzzzz",)], "t string").select(rolling_hash(F.col("t")).alias("h")).collect()
    assert [r.h for r in got] == [-1221262756, 1876119222, 1646132666]
    assert spark.createDataFrame([("a  b c\n",)], "t string").select(collapse(F.col("t")).alias("c")).first().c == "a b c"
    assert spark.createDataFrame([("The BOARD of 2024, an x!",)], "t string").select(summary_terms(F.col("t")).alias("c")).first().c == ["board", "2024"]


def test_bm25_equals_the_formula(spark):
    words = [re.findall(r"[a-z]{3,}", (t or "").lower()) for _, t in DOCS]
    n, avg = len(words), sum(map(len, words)) / len(words)
    want = []
    for w in words:
        s, c = 0.0, Counter(w)
        for q in ["county", "health", "county"]:
            df = sum(q in x for x in words)
            if c[q]:
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * c[q] * 2.2 / (c[q] + 1.2 * (0.25 + 0.75 * len(w) / avg))
        want.append(s)
    got = R.bm25(frame(spark), "county health county").collect()
    assert sorted(round(r.score, 9) for r in got) == sorted(round(x, 9) for x in want)
    assert R.bm25(frame(spark).limit(0), "county").count() == 0


def test_last_word_of_a_bucket_wins(spark):
    words = ["aaa", "bbb", "ccc"]
    bucket = {w: abs(_java(w)) % 128 for w in words}
    other = next(w for w in (f"{a}{b}{c}" for a in "abcdefgh" for b in "abcdefgh" for c in "abcdefgh") if abs(_java(w)) % 128 == bucket["aaa"] and w != "aaa")
    df = spark.createDataFrame([(1, f"aaa aaa bbb {other}")], "doc_id long, text string")
    v = {r.bucket: r.val for r in R.hashed_vectors(R.term_frequency(df, "doc_id", "text"), "doc_id").collect()}
    assert v[bucket["aaa"]] == pytest.approx(v[bucket["bbb"]]) and sum(x * x for x in v.values()) == pytest.approx(1)


def _java(w):
    h = 0
    for c in w:
        h = (h * 31 + ord(c)) % 2**32
    return h - 2**32 if h >= 2**31 else h


def test_hash_embedding_equals_the_loop(spark):
    text = "Request for  Proposal"
    got = spark.createDataFrame([(text,), ("",)], "t string").select(R.hash_embedding(F.col("t"), 8).alias("v")).collect()
    raw = []
    for i in range(8):
        h = 0
        for c in re.sub(r"\s+", " ", text.lower()):
            h = (h * 31 + ord(c) + i * ord(c)) % 2**32
        h = h - 2**32 if h >= 2**31 else h
        raw.append(math.fmod(h, 1000) / 1000)
    norm = math.sqrt(sum(x * x for x in raw))
    assert got[0].v == pytest.approx([x / norm for x in raw]) and list(got[1].v) == [0.0] * 8


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((60, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>").repartition(3)
    got = R.nearest(df, df.where("vec_id % 20 = 0"), 4).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 20, 40):
        s = u @ u[q]
        s[q] = -9
        assert [r.vec_id for r in sorted((r for r in got if r.query == q), key=lambda r: r.place)] == np.argsort(-s)[:4].tolist()


def test_stems_and_all_words(spark):
    assert R.stem("reviewing") == R.stem("reviews") == R.stem("reviewed") and R.stem("policies") == R.stem("policy") and R.stem("running") == R.stem("runs")
    df = spark.createDataFrame([("The reviewed schedules",), (None,), ("review",)], "t string")
    assert [r.m for r in df.select(R.contains_all_stemmed(F.col("t"), "the reviewing schedule").alias("m")).collect()] == [True, False, False]
    assert df.where(R.contains_all(F.col("t"), "the review")).count() == 1 and df.where(R.contains_all(F.col("t"), "the")).count() == 0
