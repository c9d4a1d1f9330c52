"""Pair scores, their best ones, and salient sentences, against brute force."""

import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from talus.functions import text as X
from talus.operators import rerank

ROWS = [(1, 10, "blue whale", "The blue whale sings"), (1, 11, "blue whale", "blue blue"), (1, 12, "blue whale", "whales are bluish"), (1, 13, "blue whale", ""), (1, 14, "blue whale", None), (1, 9, "blue whale", "whale, blue!"), (2, 10, "", "any"), (2, 11, None, "any"), (3, 1, "x", "x " * 50_000), (3, 2, "x", "中文 x"), (None, 5, "null key", "key null")]


def by_hand(query, text):
    def vector(token):
        out = np.zeros(rerank.WIDTH)
        for a, b, c in zip(f"  {token} ", f" {token} ", f"{token} ", strict=False):
            h = zlib.crc32((a + b + c).encode())
            out[h % rerank.WIDTH] += 1 if h >= 2**31 else -1
        return out / (np.sqrt((out**2).sum()) or 1)

    asked, there = re.findall(r"\w+", (query or "").lower()), re.findall(r"\w+", (text or "").lower())[:200]
    return sum(max(float(vector(a) @ vector(t)) for t in there) for a in asked) / len(asked) if asked and there else 0.0


def test_best_equal_brute_force(spark):
    df = spark.createDataFrame(ROWS, "q long, id long, query string, text string").withColumn("score", F.lit("clash")).repartition(3)
    got = {(r.q, r["rank"]): (r.id, r.score) for r in rerank.best(df, 3, "q", "id", "query", "text").collect()}
    for q in {r[0] for r in ROWS}:
        want = sorted((-round(by_hand(r[2], r[3]), 9), r[1]) for r in ROWS if r[0] == q)[:3]
        assert [got[q, n][0] for n in range(1, len(want) + 1)] == [i for _, i in want]
        assert [got[q, n][1] for n in range(1, len(want) + 1)] == pytest.approx([-s for s, _ in want], abs=1e-8)
    assert got[1, 1] == (9, 1.0) and rerank.best(df.limit(0), 3, "q", "id", "query", "text").count() == 0


def test_scorers_can_be_exchanged(spark):
    df = spark.createDataFrame(ROWS, "q long, id long, query string, text string")
    calls = lambda queries, texts: np.array([float(len(t) + len(texts) * 0) for t in texts])
    assert [(r.id, r.score) for r in rerank.best(df.filter("q = 3"), 1, "q", "id", "query", "text", calls).collect()] == [(1, 100_000.0)]
    with pytest.raises(ValueError):
        rerank.best(df, 0, "q", "id", "query", "text")


def test_calls_are_of_like_lengths():
    lengths = [5, 900, 3, 4, 1000, 1, 0]
    calls = list(rerank.by_length(lengths, 12))
    assert sorted(i for c in calls for i in c) == list(range(7))
    assert all(len(c) == 1 or max(lengths[i] for i in c) * len(c) <= 12 for c in calls)
    assert [max(lengths[i] for i in c) for c in calls] == sorted(max(lengths[i] for i in c) for c in calls)


def test_salient_sentences(spark):
    text = "Cats sleep. We measure latency of the index. Nothing here! Latencies fall with an index? Dogs bark."
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string")
    got = [(r.place, r.sentence) for r in rerank.salient(df, "id", "t", ["index latency", "dogs"], 3).orderBy("place").collect()]
    parts = df.filter("id = 1").select(X.sentences(F.col("t"))).first()[0]
    scores = sorted((-max(by_hand(s, p) for s in ("index latency", "dogs")), i) for i, p in enumerate(parts))[:3]
    assert got == [(i, parts[i]) for i in sorted(i for _, i in scores)]
