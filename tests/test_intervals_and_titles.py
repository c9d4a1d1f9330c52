"""Interval joins and title matches against brute force, on hot keys, common words and odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from talus.operators import intervals, titles


def pairs(df):
    return sorted((r.a.n, r.b.n) for r in df.collect())


@pytest.mark.parametrize("seed", range(2))
def test_overlaps_equal_brute_force(spark, seed):
    rng = random.Random(seed)

    def spans(n):
        out = []
        for i in range(n):
            a = rng.randint(-300, 300)
            out.append((rng.choice(["x", "x", "y"]), a, a + rng.choice([0, 0, 1, 3, 4, 15, 16, 17, 64, 400, 5000, -1]), i))
        return [*out, ("x", None, 4, 900), (None, 1, 4, 901), ("x", -(2**40), 2**40, 902), out[0]]

    one, two = spans(120), spans(90)
    schema = "doc string, start long, end long, n int"
    got = pairs(intervals.overlap_join(spark.createDataFrame(one, schema), spark.createDataFrame(two, schema), ["doc"]))
    good = lambda s: s[0] is not None and s[1] is not None and s[1] <= s[2]
    assert got == sorted((a[3], b[3]) for a in one for b in two if good(a) and good(b) and a[0] == b[0] and a[1] <= b[2] and b[1] <= a[2])
    assert intervals.overlap_join(spark.createDataFrame([], schema), spark.createDataFrame(two, schema), ["doc"]).count() == 0


def test_one_document_with_100_000_spans(spark):
    """Each span overlaps a few others; some are as long as the document. No cartesian product is planned."""
    spans = spark.range(100_000).select(F.lit(1).alias("doc"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + F.when(F.col("id") % 25_000 == 0, 10**6).otherwise(12)).alias("end"), "id")
    met = intervals.overlap_join(spans, spans, ["doc"])
    plan = met._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    # Neighbours and the spans themselves; what a long one covers, in both directions.
    want = sum(1 for _ in range(100_000)) + 2 * 99_999
    long = [0, 25_000, 50_000, 75_000]
    for i in long:
        want += 2 * (99_999 - i - 1)
    assert met.count() == want


def test_runs(spark):
    rows = [("x", 1, 3), ("x", 3, 5), ("x", 7, 9), ("x", 2, 2), ("y", 4, 4), ("y", 9, 1), ("y", 0, 100), ("y", 100, 101)]
    got = intervals.covered(spark.createDataFrame(rows, "doc string, start long, end long"), ["doc"])
    assert sorted(tuple(r) for r in got.select("doc", "start", "end", "spans").collect()) == [("x", 1, 5, 3), ("x", 7, 9, 1), ("y", 0, 101, 3)]


def fits(a, b):
    a, b = (set(titles_words(t)) for t in (a, b))
    shared, short, long = len(a & b), min(len(a), len(b)), max(len(a), len(b))
    if not a or not b:
        return False
    if shared >= 2:
        return shared / short >= 0.5 and (short > 2 or long <= 2 * short + 1)
    return shared == 1 and short == 1 and not (len(a) == 1 and next(iter(a & b)) in titles.COMMON)


def titles_words(title):
    cleaned = "".join(c if c.isalnum() else " " for c in (title or "").lower())
    return [w for w in cleaned.split() if len(w) >= 4 and w not in titles.EMPTY]


CASES = [
    ("Pbeegees", "pBeeGees: A Prudent Approach to Certificate-Decoupled Consensus", True), ("Survey", "Survey of Bloom Filters", False), ("Bloom Filter Survey", "Survey", True),
    ("Attention Is All You Need", "Attention Mechanisms in Convolutional Vision Models", False), ("Query Optimization", "Zebra: Learned Query Optimization for Large Stores", False),
    ("Deep Learning", "Deep Learning: Another Approach", True), ("Bloom Filter Survey", "Bloom Effects in Computer Graphics", False), ("with from", "with from", False), (None, "None Such", False),
]


@pytest.mark.parametrize("source, other, want", CASES)
def test_rules(source, other, want):
    assert fits(source, other) is want


def test_matches_equal_brute_force(spark):
    rng = random.Random(1)
    words = ["common"] * 12 + ["survey", "with", "abc"] + [f"word{i}" for i in range(14)] + ["Étude", "中文字符"]
    make = lambda n: [" ".join(rng.choices(words, k=rng.randint(0, 6))) for _ in range(n)]
    a = [(i, t) for i, t in enumerate([*make(150), *[c[0] for c in CASES]])]
    b = [(i, t) for i, t in enumerate([*make(150), *[c[1] for c in CASES]])]
    left, right = spark.createDataFrame(a, "k long, t string"), spark.createDataFrame(b, "k long, t string")
    own = {side: {r.k: r.class_id for r in titles.members(df, "k", "t").collect()} for side, df in (("a", left), ("b", right))}
    got = {(r.source_id, r.other_id): (r.sources, r.others) for r in titles.matches(left, right, "k", "t", "k", "t").collect()}
    want = {(own["a"][i], own["b"][j]) for i, s in a for j, o in b if fits(s, o)}
    assert set(got) == want
    assert all(n == (sum(v == x for v in own["a"].values()), sum(v == y for v in own["b"].values())) for (x, y), n in got.items())


def test_copies_make_no_pairs(spark):
    """20,000 titles of the same words on both sides are one row."""
    many = spark.range(20_000).select("id", F.lit("The common title of them all").alias("t"))
    (row,) = titles.matches(many, many.withColumnRenamed("id", "k"), "id", "t", "k", "t").collect()
    assert tuple(row) == (0, 20_000, 0, 20_000)


def test_long_titles_are_not_sent_with_each_of_their_words(spark):
    """Sixty texts of 2000 words without a line end would be gigabytes."""
    sources = spark.range(60).selectExpr("id", "array_join(transform(sequence(0, 1999), j -> concat('word', id * 2000 + j)), ' ') AS title")
    others = spark.range(60).selectExpr("id + 100 AS id", "concat_ws(' ', concat('word', id * 2000 + 5), concat('word', id * 2000 + 77), 'elsewhere') AS title")
    got = titles.matches(sources, others, "id", "title", "id", "title")
    assert sorted(tuple(r) for r in got.collect()) == [(i, 1, i + 100, 1) for i in range(60)]
    met = titles._met(titles._rarest(titles._classes(sources, "id", "title"), spark.createDataFrame([("word5", 1)], "w string, df long")), titles._classes(sources, "id", "title"), titles._classes(others, "id", "title"), False)
    assert met.columns == ["short", "long", "words"]
