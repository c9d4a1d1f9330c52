"""Running totals, batches under two budgets, and merges that touch few buckets."""

import os
import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from talus.operators import batches, keyed, tables
from talus.streaming import jobs


@pytest.fixture(scope="module")
def chunks(spark):
    rng = random.Random(8)
    rows = []
    for c, n in (("a", 80), ("b", 7), (None, 30)):
        for d in range(n):
            rows += [(c, d * 3, rng.choice([0, 5, 40, None, 700])) for _ in range(rng.choice([1, 1, 2, 9, 25]))]
    return spark.createDataFrame(rows, "collection string, document long, size long").withColumn("batch", F.lit("clash")).drop("batch")


def test_running_totals(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["x", "y", None]), rng.randint(0, 5), i, rng.randint(0, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, o int, id int, v long").repartition(5)
    got = {r.id: (r.n, r.total) for r in batches.running(df, [F.desc("o"), F.asc("id")], {"n": F.lit(1), "total": F.col("v")}, ["g"]).collect()}
    for g in ("x", "y", None):
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2]))
        assert [got[r[2]] for r in mine] == list(enumerate(accumulate(r[3] for r in mine), 1))
    assert batches.running(df.limit(0), [F.asc("id")], {"n": F.lit(1)}).count() == 0


def packed(df):
    return {(r.collection, r.document): (r.rows, r.bytes, r.batch) for r in df.collect()}


@pytest.mark.parametrize("stretch", [200_000, 40])
def test_batches_equal_brute_force(spark, chunks, monkeypatch, stretch):
    monkeypatch.setattr(batches, "STRETCH", stretch)
    got = packed(batches.packed(chunks, "collection", "document", "size", 30, 1500))
    assert got == packed(batches.packed(chunks.repartition(7, "size"), "collection", "document", "size", 30, 1500))
    docs = {}
    for r in chunks.collect():
        n, b = docs.get((r.collection, r.document), (0, 0))
        docs[r.collection, r.document] = n + 1, b + (r.size or 0)
    for c in ("a", "b", None):
        upto, name, n, b, at = 0, -1, 0, 0, None
        for d in sorted(d for k, d in docs if k == c):
            rows, size = docs[c, d]
            here = upto // stretch
            if here != at or n + rows > 30 or b + size > 1500:
                name, n, b = 0 if here != at else name + 1, 0, 0
            at, n, b, upto = here, n + rows, b + size, upto + rows + 1
            assert got[c, d] == (rows, size, f"{c}/{here}/{name}")


def test_failed_batches_are_halved(spark, chunks, tmp_path):
    """A sink that refuses some documents: all others are written, under names that a repeated run uses again."""
    folder, bad = str(tmp_path), {9, 30, 33}
    cut = batches.packed(chunks.filter("collection = 'a'"), "collection", "document", "size", 30, 1500)

    def write(name, rows):
        if bad & set(rows["document"].to_pylist()):
            raise OSError("refused")
        with open(os.path.join(folder, name.replace("/", "_")), "w") as out:
            out.write("\n".join(map(str, rows["document"].to_pylist())))

    for _ in range(2):
        result = batches.write_batches(chunks, cut, "collection", "document", write).collect()
    assert {r.document for r in result if not r.ok} == bad and all("refused" in r.error for r in result if not r.ok)
    written = [int(x) for f in os.listdir(folder) for x in open(os.path.join(folder, f)).read().split()]
    assert sorted(written) == sorted(r.document for r in chunks.filter("collection = 'a'").collect() if r.document not in bad)
    assert max(r.writes for r in result) > 1 and min(r.writes for r in result) == 1


def test_cache_is_cut_behind_whole_documents(spark):
    docs = spark.createDataFrame([(1, 5.0, "ab\ncd\n"), (2, 9.0, "x" * 30), (3, 9.0, "é\r\ny"), (4, 1.0, "late"), (5, 99.0, None), (6, 50.0, "")], "id int, w double, t string")
    size = lambda i, text: sum(len(f"{i}:{n}:{line}\n".encode()) for n, line in enumerate(text.splitlines(), 1))
    want = {2: size(2, "x" * 30), 3: size(3, "é\r\ny"), 1: size(1, "ab\ncd\n"), 4: size(4, "late")}
    for most, ids in ((1, [2]), (want[2], [2]), (want[2] + 1, [2, 3]), (want[2] + want[3] + 1, [2, 3, 1]), (10**6, [2, 3, 1, 4])):
        assert {r.id: r.bytes for r in batches.cached(docs, "w", "id", "t", most).collect()} == {i: want[i] for i in ids}


def test_streamed_batches_equal_batch_results(spark, chunks, tmp_path):
    chunks.filter("collection IS NOT NULL").repartitionByRange(3, "collection", "document").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(chunks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.write_packed(stream, "collection", "document", "size", str(tmp_path / "out"), str(tmp_path / "state"), 30, 1500).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    rows = lambda df: sorted((r.collection, r.document, r.size or 0) for r in df.collect())
    assert rows(out) == rows(chunks.filter("collection IS NOT NULL"))
    sizes = out.groupBy("run", "batch").agg(F.count("*").alias("n"), F.sum("size").alias("b"), F.countDistinct("document").alias("d")).collect()
    assert all(r.d == 1 or (r.n <= 30 and (r.b or 0) <= 1500) for r in sizes)


def stamps(path):
    return {d: sorted(os.stat(os.path.join(path, d, f)).st_mtime_ns for f in os.listdir(os.path.join(path, d))) for d in os.listdir(path) if d.startswith("bucket=")}


def test_merges_touch_only_their_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(200).select("id", F.lit(1).alias("n"), F.concat(F.lit("v"), "id").alias("v"))
    keyed.create(rows, path, ["id"], "n", 16)
    before = stamps(path)
    change = spark.createDataFrame([(5, 2, "new", False), (6, 2, None, True), (7, 0, "late", False), (900, 1, "more", None), (5, 3, "newest", False)], "id long, n int, v string, gone boolean")
    touched = keyed.merge(change, path, ["id"], "n", 1)
    after = stamps(path)
    assert touched and {d for d in after if before.get(d) != after[d]} == {f"bucket={b}" for b in touched} and len(touched) <= 4
    got = {r.id: (r.n, r.v) for r in keyed.read(spark, path).collect()}
    assert got == {i: (1, f"v{i}") for i in range(200) if i != 6} | {5: (3, "newest"), 900: (1, "more")}
    assert keyed.merge(change, path, ["id"], "n", 1) == [] and stamps(path) == after  # the number was merged
    keyed.merge(change, path, ["id"], "n")  # and without a number nothing changes
    assert {r.id: (r.n, r.v) for r in keyed.read(spark, path).collect()} == got
    log = rows.withColumn("gone", F.lit(False)).unionByName(change.withColumn("gone", F.coalesce("gone", F.lit(False))))
    assert {r.id: (r.n, r.v) for r in tables.last_writes(log, ["id"], "n", "gone").collect()} == got
