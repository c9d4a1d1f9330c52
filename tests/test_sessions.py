"""Promotion of flagged entries when sessions close: by hand, as a batch, and as a stream that is stopped and goes on."""

import datetime as dt
import random

from pyspark.sql import functions as F

from talus.streaming import sessions

BEGIN = dt.datetime(2024, 1, 1)
IDLE = dt.timedelta(minutes=30)
SCHEMA = "session string, kind string, key string, value string, flagged boolean, ts timestamp"


def make(seed):
    rng, rows, now = random.Random(seed), [], BEGIN
    for i in range(160):
        now += dt.timedelta(minutes=rng.choice([0, 1, 1, 5, 40]) if i % 40 else 200)
        kind = rng.choice(["put"] * 6 + ["close"])
        rows.append((rng.choice("abc"), kind, rng.choice("xyz") if kind == "put" else None, f"v{i:03d}", rng.random() < 0.6, now))
    return [*rows, (None, "put", "x", "v", True, now), ("a", "other", "x", "v", True, now), ("a", "put", None, "v", True, now), ("zz", "put", "k", "last", True, now + dt.timedelta(days=2))]


def by_hand(rows, until):
    open_, out = {}, []

    def close(s, at, reason):
        out.extend((s, at, reason, k, v) for k, (v, flagged) in open_.pop(s, (None, {}))[1].items() if flagged)

    for s, kind, key, value, flagged, ts in sorted((r for r in rows if r[0] and r[1] in ("put", "close") and (r[1] == "close" or r[2])), key=lambda r: (r[5], r[1], r[2] or "", r[3])):
        if s in open_ and ts - open_[s][0] > IDLE:
            close(s, open_[s][0] + IDLE, "idle")
        if kind == "close":
            close(s, ts, "closed")
        else:
            open_[s] = (ts, open_.get(s, (None, {}))[1] | {key: (value, flagged)})
    for s in list(open_):
        if open_[s][0] + IDLE < until:
            close(s, open_[s][0] + IDLE, "idle")
    return sorted(out)


def rows_of(df):
    return sorted((r.session, r.closed_at, r.reason, r.key, r.value) for r in df.collect())


def test_batch_equals_by_hand(spark):
    for seed in range(2):
        rows = make(seed)
        df = spark.createDataFrame(rows, SCHEMA).repartition(4)
        last = max(r[5] for r in rows)
        assert rows_of(sessions.promoted(df, IDLE)) == by_hand(rows, last)
        assert rows_of(sessions.promoted(df, IDLE, last + dt.timedelta(days=1))) == by_hand(rows, last + dt.timedelta(days=1))
    assert sessions.promoted(df.limit(0), IDLE).count() == 0


def test_stream_equals_batch_after_a_restart(spark, tmp_path):
    rows = make(5)
    folder = str(tmp_path / "in")

    def put(part):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
        query = sessions.promote(stream, IDLE, "1 minute").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()

    put(rows[:50])
    run()
    put(rows[50:110])
    put(rows[110:])
    run()  # from the checkpoint
    watermark = max(r[5] for r in rows) - dt.timedelta(minutes=1)
    got = rows_of(spark.read.parquet(str(tmp_path / "out")))
    assert got == rows_of(sessions.promoted(spark.createDataFrame(rows, SCHEMA), IDLE, watermark)) == by_hand(rows, watermark)
    assert {r[2] for r in got} == {"idle", "closed"} and not spark.createDataFrame(rows, SCHEMA).filter(F.col("ts").isNull()).count()
