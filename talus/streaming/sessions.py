"""Scratch entries of sessions: kept while a session lives, promoted if flagged when it closes, gone otherwise.

A row is (session, kind, key, value, flagged, ts). `put` sets an entry, `close` ends the session; so does silence of `idle`, by event time. Rows after
that begin another session of the same name. As a stream, sessions are state with event-time timers, which checkpoints keep; as a batch, the
same is a window over the rows. Both give (session, closed_at, reason, key, value) of the flagged entries, the last put of a key counting.

The stream takes rows that are at most `late` late, and a session's rows in order from batch to batch (within a batch in any order; equal
times go by kind, key and value). A null session, time or kind, or a put without a key, is left out.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

OUT = "session string, closed_at timestamp, reason string, key string, value string"
MICROS = 1_000_000


def _good(rows: DataFrame) -> DataFrame:
    known = F.col("session").isNotNull() & F.col("ts").isNotNull() & (F.col("kind").isin("put", "close"))
    return rows.select(F.col("session").cast("string").alias("session"), "kind", "key", "value", F.coalesce("flagged", F.lit(False)).alias("flagged"), F.col("ts").cast("timestamp").alias("ts")).filter(known & ((F.col("kind") == "close") | F.col("key").isNotNull()))


def promoted(rows: DataFrame, idle: dt.timedelta, until: dt.datetime | None = None) -> DataFrame:
    """What is promoted up to a time: sessions that were closed, and those that have been silent for `idle` before `until` (none: the last row's time)."""
    seconds = idle.total_seconds()
    good = _good(rows)
    order = Window.partitionBy("session").orderBy("ts", "kind", "key", "value")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(order)) > int(seconds * MICROS)
    first = F.coalesce(gap | (F.lag("kind").over(order) == "close"), F.lit(True))
    numbered = good.withColumn("first", first.cast("int")).withColumn("place", F.row_number().over(order)).withColumn("n", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    ends = numbered.groupBy("session", "n").agg(F.max("ts").alias("last"), F.bool_or(F.col("kind") == "close").alias("closed"))
    end = F.timestamp_micros(F.unix_micros("last") + int(seconds * MICROS))
    limit = F.lit(until).cast("timestamp") if until is not None else good.agg(F.max("ts")).scalar()
    over = ends.withColumn("closed_at", F.when(F.col("closed"), F.col("last")).otherwise(end)).withColumn("reason", F.when(F.col("closed"), "closed").otherwise("idle"))
    over = over.filter(F.col("closed") | (F.col("closed_at") < limit)).select("session", "n", "closed_at", "reason")
    last = numbered.filter("kind = 'put'").groupBy("session", "n", "key").agg(F.max_by(F.struct("value", "flagged"), F.struct("ts", "place")).alias("l"))
    return last.filter("l.flagged").join(over, ["session", "n"]).select("session", "closed_at", "reason", "key", F.col("l.value").alias("value"))


def promote(stream: DataFrame, idle: dt.timedelta, late: str = "10 minutes") -> DataFrame:
    """`promoted` as a stream: a session's flagged entries come when it closes or when the watermark passes its silence."""
    wait = int(idle.total_seconds() * MICROS)

    def out(session: str, entries: dict, at: int, reason: str) -> pd.DataFrame:
        kept = [(session, pd.Timestamp(at, unit="us"), reason, key, value) for key, (value, flagged) in sorted(entries.items()) if flagged]
        return pd.DataFrame(kept, columns=["session", "closed_at", "reason", "key", "value"])

    def step(name: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entries, last = (json.loads(state.get[0]), state.get[1]) if state.exists else ({}, None)
        if state.hasTimedOut:
            state.remove()
            yield out(name[0], entries, last + wait, "idle")
            return
        rows = pd.concat(list(batches)).sort_values(["at", "kind", "key", "value"], na_position="first")
        for kind, key, value, flagged, at in zip(rows["kind"], rows["key"], rows["value"], rows["flagged"], rows["at"], strict=True):
            if last is not None and at - last > wait:
                yield out(name[0], entries, last + wait, "idle")
                entries = {}
            if kind == "close":
                yield out(name[0], entries, at, "closed")
                entries, last = {}, None
            else:
                entries[key], last = (None if pd.isna(value) else value, bool(flagged)), int(at)
        if last is None:
            state.remove()
        elif last + wait < state.getCurrentWatermarkMs() * 1000:
            state.remove()
            yield out(name[0], entries, last + wait, "idle")
        else:
            state.update((json.dumps(entries), last))
            state.setTimeoutTimestamp((last + wait) // 1000 + 1)

    rows = _good(stream).withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    return rows.groupBy("session").applyInPandasWithState(step, OUT, "entries string, last long", "append", GroupStateTimeout.EventTimeTimeout)
