"""Structured Streaming jobs: telemetry by window, last writes per key, expiry and a claim queue.

All jobs read a stream with a schema and write Parquet or a keyed table through foreachBatch; their state and progress
live in the checkpoint location, so a lost executor or driver repeats a batch and no more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import batches, keyed, tables


def telemetry_windows(events: DataFrame, late: str = "1 hour", window: str = "1 day", ts: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """(window_start, by, n, total): counts and sums by window, for rows that are at most `late` late."""
    grouped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, window), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), by, "n", "total")


def first_of_each(events: DataFrame, key: str, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Rows whose key was not seen before within the watermark."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def append_chunks(stream: DataFrame, path: str, checkpoint: str, partition: str = "collection", most: int = 300) -> StreamingQuery:
    """Write rows as they come, by collection, in files of at most `most` rows, and stop when all that is there has been written.

    A task that fails is repeated with its files; nothing of a failed batch is seen by readers.
    """
    return stream.writeStream.format("parquet").partitionBy(partition).option("maxRecordsPerFile", most).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def keep_last(stream: DataFrame, keys: list[str], order: str, deleted: str, path: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Fold an append-only log into the last row of each key, in a table of key buckets (operators.keyed); a batch rewrites the buckets it touches.

    Batches have numbers, so one that is repeated after a failure is merged once; and were its number lost, it would change nothing.
    """

    def fold(batch: DataFrame, number: int) -> None:
        rows = batch.withColumnRenamed(deleted, keyed.GONE)
        if number == 0:
            keyed.create(rows.withColumn(keyed.GONE, F.coalesce(keyed.GONE, F.lit(False))), path, keys, order, buckets)
        else:
            keyed.merge(rows, path, keys, order, number)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_packed(stream: DataFrame, collection: str, document: str, size: str, path: str, checkpoint: str, most_rows: int = 300, most_bytes: int = 8_000_000) -> StreamingQuery:
    """Write chunks in batches of whole documents, as batches.packed packs them, to path/run=<n>; a batch that is repeated replaces its own folder.

    A document's chunks come in one micro-batch, as those of one file do.
    """

    def put(rows: DataFrame, number: int) -> None:
        named = batches.packed(rows, collection, document, size, most_rows, most_bytes).select(*(F.col(c).alias(f"__{c}") for c in (collection, document)), "batch")
        rows.join(named, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (collection, document)]).drop(f"__{collection}", f"__{document}").write.mode("overwrite").parquet(f"{path}/run={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(versions: DataFrame, deleted: str) -> DataFrame:
    """Without the rows that say that their key is gone."""
    return versions.filter(~F.coalesce(F.col(deleted), F.lit(False)))


def claimable(queue: DataFrame, now, most: int, stale_seconds: int = 300) -> DataFrame:
    """The oldest rows that wait, or whose claim is older than `stale_seconds`."""
    old = F.timestamp_diff("SECOND", F.col("claimed_at"), F.lit(now)) >= stale_seconds
    free = (F.col("status") == "waiting") | ((F.col("status") == "claimed") & F.coalesce(old, F.lit(False)))
    return queue.filter(free).orderBy("enqueued_at", "id").limit(most)


def settle(queue: DataFrame, results: DataFrame, most_tries: int = 3) -> DataFrame:
    """The queue after results (id, ok): done, or waiting again until too many tries have failed."""
    joined = queue.join(results, "id", "left")
    tries = F.when(F.col("ok") == F.lit(False), F.col("tries") + 1).otherwise(F.col("tries"))
    status = F.when(F.col("ok"), "done").when(F.col("ok") == F.lit(False), F.when(tries >= most_tries, "failed").otherwise("waiting")).otherwise(F.col("status"))
    return joined.select(*[status.alias("status") if c == "status" else tries.alias("tries") if c == "tries" else F.col(c) for c in queue.columns])


def replay(spark: SparkSession, path: str, schema: str, keys: list[str], order: str, deleted: str) -> DataFrame:
    """Batch form of `keep_last`, straight from JSON lines; lines that can't be read are left out."""
    lines = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return tables.last_writes(lines.filter("_bad IS NULL").drop("_bad"), keys, order, deleted)
