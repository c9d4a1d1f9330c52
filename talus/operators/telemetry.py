"""Reports over search, answer and routing logs, and use over time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores

# Upper bounds of the latency buckets, in milliseconds.
LATENCY = ((5_000, "0-5s"), (30_000, "5-30s"), (120_000, "30s-2m"), (300_000, "2-5m"))


def search_stats(log: DataFrame, since: dt.datetime) -> DataFrame:
    """(collection, searches, zero_hit_rate, median_top_distance) of (ts, collection, kept_count, top_distance)."""
    return log.filter(F.col("ts") >= F.lit(since)).groupBy("collection").agg(F.count("*").alias("searches"), F.avg((F.col("kept_count") == 0).cast("double")).alias("zero_hit_rate"), F.expr("percentile(top_distance, 0.5)").alias("median_top_distance"))


def distance_histogram(distances: DataFrame, keys: list[str], distance: str = "distance") -> DataFrame:
    """(keys, bucket 0 to 9, n): ten buckets over 0 to 2; what lies outside goes to the ends."""
    bucket = F.least(F.lit(9), F.greatest(F.lit(0), F.floor(F.col(distance) / 0.2))).cast("long")
    return distances.withColumn("bucket", bucket).groupBy(*keys, "bucket").agg(F.count("*").alias("n"))


def latency_buckets(runs: DataFrame, duration: str, ok: str) -> DataFrame:
    """(bucket, runs, succeeded, failed)."""
    name = F.lit("over 5m")
    for bound, label in reversed(LATENCY):
        name = F.when(F.col(duration) < bound, label).otherwise(name)
    return runs.withColumn("bucket", name).groupBy("bucket").agg(F.count("*").alias("runs"), F.count_if(F.col(ok)).alias("succeeded"), F.count_if(~F.col(ok)).alias("failed"))


def step_breakdown(steps: DataFrame, keys: list[str], cost: str = "cost_usd") -> DataFrame:
    """(keys, steps, priced, unpriced, total, median): unknown costs are counted, not summed."""
    return steps.groupBy(*keys).agg(F.count("*").alias("steps"), F.count(cost).alias("priced"), F.count_if(F.col(cost).isNull()).alias("unpriced"), F.sum(cost).alias("total"), F.expr(f"percentile({cost}, 0.5)").alias("median"))


def cost_mismatch(runs: DataFrame, steps: DataFrame, key: str, tolerance: float = 1e-6) -> DataFrame:
    """(key, run_cost, steps_cost) of runs whose cost is not the sum of their steps' known costs."""
    sums = steps.groupBy(key).agg(F.sum("cost_usd").alias("steps_cost"))
    return runs.join(sums, key).filter(F.abs(F.col("cost_usd") - F.col("steps_cost")) > tolerance).select(key, F.col("cost_usd").alias("run_cost"), "steps_cost")


def routing_stats(log: DataFrame, rule: str, outcome: str) -> DataFrame:
    """(rule, total, block_rate, escape_rate), rounded to 4 places."""
    total = F.count("*")
    return log.groupBy(rule).agg(total.alias("total"), F.round(F.count_if(F.col(outcome).isin("deny", "fail_closed")) / total, 4).alias("block_rate"), F.round(F.count_if(F.col(outcome) == "escape") / total, 4).alias("escape_rate"))


def frecency(uses: DataFrame, key: str, ts: str, now: dt.datetime, rate: float = scores.DECAY) -> DataFrame:
    """(key, frecency): sum of exp(-rate * days) over all uses; uses in the future count as today's."""
    days = F.timestamp_diff("SECOND", F.col(ts), F.lit(now)) / 86400
    return uses.groupBy(key).agg(F.sum(scores.decayed(days, rate)).alias("frecency"))


def grounding(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, citations, hashed, coverage): citations in brackets, those that name a chunk hash, and their share."""
    all_ = F.regexp_extract_all(F.col(text), F.lit(r"\[([^\[\]]+)\]\([^()]*\)"), 0)
    counted = docs.select(key, F.size(all_).cast("long").alias("citations"), F.size(F.filter(all_, lambda c: F.contains(c, F.lit("(chash:")))).cast("long").alias("hashed"))
    return counted.withColumn("coverage", F.when(F.col("citations") > 0, F.col("hashed") / F.col("citations")).otherwise(F.lit(0.0)))
