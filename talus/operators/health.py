"""One row of health facts for each collection, and orders of such reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import catalog

#: Topics that count as a collection's hubs.
TOP_HUBS = 10
FACTS = ("chunk_count", "last_indexed", "zero_hit_rate", "median_query_distance", "cross_projection_rank", "orphans", "stale_ratio", "hub_domination", "hash_coverage")
#: Columns that a report is sorted by from the smallest; the others go from the largest.
RISING = ("collection", "last_indexed")


def projection_ranks(assignments: DataFrame) -> DataFrame:
    """(collection, cross_projection_rank): places by the number of other collections whose chunks were assigned to a collection's topics, from 1; ties share a place.

    assignments: (source_collection, topic_collection, ...)
    """
    foreign = assignments.filter(F.col("source_collection") != F.col("topic_collection"))
    counts = foreign.groupBy(F.col("topic_collection").alias("collection")).agg(F.countDistinct("source_collection").alias("__n"))
    return counts.select("collection", F.rank().over(Window.orderBy(F.desc("__n"))).cast("long").alias("cross_projection_rank"))  # a row for each collection


def hub_domination(assignments: DataFrame, first: int = TOP_HUBS) -> DataFrame:
    """(collection, hub_domination): the share of a collection's assignments that its `first` largest topics have."""
    sizes = assignments.groupBy(F.col("source_collection").alias("collection"), "topic_id").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("collection").orderBy(F.desc("n"), "topic_id"))
    return sizes.withColumn("__place", place).groupBy("collection").agg((F.sum(F.when(F.col("__place") <= first, F.col("n")).otherwise(0)) / F.sum("n")).alias("hub_domination"))


def report(docs: DataFrame, edges: DataFrame, chunks: DataFrame, searches: DataFrame, assignments: DataFrame, hashes: DataFrame, stale_before) -> DataFrame:
    """(collection, FACTS...) of every collection that has documents or chunks.

    chunks: a row for each stored chunk, whose number counts, not the catalog's; searches: (collection, zero_hit_rate, median_top_distance);
    hashes: a row for each registered hash of a collection. What isn't known is null: no searches, no assignments, no dated document, and
    coverage without chunks or without any hash.
    """
    health = catalog.health(docs, edges, stale_before).select("collection", "last_indexed", "orphans", "stale_ratio")
    counts = chunks.groupBy("collection").agg(F.count("*").alias("chunk_count"))
    registered = hashes.groupBy("collection").agg(F.count("*").alias("__hashes"))
    named = docs.select("collection").unionByName(chunks.select("collection")).filter("collection IS NOT NULL").distinct()
    asked = searches.select("collection", "zero_hit_rate", F.col("median_top_distance").alias("median_query_distance"))
    parts = [health, counts, registered, asked, projection_ranks(assignments), hub_domination(assignments)]
    whole = reduce(lambda a, b: a.join(b, "collection", "left"), parts, named)
    coverage = F.when((F.col("chunk_count") > 0) & F.col("__hashes").isNotNull(), catalog.coverage_ratio(F.col("__hashes"), F.col("chunk_count")))
    filled = whole.withColumns({"hash_coverage": coverage, "chunk_count": F.coalesce("chunk_count", F.lit(0)), "orphans": F.coalesce("orphans", F.lit(0))})
    return filled.select("collection", *FACTS)


def ordered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """A report by several columns: names and dates rising, numbers falling, nulls last in each; ties by collection."""
    for c in columns:
        if c not in ("collection", *FACTS):
            raise ValueError(f"no fact {c!r}")
    return rows.orderBy(*(F.asc_nulls_last(c) if c in RISING else F.desc_nulls_last(c) for c in columns), "collection")
