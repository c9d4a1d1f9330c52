"""Mixing sources to target weights.

Every document gets a hash-random key (md5 of a seed, its doc_id and its text's md5). Within each source the documents stand in the
order of their keys; the order is cut into ranges by the leading digits of the key, so that a source of any size is
spread over many tasks. Prefix sums of sizes come in two steps: over the range totals of a source (4096 at most), then
inside each range. A source takes each document `floor(target / size)` whole times and, in one more epoch, the documents
up to its exact budget; the document on the cut gives its first words.

Targets fill up evenly: each source gets level * weight, at most `MAX_EPOCHS` times its size, where the level is the one
that shares out all words.

Defined results: a null or blank text has size zero and gives nothing; a text of any length is counted whole. A null
source is a source of its own and comes last. Rows have equal keys only if they repeat doc_id and text, and so are alike;
each is a row of its own, they are cut one after the other, and reruns agree. A null doc_id is a doc_id like any other. An
empty table gives an empty result. Columns other than doc_id, text and source, whatever their names, are ignored by `mix`
and pass untouched through `mixture`. Sources are few: a table of one row for each is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, cut

MAX_EPOCHS = 3
WEIGHTS = (1, 2, 3)
#: Hexadecimal digits of the key that name a range: 16**3 = 4096 ranges a source.
RANGE_DIGITS = 3
SEED = "mix-1:"


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def key_of(seed: str = SEED) -> Column:
    """A hash-random key of doc_id and text: equal for rows that repeat both."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))).cast("binary"))


def sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, key)."""
    return docs.select("doc_id", "source", size_of().alias("size"), key_of(seed).alias("key"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) for each source.

    Sources fill up in the order of size / weight. The first source that stays below its limit sets the level for itself
    and all after it: what the full ones leave, by weight.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row for each source from here on.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int")).cast("long"))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - max_epochs * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = left.cast("double") / F.sum("weight").over(after)
    levelled = weighed.withColumn("level", level)
    first_open = F.min(F.when(F.col("level") * F.col("weight") <= max_epochs * F.col("source_size"), F.struct(F.col("source_size") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    return levelled.select("source", "source_size", F.least(first_open * F.col("weight"), (max_epochs * F.col("source_size")).cast("double")).alias("target"))


def _offsets(sized: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """(__s, __r, offset, source_size, target): what stands before each range of a source, its name in a struct, where nulls are equal. sized: (source, size, key)."""
    goal = targets(sized, weights, max_epochs).select(F.struct("source").alias("__s"), "source_size", "target")
    sums = sized.groupBy(F.struct("source").alias("__s"), F.substring("key", 1, RANGE_DIGITS).alias("__r")).agg(F.sum("size").alias("range_size"))
    earlier = Window.partitionBy("__s").orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("range_size").over(earlier), F.lit(0)))
    return offsets.join(goal, "__s").select("__s", "__r", "offset", "source_size", "target")


def _taken(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """`rows` (source, size, key and anything else) with source_size, target, copies (times taken whole) and part (words of one more copy).

    The window and the join share one shuffle of the rows.
    """
    inside = Window.partitionBy("__s", "__r").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("__s", F.struct("source")).withColumn("__r", F.substring("key", 1, RANGE_DIGITS)).withColumn("__inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(offsets, ["__s", "__r"])
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor(F.col("target") - F.col("copies") * F.col("source_size"))
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("offset") - F.col("__inside"))).cast("long")
    return placed.withColumn("copies", copies).withColumn("part", part)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, taken, copies (times taken whole), part (words taken of one more copy)."""
    sized = cut(sizes(docs))  # read three times below
    placed = _taken(sized, _offsets(sized, weights, max_epochs))
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"), "copies", "part")


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: each document's row as often as it is taken, the one on a cut whole; all columns as they came.

    Rows go through the ranges with all their columns, so that each has its own place, also among rows that repeat.
    """
    offsets = _offsets(cut(sizes(docs).select("source", "size", "key")), weights, max_epochs)
    rows = docs.select("source", size_of().alias("size"), key_of().alias("key"), F.struct(*docs.columns).alias("row"))
    times = F.col("copies") + (F.col("part") > 0).cast("long")
    placed = _taken(rows, offsets).select("row", times.cast("int").alias("n")).filter("n > 0")
    return placed.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


ORACLE = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM totals),
levelled AS (
  SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
            / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER o AS place
  FROM weighed WINDOW o AS (ORDER BY source_size / weight, source ASC NULLS LAST)),
goal AS (
  SELECT source, source_size, least((SELECT level FROM levelled WHERE level * weight <= 3 * source_size ORDER BY place LIMIT 1) * weight,
                                    CAST(3 * source_size AS DOUBLE)) AS target FROM levelled),
placed AS (
  SELECT s.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN CAST(floor(g.target / g.source_size) AS BIGINT) ELSE 0 END AS copies,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, source, size, source_size, target,
       CAST(copies * size + least(size, greatest(0, floor(target - copies * source_size) - before)) AS BIGINT) AS taken,
       copies, CAST(least(size, greatest(0, floor(target - copies * source_size) - before)) AS BIGINT) AS part
FROM placed
"""
