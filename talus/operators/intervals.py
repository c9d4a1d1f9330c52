"""Interval-overlap joins: spans meet in bins of several widths, by equal keys, and each pair once.

A span belongs to the narrowest level whose bins are as wide as it is; bins of neighbouring levels differ by BASE. It takes one or two bins there,
and one or two on every wider level that spans of the other side belong to. Two spans meet on the wider of their two levels, in the bin that holds
the larger of their starts, which both of them reach if they overlap. So no span is written to many bins however long it is, and one document with
any number of spans is as many groups as it has bins; a group grows only where that many spans cover one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BASE = 4
#: Levels: the widest bins have BASE ** MOST, more than any whole number of 64 bits.
MOST = 31


def level_of(start: Column, end: Column) -> Column:
    """The number of the narrowest bins that are as wide as the span."""
    return F.coalesce(*(F.when(end - start < BASE**n, n) for n in range(MOST)), F.lit(MOST)).cast("int")


def _bins(spans: DataFrame, keys: list[str], start: str, end: str, side: str, levels: list[int]) -> DataFrame:
    """(keys, level, bin, side): a span in the bins of its own level and of each wider one of `levels`."""
    own = level_of(F.col(start), F.col(end))
    row = F.struct(*(c for c in spans.columns if c not in keys))
    placed = spans.filter(F.col(start) <= F.col(end)).select(*keys, F.col(start).alias("__a"), F.col(end).alias("__b"), own.alias("__own"), row.alias(side))
    wanted = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda n: n >= F.col("__own"))
    each = placed.withColumn("level", F.explode(wanted)).withColumn("__width", F.pow(F.lit(float(BASE)), "level").cast("long"))
    bins = F.sequence(F.floor(F.expr("__a div __width") - F.when(F.expr("__a % __width < 0"), 1).otherwise(0)), F.floor(F.expr("__b div __width") - F.when(F.expr("__b % __width < 0"), 1).otherwise(0)))
    return each.withColumn("bin", F.explode(bins)).select(*keys, "level", "bin", F.col("__a").alias(f"{side}_start"), F.col("__b").alias(f"{side}_end"), F.col("__own").alias(f"{side}_level"), "__width", side)


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, a, b): all pairs of spans of equal keys that share a place, ends included, as structs of each side's other columns.

    Starts and ends are whole numbers. Spans that end before they start, and null bounds or keys, meet nothing; repeated rows are spans
    of their own.
    """
    levels = lambda df: df.filter(F.col(start) <= F.col(end)).select(level_of(F.col(start), F.col(end)).alias("n")).distinct()
    used = sorted(r["n"] for r in levels(a).union(levels(b)).distinct().collect())  # MOST at most
    if not used:
        used = [0]
    left, right = _bins(a, keys, start, end, "a", used), _bins(b, keys, start, end, "b", used).drop("__width")
    met = left.join(right, [*keys, "level", "bin"])
    first = F.greatest("a_start", "b_start")
    in_bin = (F.expr("bin * __width") <= first) & (first - F.expr("bin * __width") < F.col("__width"))
    overlap = (F.col("a_start") <= F.col("b_end")) & (F.col("b_start") <= F.col("a_end"))
    return met.filter(overlap & in_bin & (F.col("level") == F.greatest("a_level", "b_level"))).select(*keys, "a", "b")


def covered(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end, spans): runs of spans that touch or overlap, put together; one pass in the order of starts."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.filter(F.col(start) <= F.col(end)).withColumn("__new", F.when(F.col(start) <= reach, 0).otherwise(1))
    runs = marked.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(*keys, "__run").agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("spans")).drop("__run")
