"""Reading and merging keyed tables: paging, hydration, upserts, deletions and set differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import batches


def page(df: DataFrame, order: list[str], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows `offset` to `offset + limit` by `order`."""
    out = df.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out.limit(limit) if limit is not None else out


def page_with_more(df: DataFrame, order: list[str], limit: int, offset: int = 0) -> DataFrame:
    """A page with the column has_more: one row beyond the page is fetched to know."""
    got = page(df, order, limit + 1, offset)
    n = Window.orderBy(*order)  # limit + 1 rows
    numbered = got.withColumn("__n", F.row_number().over(n)).withColumn("has_more", F.count("*").over(n.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > limit)
    return numbered.filter(F.col("__n") <= limit).drop("__n")


def get_many(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows for the asked keys, in the asked order (`place`), with found = false where there is none. wanted: (place, key)."""
    return wanted.join(df.withColumn("__found", F.lit(True)), key, "left").withColumn("found", F.coalesce("__found", F.lit(False))).drop("__found")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], merged_maps: tuple[str, ...] = ()) -> DataFrame:
    """`old` with the rows of `new`: columns are replaced, maps named in `merged_maps` keep entries that the new one lacks."""
    a, b = old.alias("a"), new.alias("b")
    there = F.col(f"b.{keys[0]}").isNotNull()
    out = []
    for c in old.columns:
        if c in keys:
            out.append(F.coalesce(f"b.{c}", f"a.{c}").alias(c))
        elif c in merged_maps:
            x, y = F.coalesce(F.col(f"a.{c}"), F.create_map().cast(old.schema[c].dataType)), F.coalesce(F.col(f"b.{c}"), F.create_map().cast(old.schema[c].dataType))
            out.append(F.map_concat(_without(x, y), y).alias(c))
        else:
            out.append(F.when(there, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c))
    return a.join(b, keys_equal(keys), "full").select(*out)


def _without(x: Column, y: Column) -> Column:
    return F.map_filter(x, lambda k, _: ~F.map_contains_key(y, k))


def update(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Known keys only; null columns of `new` leave the old value."""
    a, b = old.alias("a"), new.alias("b")
    return a.join(b, keys_equal(keys), "left").select(*(F.col(f"a.{c}") if c in keys or c not in new.columns else F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in old.columns))


def delete(df: DataFrame, keys: DataFrame | None = None, on: list[str] | None = None, condition: Column | None = None) -> DataFrame:
    """Without the given keys, or without the rows that meet a condition."""
    if keys is None and condition is None:
        raise ValueError("nothing says what to delete")
    out = df.join(keys, on, "left_anti") if keys is not None else df
    return out.filter(~F.coalesce(condition, F.lit(False))) if condition is not None else out


def keys_equal(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    return out


def last_writes(log: DataFrame, keys: list[str], order: str, deleted: str) -> DataFrame:
    """The last row of each key of an append-only log, unless it says that the key is gone."""
    fields = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*fields), order).alias("__last")).select(*keys, "__last.*")
    return last.filter(~F.coalesce(deleted, F.lit(False))).drop(deleted)


def missing(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    return wanted.select(key).distinct().join(there.select(key), key, "left_anti")


def first_seen_union(parts: DataFrame, key: str, order: str, values: str) -> DataFrame:
    """Arrays of rows with the same key in one: each value once, where it was first seen."""
    seen = parts.select(key, order, F.posexplode(values).alias("__at", "__v")).groupBy(key, "__v").agg(F.min(F.struct(order, "__at")).alias("__first"))
    return seen.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__first", "__v"))), lambda s: s["__v"]).alias(values))


def line_cache(docs: DataFrame, key: str, text: str, weight: str, needle: str, most: int) -> DataFrame:
    """Lines that hold a fixed string, by falling weight of their document: key, line number, line, score 1 - i / n."""
    lines = docs.select(key, weight, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).filter(F.contains("line", F.lit(needle)))
    top = lines.orderBy(F.desc(weight), key, "line_no").limit(most)
    order = Window.orderBy(F.desc(weight), key, "line_no")  # `most` rows
    n = F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return top.withColumn("score", 1 - (F.row_number().over(order) - 1) / n)


def ranks(df: DataFrame, by: str, key: str, out: str) -> DataFrame:
    """`df` with the place of each row (from 1) by a number and then by key, over all rows."""
    return batches.running(df, [F.asc(by), F.asc(key)], {out: F.lit(1).cast("long")})
