"""Document fingerprints by winnowing, as SQL expressions.

A text's words (A-Z lower-cased) give one hash for each run of `GRAM` = 5 words. In every window of `WINDOW` = 8 hashes in a
row the smallest is chosen, the rightmost of equal ones, with its position. Two texts that share a passage of
GRAM + WINDOW - 1 = 12 words share a chosen hash. Likeness is the Jaccard index of two texts' chosen hashes.

Defined results: a text of fewer than five words is one run; fewer than eight hashes are one window; a null, empty or
blank text has no hashes and an empty fingerprint; a text of any length is fingerprinted whole. Two empty fingerprints have
likeness 1, an empty and another 0. Equal texts have equal fingerprints. For `with_next`, null doc_ids come last, rows with
equal doc_ids stand in the order of their texts' XXH64 and then of their texts, so that any number of them can be spread
out; rows that repeat both come one after the other; a single row is its own next. An empty table gives an empty result;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, cut, words

GRAM = 5
WINDOW = 8
#: Documents in a range, and the fan of the two levels of quantiles that cut ranges: FAN**2 = 262,144 of them, at 50 billion
#: documents some 200,000 each. Bounds of the second level take 2 MB. Heads of ranges are broadcast up to BROADCAST_ROWS, some 25 MB, else joined.
RANGE_ROWS, FAN, BROADCAST_ROWS = 250, 512, 300_000


def winnow(df: DataFrame, text: str, out: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """`df` with the column `out`: array<struct<h bigint, p int>>, chosen hashes with minus their position (from 1)."""
    split = df.withColumn("__w", words(ascii_lower(F.col(text))))
    none = F.array().cast("array<struct<h:bigint,p:int>>")

    def hashed(i: Column) -> Column:
        return F.struct(F.xxhash64(F.concat_ws(" ", F.slice("__w", i, gram))).alias("h"), (-i).alias("p"))

    grams = F.when(F.size("__w") > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size("__w") - (gram - 1), F.lit(1))), hashed)).otherwise(none)
    # Within a window, the smallest hash and of equal ones the one with the smallest -position.
    lows = F.when(F.size("__g") > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size("__g") - (window - 1), F.lit(1))), lambda i: F.array_min(F.slice("__g", i, window)))).otherwise(none)
    # Chosen positions never fall from window to window: equal ones are neighbours.
    chosen = F.filter("__m", lambda x, i: (i == 0) | (x["p"] != F.get("__m", i - 1)["p"]))
    return split.withColumn("__g", grams).withColumn("__m", lows).withColumn(out, chosen).drop("__w", "__g", "__m")


def spelled(prints: str) -> Column:
    """hash:position, ... with hashes in hexadecimal."""
    return F.array_join(F.transform(prints, lambda x: F.concat(F.lower(F.hex(x["h"])), F.lit(":"), (-x["p"]).cast("string"))), ",")


def hashes(prints: str) -> Column:
    return F.array_distinct(F.transform(prints, lambda x: x["h"]))


def likeness(a: str, b: str) -> Column:
    """Jaccard index of two arrays of distinct hashes."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total == 0, F.lit(1.0)).otherwise(shared / total)


def _quantiles(key: str, fan: int) -> Column:
    """Inner quantiles of a column by `fan`; no row is dealt with unevenly by more than a tenth of a part."""
    return F.percentile_approx(key, [i / fan for i in range(1, fan)], max(10_000, 10 * fan)) if fan > 1 else F.array().cast("array<bigint>")


def _place(key: str, bounds: Column) -> Column:
    """How many of the bounds a key has reached; a bound that comes more than once has its key's rows to itself."""
    reached = F.size(F.filter(F.array_distinct(bounds), lambda b: b <= F.col(key)))
    again = F.filter(bounds, lambda b, i: (i > 0) & (b == F.get(bounds, i - 1)))
    return reached + F.size(F.filter(F.array_distinct(again), lambda b: b < F.col(key)))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, down, tie, range, ahead): each document in its range, and the first document of the range below again, marked `ahead`.

    Documents stand by falling doc_id (rising `down`), then by rising `tie`. Ranges are cut at quantiles of the doc_ids,
    counted in two steps: over all rows, then in each part. A doc_id with many rows is alone in its range, which is cut by
    the hashes of the texts. A table of each range's first document says which ones go to the range above too.
    """
    down = F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    ids = docs.select(down.alias("down"))
    rows = ids.count()
    fan = min(FAN, math.ceil(math.sqrt(rows / RANGE_ROWS)) or 1)
    first = F.lit(ids.agg(_quantiles("down", fan)).first()[0] or []).cast("array<bigint>")
    parts = ids.withColumn("one", _place("down", first))
    bounds = F.broadcast(cut(parts.groupBy("one").agg(_quantiles("down", fan).alias("bounds"))))  # 2 * fan rows at most
    ranged = parts.join(bounds, "one").groupBy("one", _place("down", F.col("bounds")).alias("two")).agg(F.count("*").alias("n"), (F.min("down") == F.max("down")).alias("single"))
    splits = cut(ranged.filter(F.col("single") & (F.col("n") > 2 * RANGE_ROWS)).select("one", "two", F.ceil(F.col("n") / RANGE_ROWS).alias("splits")))
    ranges = fan * fan + (splits.agg(F.sum("splits")).first()[0] or 0)  # at most
    splits = F.broadcast(splits)  # no more than fan * fan
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), down.alias("down")).withColumn("tie", F.xxhash64("text")).withColumn("one", _place("down", first))
    keyed = keyed.join(bounds, "one").withColumn("two", _place("down", F.col("bounds"))).join(splits, ["one", "two"], "left")
    # The hash as a number from 0 to 2**31 - 1, in the same order, times the splits.
    third = F.shiftright(F.shiftrightunsigned(F.col("tie").bitwiseXOR(F.lit(-(2**63))), 33) * F.coalesce("splits", F.lit(1)), 31)
    keyed = keyed.select("doc_id", "text", "down", "tie", F.struct("one", "two", third.alias("three")).alias("range"))
    heads = cut(keyed.groupBy("range").agg(F.min(F.struct("down", "tie")).alias("head")))
    # The range above each one: inside a part by a window, at a part's first range the last one of the part above, at the very first the last of all.
    lasts = heads.groupBy("range.one").agg(F.max("range").alias("last"))  # fan rows
    parts_in_order = Window.orderBy("one")
    everything = parts_in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    above = lasts.select("one", F.coalesce(F.lag("last").over(parts_in_order), F.max("last").over(everything)).alias("above"))
    inside = Window.partitionBy("range.one").orderBy("range")
    placed = heads.select("head.*", F.col("range.one").alias("one"), F.lag("range").over(inside).alias("before")).join(F.broadcast(above), "one")
    heads = placed.select("down", "tie", F.coalesce("before", "above").alias("to"))
    both = keyed.join(F.broadcast(heads) if ranges <= BROADCAST_ROWS else heads, ["down", "tie"], "left")
    own = F.struct("range", F.lit(False).alias("ahead"))
    places = F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("to").alias("range"), F.lit(True).alias("ahead"))))
    return both.select("doc_id", "down", "tie", "text", F.explode(places).alias("x")).select("doc_id", "down", "tie", "text", "x.range", "x.ahead")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness and that to the next document's.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next
    document, by falling doc_id; the last document's next is the first.
    """
    # All that follows reuses this one exchange.
    placed = winnow(with_next(docs).repartition("range"), "text", "fp").withColumn("own", hashes("fp"))
    order = Window.partitionBy("range").orderBy("ahead", "down", "tie", "text")
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = placed.select("doc_id", "ahead", n.cast("long").alias("n_chars"), "fp", "own", F.lead("own").over(order).alias("next"), F.concat(F.substr("text", F.lit(1), n - cut), F.substr(F.lead("text").over(order), F.lit(1), cut)).alias("edited"))
    edited = winnow(edited.filter(~F.col("ahead")), "edited", "edited_fp").withColumn("other", hashes("edited_fp"))
    return edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), spelled("fp").alias("fingerprint"), spelled("edited_fp").alias("edited_fingerprint"), likeness("own", "other").alias("near_edited"), likeness("own", "next").alias("near_next"))
