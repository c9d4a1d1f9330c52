"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints link when at most `RADIUS` = 3 bits differ. The bits fall into three blocks of 21 or 22. Some
block holds at least one of the differing bits, so without it the other 42 or 43 bits differ in two places at most, and
there the two balls of half that radius, one bit, meet: every distinct fingerprint emits, for each block left out, all
variants of the rest within one bit (132 rows), the rows are shuffled by variant, and fingerprints that meet are
compared on the block that was left out. In a bucket (block left out, variant) any two members differ by two bits at
most outside the block, hence
  * members with equal blocks link at once, to the smallest one;
  * blocks one bit apart link, their smallest members standing for them: 1 + 2 bits;
  * members whose own rest is the variant (0 bits there) link up to three bits apart in the block, found by the same
    meeting of balls of one and two bits inside the block.
Links always go to one member of a bucket, never to all pairs, so the rows grow with the members and no link between
components is lost. Each link is verified on the full fingerprints. Components come from alternating stars.

Defined results: A-Z are lower-cased; words are runs of anything but blank and U+0009 to U+000D; shingles have three
words and count as often as they occur; a shorter text is one shingle; a null, empty or blank text has fingerprint zero
and links like any other. A text of any length is fingerprinted whole. Rows that repeat, also in doc_id alone, give a row
each. Null doc_ids take part in links but name no component unless they are alone, when component_id is null. An empty
table gives an empty result; other columns, whatever their names, are ignored, and pass untouched through keep_one_of_each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, cut, free_names, words
from .components import connected_components

RADIUS = 3
#: Documents that go, up to which they are sent to every task.
BROADCAST_ROWS = 100_000
SHINGLE = 3
#: Bits of the three blocks.
BLOCKS = (tuple(range(0, 22)), tuple(range(22, 43)), tuple(range(43, 64)))


def _long(bits: int) -> int:
    """The signed 64-bit number with these bits."""
    return bits - 2**64 if bits >= 2**63 else bits


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def shingle_hashes(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, hashes): XXH64, seed 42, of every shingle of a text."""
    split = docs.select("doc_id", words(ascii_lower(F.col("text"))).alias("w"))
    many = F.transform(F.sequence(F.lit(1), F.size("w") - (size - 1)), lambda i: F.xxhash64(F.concat_ws(" ", F.slice("w", i, size))))
    one = F.array(F.xxhash64(F.concat_ws(" ", "w")))
    none = F.array().cast("array<bigint>")
    return split.select("doc_id", F.when(F.size("w") >= size, many).when(F.size("w") > 0, one).otherwise(none).alias("hashes"))


def simhash(hashes: np.ndarray) -> int:
    """Bit j is 1 if it is set in more than half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.ascontiguousarray(hashes[at : at + 65536], dtype="<i8")
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _simhashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("hashes")
        values, edges = lists.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
        prints = [simhash(values[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp long) for each document."""
    return shingle_hashes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(_simhashes, "doc_id long, fp long")


def _constants(names: str, rows: list[tuple[int, ...]]) -> Column:
    """A constant array of structs of longs, given as one SQL text: quick to build even for hundreds of rows."""
    return F.expr("array(" + ", ".join("struct(" + ", ".join(f"{value}L AS {name}" for name, value in zip(names.split(), row, strict=True)) + ")" for row in rows) + ")")


def ball_variants(nodes: DataFrame) -> DataFrame:
    """(z, rest): for each block k left out, all values z of the other bits within one bit of `fp`'s.

    `rest` holds what z lacks in one number: k, the bit that differs (0: none, else its place + 1), and the block.
    """
    rows = [(k, at + 1) for k, block in enumerate(BLOCKS) for at in (-1, *(b for b in range(64) if b not in block))]
    masks = [(_long(~_mask(BLOCKS[k]) & 2**64 - 1), 0 if not at else _long(1 << at - 1), BLOCKS[k][0], k << 29 | at << 22) for k, at in rows]
    out = nodes.select("fp", F.explode(_constants("keep flip low head", masks)).alias("x"))
    z = F.col("fp").bitwiseAND(F.col("x.keep")).bitwiseXOR(F.col("x.flip"))
    block = F.expr("shiftrightunsigned(fp, cast(x.low as int))").bitwiseAND(F.lit(2**22 - 1)).bitwiseAND(F.when(F.col("x.low") == 0, 2**22 - 1).otherwise(2**21 - 1))
    return out.select(z.alias("z"), F.col("x.head").bitwiseOR(block).cast("int").alias("rest"))


def whole(variants: DataFrame) -> DataFrame:
    """(k, z, fp, block, own) of (z, rest); own: z is the fingerprint's own value."""
    at = F.shiftright("rest", 22).bitwiseAND(F.lit(127))
    parts = variants.select("z", F.shiftright("rest", 29).alias("k"), at.alias("at"), F.col("rest").bitwiseAND(F.lit(2**22 - 1)).cast("long").alias("low"))
    parts = parts.select("k", "z", "at", F.expr(f"shiftleft(low, element_at(array({', '.join(str(b[0]) for b in BLOCKS)}), k + 1))").alias("block"))
    flip = F.when(F.col("at") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, at - 1)"))
    return parts.select("k", "z", F.col("z").bitwiseXOR(flip).bitwiseOR(F.col("block")).alias("fp"), "block", (F.col("at") == 0).alias("own"))


def _inner_ball(k: int, radius: int) -> Column:
    block = BLOCKS[k]
    flips = [(0, 0), *((1 << a, 1) for a in block)]
    if radius > 1:
        flips += [(1 << a | 1 << b, 2) for a in block for b in block if a < b]
    return _constants("flip n", [(_long(f), n) for f, n in flips])


def near_links(nodes: DataFrame) -> DataFrame:
    """(a, b) of fingerprints at most RADIUS bits apart; as many as join all that can be reached from each other."""
    # Everything below a bucket follows from the one exchange by z.
    partitions = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = Window.partitionBy("z", "k")
    met = whole(ball_variants(nodes.repartition(partitions, "fp")).repartition("z"))
    low, high = (f(F.when(F.col("own"), F.col("fp"))).over(bucket) for f in (F.min, F.max))
    met = met.select("*", (F.min("fp").over(bucket) != F.max("fp").over(bucket)).alias("many"), (F.min("block").over(bucket) != F.max("block").over(bucket)).alias("blocks"), (low != high).alias("owners"))
    met = cut(met.filter("many").select("k", "z", "fp", "block", "own", "blocks", F.coalesce("owners", F.lit(False)).alias("owners")))
    same = met.groupBy("k", "z", "block").agg(F.min("fp").alias("low"), F.max("blocks").alias("blocks"))
    equal = met.join(same.drop("blocks"), ["k", "z", "block"]).select(F.col("fp").alias("a"), F.col("low").alias("b"))

    def within(members: DataFrame, radius: int) -> DataFrame:
        """Meet inside the block: whatever reaches a point in `radius` bits links to the smallest that reaches it in radius - 1."""
        balls = None
        for k in range(len(BLOCKS)):
            part = members.filter(F.col("k") == k).select("k", "z", "fp", F.col("block"), F.explode(_inner_ball(k, radius)).alias("x"))
            balls = part if balls is None else balls.unionByName(part)
        balls = balls.select("k", "z", F.col("block").bitwiseXOR(F.col("x.flip")).alias("point"), "fp", (F.col("x.n") < radius).alias("inner"))
        lows = balls.filter("inner").groupBy("k", "z", "point").agg(F.min("fp").alias("low"))
        return balls.join(lows, ["k", "z", "point"]).select(F.col("fp").alias("a"), F.col("low").alias("b"))

    near = within(same.filter("blocks").select("k", "z", F.col("low").alias("fp"), "block"), 1)
    far = within(met.filter("own and owners").select("k", "z", "fp", "block"), 2)
    links = equal.unionByName(near).unionByName(far).filter("a <> b").distinct()
    return links.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, fingerprint (16 hex digits), component_id."""
    prints = cut(fingerprints(docs))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    parts = connected_components(near_links(nodes.select("fp")))
    named = nodes.join(parts, nodes["fp"] == parts["node"], "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    by_print = named.join(lows, "component").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with the smallest doc_id of their component, with all their columns; rows that repeat a doc_id go together.

    Rows whose doc_id is also that of another fingerprint stay if one of them does. What goes is sent to the rows where it is little.
    """
    (mine,) = free_names(docs, "__id")
    identity = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    judged = near_duplicates(docs).groupBy(identity.alias(mine)).agg(F.bool_or(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))
    goes = cut(judged.filter(~F.col("stays")).select(mine))
    sent = F.broadcast if goes.count() <= BROADCAST_ROWS else lambda df: df
    return docs.withColumn(mine, identity).join(sent(goes), mine, "left_anti").select(*docs.columns)
