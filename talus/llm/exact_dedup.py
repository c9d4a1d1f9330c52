"""Exact duplicates of whole texts by counting quotient filters.

Every partition builds a counting quotient filter over the 64-bit fingerprints of its texts: the leading bits of a
fingerprint name a block and a slot in it (the quotient), the sorted remainders of a slot form its run, kept in as few
bytes as they need, and remainders that occur more than once carry a count. Filters are shuffled by block, and those of a
block merge without loss by merging their sorted remainders and adding the counts. Only texts whose fingerprint has a
merged count above one are compared byte for byte, by grouping on the text itself: Spark combines equal texts inside each
map task, so a text that a third of all rows share is sent once a task.

The texts are read twice: for fingerprints and digests, which are written to the shared folder, and for the bytes of the
texts whose fingerprint occurs again. Up to BROADCAST_ROWS repeated fingerprints go to every task; more are met by a
shuffle.

Defined results: a null text counts as empty, and empty texts equal each other; a text of any length is compared whole. Of
equal texts the row with the largest doc_id stays; rows that repeat both doc_id and text carry equal results, and
`deduplicate` keeps one of them. A null doc_id ranks below all others. An empty table gives an empty result. Columns other
than doc_id and text, whatever their names, pass untouched through `deduplicate` and are ignored by `duplicate_groups`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, free_names

#: Fingerprints in a partition's filter, and in a merged block, about: 64 MB each with their counts.
FILTER_ROWS, BLOCK_ROWS = 2_000_000, 4_000_000
#: Repeated fingerprints that are sent to every task, and then the digests of their texts, some 10 MB; beyond that they are
#: joined by a shuffle, in which AQE splits the rows of a text that very many share.
BROADCAST_ROWS = 100_000

FILTER_SCHEMA = "block int, runs binary, remainders binary, places binary, counts binary"


def combine(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort values and add up the counts of equal ones."""
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, dtype=np.int64)
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


class Shape:
    """How the 64 bits of a fingerprint are dealt out: block, slot, remainder."""

    def __init__(self, rows: int) -> None:
        self.block_bits = max(1, (rows // BLOCK_ROWS).bit_length())
        self.slot_bits = max(0, (min(rows, FILTER_ROWS) >> self.block_bits).bit_length() - 1)
        self.remainder_bits = 64 - self.block_bits - self.slot_bits
        self.width = -(-self.remainder_bits // 8)

    def pack(self, block: int, values: np.ndarray, counts: np.ndarray) -> tuple:
        """A block of a filter, of sorted distinct fingerprints, as a row of FILTER_SCHEMA."""
        slots = (values >> np.uint64(self.remainder_bits)) & np.uint64(2**self.slot_bits - 1)
        runs = np.bincount(slots.astype(np.int64), minlength=2**self.slot_bits)
        remainders = (values & np.uint64(2**self.remainder_bits - 1)).view(np.uint8).reshape(-1, 8)[:, : self.width]
        places = np.flatnonzero(counts > 1)
        return block, runs.astype(np.uint8 if runs.max() < 256 else np.uint32).tobytes(), remainders.tobytes(), places.astype(np.uint32).tobytes(), counts[places].astype(np.int64).tobytes()

    def unpack(self, block: int, runs: bytes, remainders: bytes, places: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.frombuffer(runs, np.uint8 if len(runs) == 2**self.slot_bits else np.uint32)
        wide = np.zeros((len(remainders) // self.width, 8), np.uint8)
        wide[:, : self.width] = np.frombuffer(remainders, np.uint8).reshape(-1, self.width)
        slots = np.repeat(np.arange(2**self.slot_bits, dtype=np.uint64), lengths)
        top = np.uint64(block << (64 - self.block_bits))
        times = np.ones(len(wide), np.int64)
        times[np.frombuffer(places, np.uint32)] = np.frombuffer(counts, np.int64)
        return top | slots << np.uint64(self.remainder_bits) | wide.reshape(-1).view(np.uint64), times


def build_filters(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    """One counting quotient filter for the partition, a row for each block in use."""
    held, held_counts, waiting = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

    def settle() -> None:
        nonlocal held, held_counts
        new = np.concatenate(waiting) if waiting else np.zeros(0, np.uint64)
        waiting.clear()
        held, held_counts = combine(np.concatenate([held, new]), np.concatenate([held_counts, np.ones(len(new), np.int64)]))

    for batch in batches:
        waiting.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
        if sum(map(len, waiting)) > 1_000_000:
            settle()
    settle()
    used, starts = np.unique((held >> np.uint64(64 - shape.block_bits)).astype(np.int64), return_index=True)
    for block, a, b in zip(used.tolist(), starts, [*starts[1:], len(held)][: len(used)], strict=True):
        row = shape.pack(block, held[a:b], held_counts[a:b])
        kinds = (pa.int32(), *[pa.binary()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], [x.split()[0] for x in FILTER_SCHEMA.split(", ")])


def merge_filters(batches: Iterator[pa.RecordBatch], shape: Shape) -> Iterator[pa.RecordBatch]:
    """The fingerprints that occur more than once, from filters in the order of their blocks: one block is held at a time."""
    block, values, counts = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def repeated() -> pa.RecordBatch:
        often = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(values[often].view(np.int64)), pa.array(counts[often])], ["fp", "copies"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["block"] != block:
                yield repeated()
                block, values, counts = row["block"], np.zeros(0, np.uint64), np.zeros(0, np.int64)
            more, times = shape.unpack(*row.values())
            values, counts = combine(np.concatenate([values, more]), np.concatenate([counts, times]))
    yield repeated()


def repeated_fingerprints(prints: DataFrame) -> DataFrame:
    """(fp, copies) for each value of `fp` that more than one row has."""
    rows = prints.count()
    shape = Shape(rows)
    # Few large filters instead of many small ones; partitions are put together without a shuffle.
    filters = prints.select("fp").coalesce(max(8, rows // FILTER_ROWS + 1)).mapInArrow(lambda x: build_filters(x, shape), FILTER_SCHEMA)
    return filters.repartition("block").sortWithinPartitions("block").mapInArrow(lambda x: merge_filters(x, shape), "fp long, copies long")


def _groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp, text_sha256) of all rows, and (text_sha256, most, n) of the texts that more than one row has, marked for broadcasting if they are few."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("fp", F.xxhash64("text"))
    prints = cut(texts.select("doc_id", "fp", F.sha2("text", 256).alias("text_sha256")))
    repeated = cut(repeated_fingerprints(prints).select("fp"))
    sent = F.broadcast if repeated.count() <= BROADCAST_ROWS else lambda df: df
    candidates = texts.join(sent(repeated), "fp", "left_semi")
    groups = candidates.groupBy("fp", "text").agg(F.max("doc_id").alias("most"), F.count("*").alias("n"))
    return prints, sent(groups.select(F.sha2("text", 256).alias("text_sha256"), "most", "n"))


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256."""
    prints, groups = _groups(docs)
    whole = prints.drop("fp").join(groups, "text_sha256", "left")
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("most"))
    return whole.select("doc_id", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns.

    Rows of texts that come once stay where they are, as those of repeated ones are known; of a repeated text's rows, only those that may
    stay are shuffled.
    """
    sha, most, n, place = free_names(docs, "__sha", "__most", "__n", "__nth")
    groups = cut(_groups(docs)[1].select(F.col("text_sha256").alias(sha), F.col("most").alias(most), F.col("n").alias(n)))
    keyed = docs.withColumn(sha, F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    many = groups.count() > BROADCAST_ROWS
    groups = groups if many else F.broadcast(groups)
    alone = keyed.join(groups, sha, "left_anti").select(*docs.columns)
    nth = F.row_number().over(Window.partitionBy(sha).orderBy("doc_id"))
    first = keyed.join(groups, sha).filter(F.col("doc_id").eqNullSafe(F.col(most))).withColumn(place, nth).filter(F.col(place) == 1)
    return alone.unionByName(first.select(*docs.columns))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
