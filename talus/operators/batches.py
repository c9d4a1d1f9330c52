"""Running totals over any order, and what is cut by them: a cache of so many bytes, and batches of whole documents under two budgets."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import lineage

#: Documents and rows of a stretch that one task packs; at its end a batch may stay small.
STRETCH = 200_000


def running(df: DataFrame, order: list[Column], totals: dict[str, Column], by: list[str] = ()) -> DataFrame:
    """`df` with the sums of `totals` over all rows up to each one in `order`, for each group of `by`; the order has no ties.

    In two steps: rows are dealt by ranges of the order, summed in each range, and shifted by what the ranges before hold.
    So no group is ever in one task, and every task has a range of about the same number of rows.
    """
    placed = lineage.cut(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by], *order).withColumn("__part", F.spark_partition_id()))
    keys = [*by, "__part"]
    sums = placed.groupBy(*keys).agg(*(F.sum(v).alias(f"__{c}") for c, v in totals.items()))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shifts = sums.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in totals))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    here = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = placed.withColumns({f"__in_{c}": F.sum(v).over(here) for c, v in totals.items()})
    out = inside.join(shifts, same)
    return out.select(*df.columns, *((F.col(f"__in_{c}") + F.col(f"__{c}")).alias(c) for c in totals))


def cached(docs: DataFrame, weight: str, key: str, text: str, most: int = 500_000_000) -> DataFrame:
    """(key, weight, bytes): the documents that a line cache of about `most` bytes holds.

    By falling weight and then by key, whole documents, until the cap is reached; the one that reaches it is the last. A document takes
    its lines' bytes, and for each line the key, the number, two colons and a line feed. Those without a text take nothing and are left out.
    """
    lines = F.split(F.regexp_replace(F.col(text), r"\r\n?", "\n"), "\n")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    own = F.octet_length(F.col(key).cast("string"))
    size = F.aggregate(F.transform(lines, lambda x, i: F.octet_length(x) + own + F.octet_length((i + 1).cast("string")) + 3), F.lit(0).cast("bigint"), lambda s, x: s + x)
    sized = docs.filter(F.col(text) != "").select(key, weight, size.alias("bytes"))
    return running(sized, [F.desc_nulls_last(weight), F.asc(key)], {"__upto": F.col("bytes")}).filter(F.col("__upto") - F.col("bytes") < most).select(key, weight, "bytes")


def greedy(rows: Iterable[int], sizes: Iterable[int], most_rows: int, most_bytes: int) -> list[int]:
    """The batch of each document in order: a document opens a new one where it would break a budget; one that breaks it alone is alone."""
    out, batch, n, b = [], -1, 0, 0
    for r, s in zip(rows, sizes, strict=True):
        if batch < 0 or n + r > most_rows or b + s > most_bytes:
            batch, n, b = batch + 1, 0, 0
        n, b = n + r, b + s
        out.append(batch)
    return out


def packed(chunks: DataFrame, collection: str, document: str, size: str, most_rows: int = 300, most_bytes: int = 8_000_000) -> DataFrame:
    """(collection, document, rows, bytes, batch): batches of whole documents, by rising document in each collection.

    chunks: a row for each chunk. A batch has `most_rows` chunks and `most_bytes` bytes at most, unless one document alone has more. Batches are
    packed in stretches that are cut by running totals of chunks and documents, so that their names, collection/stretch/number, are the
    same whenever the same chunks come, in whatever partitions. A null collection is written as such, and null sizes count 0.
    """
    docs = chunks.groupBy(collection, document).agg(F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))
    placed = running(docs, [F.asc_nulls_first(document)], {"__upto": F.col("rows") + 1}, [collection])
    stretches = placed.withColumn("__stretch", F.floor((F.col("__upto") - F.col("rows") - 1) / STRETCH).cast("long"))
    kept = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("batch", T.StringType())])

    def pack(stretch: pa.Table) -> pa.Table:
        stretch = stretch.sort_by([(document, "ascending")])
        found = greedy(stretch["rows"].to_pylist(), stretch["bytes"].to_pylist(), most_rows, most_bytes)
        lead = f"{stretch[collection][0].as_py()}/{stretch['__stretch'][0].as_py()}"
        return stretch.select(kept).append_column("batch", pa.array([f"{lead}/{i}" for i in found]))

    return stretches.drop("__upto").groupBy(collection, "__stretch").applyInArrow(pack, schema)


def write_batches(chunks: DataFrame, batches: DataFrame, collection: str, document: str, write: Callable[[str, pa.Table], None]) -> DataFrame:
    """(batch, document, ok, error, writes) of each document, after `write(batch, rows)` in the tasks.

    A batch that fails is cut in half between documents, and again, until what fails is one document; the others are written. Halves are
    named batch.0 and batch.1, so that a task that is repeated writes under the same names: `write` replaces what a name has.
    """
    keys = [collection, document]
    there = batches.select(*(F.col(k).alias(f"__{k}") for k in keys), "batch")
    rows = chunks.join(there, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]).drop(*(f"__{k}" for k in keys))

    def settle(batch: pa.Table) -> pa.Table:
        batch = batch.sort_by([(document, "ascending")])
        all_names = batch[document].to_pylist()
        starts = [i for i, d in enumerate(all_names) if i == 0 or d != all_names[i - 1]]
        out, work, writes = [], [(batch["batch"][0].as_py(), 0, len(starts))], 0
        while work:
            name, low, high = work.pop()
            begin, end = starts[low], starts[high] if high < len(starts) else batch.num_rows
            writes += 1
            try:
                write(name, batch.slice(begin, end - begin))
                error = None
            except Exception as e:  # noqa: BLE001 - what a sink raises is reported with the document
                error = f"{type(e).__name__}: {e}"
            if error and high - low > 1:
                half = (low + high) // 2
                work += [(f"{name}.1", half, high), (f"{name}.0", low, half)]
            else:
                out += [(all_names[starts[k]], error) for k in range(low, high)]
        n = len(out)
        return pa.table([pa.array([batch["batch"][0].as_py()] * n), pa.array([d for d, _ in out], batch[document].type), pa.array([e is None for _, e in out]), pa.array([e for _, e in out], pa.string()), pa.array([writes] * n, pa.int64())], ["batch", document, "ok", "error", "writes"])

    kind = chunks.schema[document].dataType.simpleString()
    return rows.groupBy("batch").applyInArrow(settle, f"batch string, {document} {kind}, ok boolean, error string, writes long")
