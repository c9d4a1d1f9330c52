"""The document catalog: live rows, coverage, orphans, health, purging and manifest repair.

Documents have (id, collection, content_type, indexed_at, deleted_at); a manifest row is (doc_id, position, chunk_id).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def live(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("deleted_at").isNull())


def visible_chunks(chunks: DataFrame, manifest: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with a live owner or with none at all; those that only deleted documents own are hidden."""
    owners = manifest.join(docs.select(F.col("id").alias("doc_id"), F.col("deleted_at").isNull().alias("__live")), "doc_id").groupBy("chunk_id").agg(F.max("__live").alias("__live"))
    hidden = owners.filter(~F.col("__live")).select(F.col("chunk_id").alias("id"))
    return chunks.join(hidden, "id", "left_anti")


def purgeable(chunks: DataFrame, manifest: DataFrame, docs: DataFrame, cutoff: dt.datetime) -> DataFrame:
    """Chunks all of whose owners were deleted at the cutoff or before."""
    aged = docs.select(F.col("id").alias("doc_id"), F.coalesce(F.col("deleted_at") <= F.lit(cutoff), F.lit(False)).alias("__aged"))
    owners = manifest.join(aged, "doc_id").groupBy("chunk_id").agg(F.min("__aged").alias("__aged"))
    return chunks.join(owners.filter("__aged").select(F.col("chunk_id").alias("id")), "id", "left_semi")


def coverage(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """(content_type, total, linked) of live documents; linked: with a link at either end."""
    ends = edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct().withColumn("__linked", F.lit(True))
    return live(docs).join(ends, "id", "left").groupBy("content_type").agg(F.count("*").alias("total"), F.count("__linked").alias("linked"))


def orphans(docs: DataFrame, edges: DataFrame, before: dt.datetime) -> DataFrame:
    """Live documents indexed before a date to which no live document links."""
    alive = live(docs)
    inbound = edges.join(alive.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("id"))
    return alive.filter(F.col("indexed_at") < F.lit(before)).join(inbound, "id", "left_anti")


def health(docs: DataFrame, edges: DataFrame, stale_before: dt.datetime) -> DataFrame:
    """(collection, docs, last_indexed, orphans, stale_ratio): undated documents count in neither part of the ratio."""
    alive = live(docs)
    inbound = edges.join(alive.select(F.col("id").alias("from_id")), "from_id", "left_semi").select(F.col("to_id").alias("id")).distinct().withColumn("__in", F.lit(True))
    stale = F.count_if(F.col("indexed_at") < F.lit(stale_before))
    return alive.join(inbound, "id", "left").groupBy("collection").agg(F.count("*").alias("docs"), F.max("indexed_at").alias("last_indexed"), F.count_if(F.col("__in").isNull()).alias("orphans"), F.when(F.count("indexed_at") > 0, stale / F.count("indexed_at")).alias("stale_ratio"))


def totals(docs: DataFrame, edges: DataFrame, manifest: DataFrame, owner: str) -> DataFrame:
    """One row: live documents, their owners, collections, content types and chunks, and links."""
    alive = live(docs)
    out = alive.agg(F.count("*").alias("docs"), F.countDistinct(owner).alias("owners"), F.countDistinct("collection").alias("collections"), F.countDistinct("content_type").alias("content_types"))
    chunks = manifest.join(alive.select(F.col("id").alias("doc_id")), "doc_id", "left_semi").agg(F.countDistinct("chunk_id"))
    return out.withColumn("chunks", chunks.scalar()).withColumn("links", edges.agg(F.count("*")).scalar())


def gaps(docs: DataFrame, manifest: DataFrame, expected: str = "chunk_count") -> DataFrame:
    """(id, expected, have, ghost) of documents with fewer manifest rows than they should have.

    A ghost should have none by its count and has none, but has a content hash and a collection: it was indexed once.
    """
    have = manifest.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("have"))
    known = (F.coalesce("content_hash", F.lit("")) != "") & (F.coalesce("collection", F.lit("")) != "")
    both = docs.join(have, "id", "left").select("id", F.col(expected).alias("expected"), F.coalesce("have", F.lit(0)).cast("long").alias("have"), known.alias("__known"))
    ghost = F.col("expected") == 0
    return both.filter((F.col("have") < F.col("expected")) | (ghost & (F.col("have") == 0) & F.col("__known"))).select("id", "expected", "have", ghost.alias("ghost"))


def _named(docs: DataFrame, name: str, key: str) -> DataFrame:
    """(collection, key, doc_id): the last document of a name in each collection."""
    return docs.filter(F.coalesce(F.col(name), F.lit("")) != "").groupBy("collection", F.col(name).alias(key)).agg(F.max("id").alias("doc_id"))


def link_loose(manifest: DataFrame, docs: DataFrame, chunks: DataFrame, name: str, key: str) -> DataFrame:
    """New manifest rows for chunks (chunk_id, chunk_index, collection, `key`) whose key, a title or a content hash, is the `name` of a document of their collection.

    They go behind the document's rows, by chunk_index and chunk_id; of a collection's documents with the same name the last one takes
    them. Chunks without a key or without such a document are left out; `loose_groups` counts them.
    """
    found = chunks.join(_named(docs, name, key), ["collection", key]).select("doc_id", "chunk_id", "chunk_index").distinct()
    have = manifest.groupBy("doc_id").agg(F.count("*").alias("__n"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_index", "chunk_id"))
    return found.withColumn("__nth", nth).join(have, "doc_id", "left").select("doc_id", (F.coalesce("__n", F.lit(0)) + F.col("__nth") - 1).cast("long").alias("position"), "chunk_id")


def loose_groups(docs: DataFrame, chunks: DataFrame, name: str, key: str) -> DataFrame:
    """(collection, linked_chunks, linked_docs, loose_chunks, loose_groups): what link_loose links, and the chunks and keys (null ones are one) that it leaves."""
    groups = chunks.select("collection", F.when(F.col(key) != "", F.col(key)).alias(key), "chunk_id", "chunk_index").distinct().groupBy("collection", key).agg(F.count("*").alias("n"))
    met = groups.join(_named(docs, name, key), ["collection", key], "left")
    linked = F.col("doc_id").isNotNull()
    return met.groupBy("collection").agg(
        F.coalesce(F.sum(F.when(linked, F.col("n"))), F.lit(0)).alias("linked_chunks"), F.count_if(linked).alias("linked_docs"),
        F.coalesce(F.sum(F.when(~linked, F.col("n"))), F.lit(0)).alias("loose_chunks"), F.count_if(~linked).alias("loose_groups"),
    )


def append_to_manifest(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """New manifest rows for (doc_id, chunk_id, chunk_index): behind the last position, in the order of chunk_index."""
    last = manifest.groupBy("doc_id").agg(F.max("position").alias("__last"))
    order = Window.partitionBy("doc_id").orderBy("chunk_index", "chunk_id")
    numbered = found.withColumn("__n", F.row_number().over(order)).join(last, "doc_id", "left")
    return numbered.select("doc_id", (F.coalesce("__last", F.lit(-1)) + F.col("__n")).cast("long").alias("position"), "chunk_id")


def document_text(manifest: DataFrame, chunks: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text) of live documents: their chunks in the order of position, missing ones skipped."""
    parts = manifest.join(live(docs).select(F.col("id").alias("doc_id")), "doc_id", "left_semi").join(chunks.select(F.col("id").alias("chunk_id"), text), "chunk_id")
    ordered = F.array_sort(F.collect_list(F.struct("position", text)))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda s: s[text]), "\n").alias("text"))


def coverage_ratio(indexed: Column, total: Column) -> Column:
    """min(1, indexed / total); null for a total of 0."""
    return F.when(total > 0, F.least(F.lit(1.0), indexed / total))


def next_numbers(docs: DataFrame, owner: str, new: DataFrame, order: str) -> DataFrame:
    """New documents with their numbers: behind the largest that the owner ever gave, deleted documents included."""
    last = docs.groupBy(owner).agg(F.max("number").alias("__last"))
    n = F.row_number().over(Window.partitionBy(owner).orderBy(order))
    return new.withColumn("__n", n).join(last, owner, "left").withColumn("number", (F.coalesce("__last", F.lit(0)) + F.col("__n")).cast("long")).drop("__n", "__last")


def vector_stats(chunks: DataFrame, vector: str = "embedding", written: str = "written_at") -> DataFrame:
    """(collection, chunks, dimension, last_write) of chunks that are visible (visible_chunks): the dimension is null where a collection mixes several."""
    size = F.size(vector)
    return chunks.groupBy("collection").agg(F.count("*").alias("chunks"), F.when(F.min(size) == F.max(size), F.max(size)).alias("dimension"), F.max(written).alias("last_write"))


def resolve_chunk(rows: DataFrame, chash: str, prefer: str | None = None) -> DataFrame:
    """One (chash, collection) for each hash: the preferred collection, else the newest, else the first by name."""
    rest = F.struct((F.col("collection") != F.lit(prefer)) if prefer is not None else F.lit(True), -F.unix_micros(F.col("created_at").cast("timestamp")), "collection")
    return rows.groupBy(chash).agg(F.min_by("collection", rest).alias("collection"))


def search(docs: DataFrame, words: str | None = None, text: list[str] = (), contains: dict[str, str] | None = None, equals: dict | None = None) -> DataFrame:
    """Documents whose text columns hold all words, whatever the case, with substrings and equal values in other columns."""
    out = docs
    for word in (words or "").lower().split():
        holds = F.lit(False)
        for c in text:
            holds = holds | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(word))
        out = out.filter(holds)
    for c, part in (contains or {}).items():
        out = out.filter(F.contains(F.lower(c), F.lit(part.lower())))
    for c, value in (equals or {}).items():
        out = out.filter(F.col(c) == value)
    return out


def show(docs: DataFrame, edges: DataFrame) -> DataFrame:
    """Documents with the links that leave and reach them, as sorted arrays of (id, link_type), and their numbers."""
    side = lambda at, other, name: edges.groupBy(F.col(at).alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col(other).alias("id"), "link_type"))).alias(name))
    none = F.array().cast("array<struct<id:bigint,link_type:string>>")
    both = docs.join(side("from_id", "to_id", "out"), "id", "left").join(side("to_id", "from_id", "into"), "id", "left")
    filled = both.withColumns({"out": F.coalesce("out", none), "into": F.coalesce("into", none)})
    return filled.withColumns({"links_out": F.size("out").cast("long"), "links_in": F.size("into").cast("long")})


def of_tenant(df: DataFrame, tenant: str, column: str = "tenant") -> DataFrame:
    """Rows of one tenant; without a tenant there are none."""
    if not tenant:
        raise ValueError("no tenant")
    return df.filter(F.col(column) == tenant)
