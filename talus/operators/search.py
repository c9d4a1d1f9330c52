"""Vector and text retrieval: exact nearest neighbours in blocks, text gates, rank fusion and scoped searches."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import tumblers
from . import lineage, tables

#: Queries of one block, as vectors on every executor: 10,000 of 1024 places are 80 MB. More queries go in more blocks.
BLOCK_QUERIES = 10_000
#: Chunks of a block that meets blocks of queries.
BLOCK_CHUNKS = 50_000
#: Distances that a task holds at once.
HELD = 1_000_000
GATE = 0.6
RRF_K = 60
#: Words of similar spelling that filter a scan, and those of one asked word that make one pattern.
FEW_WORDS, PATTERN_WORDS = 1000, 30


def _units(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix**2).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def distances(queries: DataFrame, chunks: DataFrame, k: int | None, query_key: str = "query_id", key: str = "id", vector: str = "embedding", most: float | str | None = None, skip_self: bool = False) -> DataFrame:
    """(query_id, id, distance): cosine distances of all chunks to all queries, in blocks of both.

    Any number of queries runs (_by_blocks). With `k`, each batch of chunks keeps its k nearest for each query (ties by id), and with `most` (a
    number, or a column of the queries) those within a distance, before anything leaves the batch. A vector of zeros is at
    distance 1; vectors of different length are an error.
    """
    if k is not None and k < 1:
        raise ValueError("k must be 1 or more")
    schema = T.StructType([T.StructField("query_id", queries.schema[query_key].dataType), T.StructField("id", chunks.schema[key].dataType), T.StructField("distance", T.DoubleType())])
    return _by_blocks(queries, chunks, query_key, key, vector, most, schema, lambda batches, *block: _scored(batches, *block, k, skip_self))


def closest_query(queries: DataFrame, chunks: DataFrame, query_key: str = "query_id", key: str = "id", vector: str = "embedding") -> DataFrame:
    """(id, query_id, distance): for each chunk the nearest of the queries, the smallest key of equally near ones. Nothing is shuffled for a single block of queries."""
    schema = T.StructType([T.StructField("id", chunks.schema[key].dataType), T.StructField("query_id", queries.schema[query_key].dataType), T.StructField("distance", T.DoubleType())])
    near = _by_blocks(queries, chunks, query_key, key, vector, None, schema, lambda batches, names, matrix, _: _closest(batches, names, matrix))
    if queries.limit(BLOCK_QUERIES + 1).count() <= BLOCK_QUERIES:
        return near
    return near.groupBy("id").agg(F.min(F.struct("distance", "query_id")).alias("b")).select("id", "b.query_id", "b.distance")


def _by_blocks(queries: DataFrame, chunks: DataFrame, query_key: str, key: str, vector: str, most: float | str | None, schema: T.StructType, scored) -> DataFrame:
    """Rows of `scored(batches of chunks, sorted keys, unit vectors, limits)`: up to BLOCK_QUERIES queries are broadcast and nothing is shuffled.

    More of them and the chunks are dealt into blocks by hash, and each block of the one meets each of the other as one group, so
    that no query passes the driver and the chunks are read once.
    """
    # The query keys come back in their own type.
    wide = {"int": np.int32, "smallint": np.int16, "tinyint": np.int8}.get(queries.schema[query_key].dataType.simpleString())
    limit = F.col(most).cast("double") if isinstance(most, str) else F.lit(None if most is None else float(most)).cast("double")
    asked = queries.select(F.col(query_key).alias("q"), F.col(vector).alias("v"), limit.alias("most"))
    rows = chunks.select(F.col(key).alias(key), F.col(vector).alias(vector)).filter(F.col(vector).isNotNull())
    few = asked.limit(BLOCK_QUERIES + 1).collect()
    bounded = most is not None

    def block(names: list, vectors: list, limits: list) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        order = sorted(range(len(names)), key=names.__getitem__)
        matrix = np.array([vectors[i] for i in order], np.float64).reshape(len(order), len(vectors[0]) if vectors else 0)
        return np.array([names[i] for i in order], wide), _units(matrix), np.array([limits[i] for i in order], np.float64) if bounded else None

    if len(few) <= BLOCK_QUERIES:
        shared = chunks.sparkSession.sparkContext.broadcast(block(*([r[i] for r in few] for i in range(3))))
        return rows.mapInArrow(lambda batches: scored(batches, *shared.value), schema)
    across, down = -(-asked.count() // BLOCK_QUERIES), -(-rows.count() // BLOCK_CHUNKS) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("__y", F.pmod(F.xxhash64(key), F.lit(down)).cast("int")).withColumn("__x", every(across))
    right = asked.withColumn("__x", F.pmod(F.xxhash64("q"), F.lit(across)).cast("int")).withColumn("__y", every(down))
    empty = {f.name: [] for f in schema.fields}

    def meet(here: pa.Table, there: pa.Table) -> pa.Table:
        found = list(scored(here.select([0, 1]).combine_chunks().to_batches(), *block(*(there[c].to_pylist() for c in ("q", "v", "most"))))) if here.num_rows and there.num_rows else []
        return pa.Table.from_batches(found) if found else pa.table(empty).cast(to_arrow_schema(schema))

    return left.groupBy("__x", "__y").cogroup(right.groupBy("__x", "__y")).applyInArrow(meet, schema)


def _vectors(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and unit vectors of a batch."""
    ids, rows = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(rows) != len(ids) * width:
        raise ValueError("vectors of different length")
    return ids, _units(rows.reshape(len(ids), width))


def _closest(batches: Iterator[pa.RecordBatch], wanted: np.ndarray, matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    if not len(wanted):
        return
    for batch in batches:
        ids, units = _vectors(batch, matrix.shape[1])
        step = max(1, HELD // len(wanted))
        for low in range(0, len(ids), step):
            far = np.round(np.clip(1 - units[low : low + step] @ matrix.T, 0, 2), 12)
            best = far.argmin(axis=1)  # the first of equal ones; keys are sorted
            yield pa.RecordBatch.from_arrays([pa.array(ids[low : low + step]), pa.array(wanted[best]), pa.array(far[np.arange(len(best)), best])], ["id", "query_id", "distance"])


def _scored(batches: Iterator[pa.RecordBatch], wanted: np.ndarray, matrix: np.ndarray, limits: np.ndarray | None, k: int | None, skip_self: bool) -> Iterator[pa.RecordBatch]:
    if not len(wanted):
        return
    for batch in batches:
        ids, units = _vectors(batch, matrix.shape[1])
        step = max(1, HELD // max(1, len(ids)))
        for low in range(0, len(wanted), step):
            far = np.clip(1 - units @ matrix[low : low + step].T, 0, 2).T
            places = []
            for q in range(len(far)):
                keep = np.ones(len(ids), bool) if not skip_self else ids != wanted[low + q]
                if limits is not None:
                    keep &= far[q] <= limits[low + q]
                at = np.flatnonzero(keep)
                if k is not None:
                    near = np.round(far[q][at], 12)
                    if len(at) > k:  # with all that tie with the k-th
                        inside = near <= np.partition(near, k - 1)[k - 1]
                        at, near = at[inside], near[inside]
                    at = at[np.lexsort((ids[at], near))[:k]]
                places.append(at)
            at, q = np.concatenate(places), np.repeat(np.arange(len(far)), [len(x) for x in places])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(wanted[low + q]), pa.array(ids[at]), pa.array(far[q, at])], ["query_id", "id", "distance"])


def nearest(queries: DataFrame, chunks: DataFrame, k: int = 10, **options) -> DataFrame:
    """(query_id, id, distance, rank): the k nearest chunks of each query; ties by id."""
    near = distances(queries, chunks, k, **options).withColumn("distance", F.round("distance", 12))
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _grams(word: str) -> list[str]:
    padded = f"  {word} "
    return list(dict.fromkeys(padded[i : i + 3] for i in range(len(padded) - 2)))


def _spelt_like(wanted: list[str], gate: float) -> str:
    """A pattern of the tokens that may have a share `gate` of an asked word's trigrams: of any n - needed + 1 of them they have one."""
    first, inside = [], []
    for asked in wanted:
        grams = sorted(_grams(asked), key=lambda g: g.strip() != g)  # those inside a word say more
        needed = math.ceil(gate * len(grams) - 1e-9)
        for g in grams[: len(grams) - needed + 1]:
            (first if g[0] == " " else inside).append(re.escape(g.strip()) + ("(?![a-z0-9_])" if g[-1] == " " else ""))
    either = [*first, *([f"[a-z0-9_]*?(?:{'|'.join(dict.fromkeys(inside))})"] if inside else [])]
    return f"(?<![a-z0-9_])(?={'|'.join(either)})[a-z0-9_]+"


def _has_word(text: str, words: list[str]) -> Column:
    """Whether one of the words is a token of the text. A few words are one pattern, which cuts up nothing."""
    if len(words) > PATTERN_WORDS:
        return F.arrays_overlap(X.tokens(F.col(text)), F.lit(words))
    return F.lower(F.col(text)).rlike(f"(?<![a-z0-9_])(?:{'|'.join(map(re.escape, sorted(words)))})(?![a-z0-9_])")


def alike_words(docs: DataFrame, wanted: list[str], text: str = "text", gate: float = GATE) -> DataFrame:
    """(asked, word): for each asked word the words of the texts that have a share `gate` of its trigrams.

    Only words that may be alike leave the scan; they are made distinct and compared.
    """
    asked = F.array(*(F.struct(F.lit(w).alias("asked"), F.lit(_grams(w)).alias("grams")) for w in wanted))
    near = F.regexp_extract_all(F.lower(F.col(text)), F.lit(_spelt_like(wanted, gate)), 0)
    words = docs.select(F.explode(F.array_distinct(near)).alias("word")).distinct()
    pairs = words.withColumn("grams", X.trigrams(F.col("word"))).select("word", "grams", F.explode(asked).alias("a"))
    return pairs.filter(F.size(F.array_intersect("a.grams", "grams")) / F.size("a.grams") >= gate).select("a.asked", "word")


def text_matches(docs: DataFrame, query: str, key: str = "id", text: str = "text", gate: float = GATE) -> DataFrame:
    """Rows of texts that have all content words of the query, or for each of them a word of similar spelling.

    Spelling is compared on the distinct words of the texts: a share `gate` of the asked word's trigrams must occur in the
    word. Up to FEW_WORDS such words filter the scan itself; more are joined with the texts' words. A query of stopwords
    alone matches nothing.
    """
    wanted = [w for w in dict.fromkeys(re.findall("[a-z0-9_]+", query.lower())) if w not in X.STOPWORDS]
    if not wanted:
        return docs.limit(0)
    docs = lineage.spread(docs)
    alike = alike_words(docs, wanted, text, gate)
    few = alike.limit(FEW_WORDS + 1).collect()
    if len(few) > FEW_WORDS:
        words = docs.select(key, F.explode(F.array_distinct(X.tokens(F.col(text)))).alias("word"))
        found = words.join(alike, "word").groupBy(key).agg(F.countDistinct("asked").alias("n")).filter(F.col("n") == len(wanted))
        return docs.join(found.select(key), key, "left_semi")
    there = {w: [r["word"] for r in few if r["asked"] == w] for w in wanted}
    if not all(there.values()):
        return docs.limit(0)
    return docs.filter(reduce(and_, (_has_word(text, there[w]) for w in wanted)))


def hybrid(queries: DataFrame, chunks: DataFrame, query: str, k: int, where: Column | None = None, **options) -> DataFrame:
    """Text first, then vectors: only chunks that the text matches are ranked; no match, no rows."""
    inside = chunks.filter(where) if where is not None else chunks
    return nearest(queries, text_matches(inside, query), k, **options)


def fuse(ranked: DataFrame, keys: list[str], ranks: list[str], k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (k + rank); a missing rank adds nothing."""
    total = sum((F.coalesce(1 / (k + F.col(r)), F.lit(0.0)) for r in ranks), F.lit(0.0))
    return ranked.select(*keys, *ranks, total.alias("score"))


def best_of_document(hits: DataFrame, keys: list[str], distance: str = "distance", tie: str = "id") -> DataFrame:
    """Each document's nearest chunk."""
    rest = [c for c in hits.columns if c not in keys]
    return hits.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(distance, tie)).alias("__best")).select(*keys, "__best.*")


def top(hits: DataFrame, n: int, order: list) -> DataFrame:
    if n < 1:
        raise ValueError("n must be 1 or more")
    return hits.orderBy(*order).limit(n)


def fused(hits: DataFrame, distance: str, order: str, key: str = "id") -> DataFrame:
    """(key, vector_rank, text_rank, score) of all hits of one query: the places by distance and by text order (smaller is
    better), fused by reciprocal ranks. Ties go by key."""
    rows = lineage.cut(hits.select(key, F.round(distance, 12).alias("d"), F.col(order).cast("double").alias("o")))
    return fuse(tables.ranks(tables.ranks(rows, "d", key, "vector_rank"), "o", key, "text_rank"), [key], ["vector_rank", "text_rank"])


def in_scope(docs: DataFrame, content_type: str | None = None, author: str | None = None, year: int | None = None, subtree: str | None = None, where: Column | None = None) -> DataFrame:
    """Live documents of a content type, with a part of the author's name (whatever the case), of a year, below an address, and under a predicate."""
    out = docs.filter(F.col("deleted_at").isNull())
    out = out.filter(F.col("content_type") == content_type) if content_type is not None else out
    out = out.filter(F.contains(F.lower("author"), F.lit(author.lower()))) if author is not None else out
    out = out.filter(F.col("year") == year) if year is not None else out
    out = out.filter(tumblers.is_prefix(F.lit(subtree), F.col("tumbler"))) if subtree is not None else out
    return out.filter(where) if where is not None else out


def topic_members(topics: DataFrame, assignments: DataFrame, label: str, collection: str | None = None) -> DataFrame:
    """(id) of the chunks that are assigned to the topics of a label, in a collection or in all. topics: (topic_id, label, collection), assignments: (id, topic_id)."""
    named = topics.filter(F.col("label") == label)
    named = named.filter(F.col("collection") == collection) if collection is not None else named
    return assignments.join(named.select("topic_id"), "topic_id", "left_semi").select("id").distinct()


def in_collections(queries: DataFrame, chunks: DataFrame, models: DataFrame, names: list[str], k: int = 10, **options) -> DataFrame:
    """`nearest` over the chunks of some collections, which one model must have embedded. models: (collection, model, dimension)."""
    one_model(models.filter(F.col("collection").isin(names)))
    return nearest(queries, chunks.filter(F.col("collection").isin(names)), k, **options)


def one_model(collections: DataFrame) -> None:
    """An error if the collections (collection, model, dimension) of one search were embedded by different models or have vectors of different length."""
    few = collections.select("model", "dimension").distinct().limit(2).collect()
    if len(few) > 1:
        raise ValueError(f"collections of different models or dimensions: {sorted(tuple(r) for r in few)}")
