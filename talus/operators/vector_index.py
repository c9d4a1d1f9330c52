"""A stored vector index: inverted lists with product codes, as a Parquet table by list, and searches that never pass vectors through the driver.

`build` fits up to MOST_LISTS centroids and CODEWORDS words for each stretch of WIDTH places on the SAMPLE rows whose keys have the smallest
hashes, which is all that a driver holds. Every row then goes to the list of its nearest centroid; its code says, for each
stretch, which word is nearest to the rest that the centroid leaves. Rows without a vector are left out.

`search` sends each query to the lists of its nearest centroids and meets the rows there by cells, which are lists cut into parts of about
PART_ROWS rows, so a hot list is many cells. In a cell the codes give approximate distances; the best REFINE * k of a query are scored
exactly from the stored vectors. A query that finds fewer than k rows under the predicate, or whose k-th row is farther than the next
centroid, goes on to more lists, twice as many each round, up to all of them. So vectors that form clusters ask few lists, and
vectors without any order ask most. `exact` goes on, with the k-th distance found so far, to every list that the distance between query and centroid
and the list's radius don't rule out, and compares vectors there: its answer is that of comparing all.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import vectors as V
from . import lineage

#: Rows that centroids and code words are fitted on, lists at most (their centroids go to every task: 4096 of 1024 places are 32 MB),
#: words and places of a stretch, rounds of fitting.
SAMPLE, MOST_LISTS, CODEWORDS, WIDTH, ROUNDS = 20_000, 4096, 256, 8, 8
#: Rows of a cell, lists that a query asks first, candidates that are scored exactly for each of k.
PART_ROWS, PROBES, REFINE = 50_000, 8, 8
#: Queries of a cell at most, about, and distances that a task holds at once.
SHARE, HELD = 10_000, 2_000_000


@dataclass(frozen=True)
class Index:
    """Where an index is, its centroids and code words, and for each list its number of rows and radius."""

    path: str
    key: str
    centroids: np.ndarray
    words: np.ndarray
    rows: dict[int, int]
    radius: dict[int, float]

    @property
    def width(self) -> int:
        return self.centroids.shape[1]


def units(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix**2).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def matrix_of(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Unit vectors of a column of lists of one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, n = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), len(column)
    wide = width if width is not None else (len(flat) // n if n else 0)
    if len(flat) != n * wide or column.value_lengths().to_numpy(zero_copy_only=False).tolist() != [wide] * n:
        raise ValueError("vectors of different length")
    return units(flat.reshape(n, wide))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all of b."""
    return np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1), 0)


def fit_means(points: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """k-means from the first k distinct points; a mean without points stays."""
    _, first = np.unique(points, axis=0, return_index=True)
    means = points[np.sort(first)[:k]].copy()
    for _ in range(rounds):
        own = squares(points, means).argmin(axis=1)
        counts = np.bincount(own, minlength=len(means))
        sums = np.zeros_like(means)
        np.add.at(sums, own, points)
        means[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return means


def stretches(points: np.ndarray) -> np.ndarray:
    """Points cut into stretches of WIDTH places, the last one filled with zeros: (stretch, point, place)."""
    count = math.ceil(points.shape[1] / WIDTH)
    padded = np.pad(points, ((0, 0), (0, count * WIDTH - points.shape[1])))
    return padded.reshape(len(points), count, WIDTH).transpose(1, 0, 2)


def fit(chunks: DataFrame, key: str, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """Centroids and code words (stretch, word, place)."""
    rows = chunks.filter(F.col(vector).isNotNull())
    sample = rows.select(vector, F.xxhash64(key).alias("h"), key).orderBy("h", key).limit(SAMPLE).toArrow()
    count = rows.count()
    points = matrix_of(sample[vector])
    if not count:
        return np.zeros((0, 0)), np.zeros((0, 0, WIDTH))
    centroids = fit_means(points, min(MOST_LISTS, len(points), max(1, round(math.sqrt(count)))))
    rest = points - centroids[squares(points, centroids).argmin(axis=1)]
    words = [fit_means(part, CODEWORDS) for part in stretches(rest)]
    most = max(map(len, words))
    return centroids, np.array([np.pad(w, ((0, most - len(w)), (0, 0)), mode="edge") for w in words])


def build(chunks: DataFrame, path: str, key: str = "id", vector: str = "embedding", keep: list[str] = ()) -> Index:
    """Write an index of all rows to `path`, with the columns `keep` for predicates."""
    centroids, words = fit(chunks, key, vector)
    if len(centroids):

        def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points = matrix_of(batch.column(vector), centroids.shape[1])
                far = squares(points, centroids)
                own = far.argmin(axis=1).astype(np.int32)
                rest = stretches(points - centroids[own])
                codes = np.stack([squares(part, word).argmin(axis=1).astype(np.uint8) for part, word in zip(rest, words, strict=True)], axis=1)
                away = np.sqrt(((points - centroids[own]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(away)], [*batch.schema.names, "__list", "__code", "__away"])

        rows = chunks.filter(F.col(vector).isNotNull()).select(key, vector, *keep)
        schema = T.StructType([*rows.schema.fields, T.StructField("__list", T.IntegerType()), T.StructField("__code", T.BinaryType()), T.StructField("__away", T.DoubleType())])
        placed = rows.mapInArrow(coded, schema)
        # Ranges of (list, key): a task writes few lists, and a hot list is written by many tasks.
        placed.repartitionByRange("__list", key).write.mode("overwrite").partitionBy("__list").parquet(path)
    return open_index(chunks.sparkSession, path, key, centroids, words)


def open_index(spark: SparkSession, path: str, key: str, centroids: np.ndarray, words: np.ndarray) -> Index:
    facts = spark.read.parquet(path).groupBy("__list").agg(F.count("*").alias("n"), F.max("__away").alias("r")).collect() if len(centroids) else []  # a row for each list
    return Index(path, key, centroids, words, {r["__list"]: r["n"] for r in facts}, {r["__list"]: r["r"] for r in facts})


def save(spark: SparkSession, index: Index) -> None:
    """Centroids and code words beside the table, so that `load` finds them."""
    text = json.dumps({"key": index.key, "centroids": index.centroids.tolist(), "words": index.words.tolist()})
    spark.createDataFrame([(text,)], "fitted string").coalesce(1).write.mode("overwrite").text(f"{index.path}-fitted")


def load(spark: SparkSession, path: str) -> Index:
    got = json.loads(spark.read.text(f"{path}-fitted").first()[0])
    return open_index(spark, path, got["key"], np.array(got["centroids"]), np.array(got["words"]))


def _asked(index: Index, queries: DataFrame, lists) -> DataFrame:
    """(query_id, vector, list, part): each query at the cells of the lists that `lists(unit vectors, bounds)` names for it."""
    parts = {name: math.ceil(n / PART_ROWS) for name, n in index.rows.items()}
    bounded = "bound" in queries.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = matrix_of(batch.column("vector"), index.width)
            named = lists(points, batch.column("bound").to_numpy(zero_copy_only=False) if bounded else None)
            at = [(i, name, part) for i, names in enumerate(named) for name in names for part in range(parts.get(int(name), 0))]
            if at:
                row, name, part = (np.array(x, np.int32) for x in zip(*at, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(row)), batch.column("vector").take(pa.array(row)), pa.array(name), pa.array(part)], ["query_id", "vector", "list", "part"])

    schema = T.StructType([queries.schema["query_id"], queries.schema["vector"], T.StructField("list", T.IntegerType()), T.StructField("part", T.IntegerType())])
    return queries.mapInArrow(run, schema)


def _cells(index: Index, asked: DataFrame, where: Column | None, k: int, stored: list[str], shares: int, score) -> DataFrame:
    """(query_id, list, id, far) of the k best rows of each query in each cell, by `score(cell, points, list)`; a cell's queries come in `shares`."""
    table = asked.sparkSession.read.parquet(index.path)
    table = table.filter(where) if where is not None else table
    parts = F.create_map(*(F.lit(x) for name, n in index.rows.items() for x in (name, math.ceil(n / PART_ROWS))))
    rows = table.select(F.col("__list").alias("list"), F.col(index.key).alias("id"), *stored).withColumn("part", F.pmod(F.xxhash64("id"), parts[F.col("list")]).cast("int"))
    rows = rows.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    asked = asked.withColumn("share", F.pmod(F.xxhash64("query_id"), F.lit(shares)).cast("int"))
    key_type, id_type = asked.schema["query_id"].dataType, rows.schema["id"].dataType

    def meet(cell: pa.Table, there: pa.Table) -> pa.Table:
        keys, ids = there["query_id"].combine_chunks(), cell["id"].combine_chunks()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if cell.num_rows and there.num_rows:
            name, points = there["list"][0].as_py(), matrix_of(there["vector"], index.width)
            step = max(1, HELD // cell.num_rows)
            for low in range(0, len(points), step):
                for q, far in enumerate(score(cell, points[low : low + step], name), low):
                    at = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1]) if len(far) > k else np.arange(len(far))  # with all that tie
                    found.append((np.full(len(at), q), at, far[at]))
        q, at, far = (np.concatenate(x) for x in zip(*found, strict=True))
        lists = pa.array(np.full(len(q), name if len(q) else 0), pa.int32())
        return pa.table([keys.take(pa.array(q)), lists, ids.take(pa.array(at)), pa.array(far)], ["query_id", "list", "id", "far"])

    schema = T.StructType([T.StructField("query_id", key_type), T.StructField("list", T.IntegerType()), T.StructField("id", id_type), T.StructField("far", T.DoubleType())])
    keys = ["list", "part", "share"]
    return rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(meet, schema)


def _first(rows: DataFrame, by: str, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(by, "id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _by_codes(index: Index, queries: DataFrame, lists, where: Column | None, k: int, shares: int) -> DataFrame:
    """(query_id, id, distance): candidates by codes, scored by their stored vectors."""
    asked = _asked(index, queries, lists)

    def score(cell: pa.Table, points: np.ndarray, name: int) -> np.ndarray:
        codes = np.frombuffer(b"".join(cell["__code"].to_pylist()), np.uint8).reshape(cell.num_rows, len(index.words))
        parts = stretches(points - index.centroids[name])
        return sum(squares(part, word)[:, codes[:, i]] for i, (part, word) in enumerate(zip(parts, index.words, strict=True)))

    near = _first(_cells(index, asked, where, REFINE * k, ["__code"], shares, score), "far", REFINE * k).select("query_id", "list", "id")
    stored = queries.sparkSession.read.parquet(index.path)
    vector = next(f.name for f in stored.schema.fields if isinstance(f.dataType, T.ArrayType))
    rows = stored.select(F.col("__list").alias("list"), F.col(index.key).alias("id"), F.col(vector).alias("there"))
    pairs = near.join(rows, ["list", "id"]).join(queries.select("query_id", "vector"), "query_id")
    return pairs.select("query_id", "id", F.round(V.cosine_distance("vector", "there"), 12).alias("distance"))


def _unsettled(queries: DataFrame, found: DataFrame, k: int, centers: np.ndarray, asked: int) -> DataFrame:
    """Queries with fewer than k rows, or with a centroid among those not asked that is nearer than the k-th row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = np.sqrt(np.partition(squares(matrix_of(batch.column("vector"), centers.shape[1]), centers), asked, axis=1)[:, asked])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far)], [*batch.schema.names, "next"])

    last = found.filter(F.col("rank") == k).select("query_id", F.sqrt(2 * F.col("distance")).alias("last"))
    reach = queries.mapInArrow(run, T.StructType([*queries.schema.fields, T.StructField("next", T.DoubleType())]))
    return reach.join(last, "query_id", "left").filter(F.col("last").isNull() | (F.col("next") <= F.col("last"))).select("query_id", "vector")


def search(index: Index, queries: DataFrame, k: int = 10, where: Column | None = None, probes: int = PROBES, exact: bool = False, query_key: str = "query_id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, distance, rank): the k nearest rows of each query under a predicate on kept columns; ties by id.

    Without `exact` rows may be missed, but every query gets k rows if so many satisfy the predicate.
    """
    asked = queries.filter(F.col(vector).isNotNull()).select(F.col(query_key).alias("query_id"), F.col(vector).alias("vector"))
    names = np.array(sorted(index.rows), np.int32)
    if not len(names):
        return queries.sparkSession.createDataFrame([], T.StructType([asked.schema["query_id"], T.StructField("id", T.LongType()), T.StructField("distance", T.DoubleType()), T.StructField("rank", T.IntegerType())]))
    centers = index.centroids[names]
    found, low, high, left, count = None, 0, min(probes, len(names)), asked, asked.count()
    while True:

        def nearest(points: np.ndarray, _: None, low: int = low, high: int = high) -> list[np.ndarray]:
            return list(names[np.argsort(np.round(squares(points, centers), 12), axis=1, kind="stable")[:, low:high]])

        more = _by_codes(index, left, nearest, where, k, max(1, math.ceil(count * (high - low) / len(names) / SHARE)))
        found = lineage.cut(_first(more if found is None else found.drop("rank").unionByName(more), "distance", k))
        if high >= len(names):
            break
        left = lineage.cut(_unsettled(left, found, k, centers, high))
        if left.isEmpty():
            break
        low, high = high, min(2 * high, len(names))
    if not exact:
        return found
    # On unit vectors the squared distance is twice the cosine distance. A small slack covers rounding and vectors of zeros.
    last = found.filter(F.col("rank") == k).select("query_id", F.sqrt(2 * F.col("distance") + 1e-9).alias("bound"))
    bounded = asked.join(last, "query_id", "left").select("query_id", "vector", F.coalesce("bound", F.lit(1e9)).alias("bound"))
    radius = np.array([index.radius[int(name)] for name in names])

    def possible(points: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        near = np.sqrt(squares(points, centers)) - radius
        # A vector of zeros has cosine distance 1 to all, whatever its place: such queries meet all lists.
        return [names[(n <= b + 1e-6) | (not p.any())] for n, b, p in zip(near, bounds, points, strict=True)]

    def compare(cell: pa.Table, points: np.ndarray, _: int) -> np.ndarray:
        return np.round(np.clip(1 - points @ matrix_of(cell["__vector"], index.width).T, 0, 2), 12)

    stored = queries.sparkSession.read.parquet(index.path)
    own = next(f.name for f in stored.schema.fields if isinstance(f.dataType, T.ArrayType))
    cells = _cells(index, _asked(index, bounded, possible), where, k, [F.col(own).alias("__vector")], max(1, math.ceil(count / SHARE)), compare)
    return _first(cells.withColumnRenamed("far", "distance").drop("list"), "distance", k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, found, wanted): how many of the true rows a search has found for each query."""
    hits = truth.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hits.groupBy("query_id").agg(F.count("hit").alias("found"), F.count("*").alias("wanted"))
