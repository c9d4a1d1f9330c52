"""Scores for pairs of a query and a text, by a scorer that can be exchanged, in Arrow batches by length.

A scorer takes lists of queries and texts and gives an array of scores; a cross-encoder fits as well as the default. The default is late interaction:
each token is a vector of its hashed trigrams, each place of the query takes the largest similarity to any token of the text, and the mean over the
places is the score, 1 for a text that has all tokens of the query. Only scores and the k best leave the tasks' stage.

Defined results: a query or text that is null or without tokens scores 0 with anything. Repeated pairs are scored each. Ties go by id.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X

Scorer = Callable[[list[str], list[str]], np.ndarray]
#: Places of a token's vector, tokens that a task remembers, and characters of texts that go to the scorer at once, the longest counted for each.
WIDTH, KEPT, CALL = 64, 100_000, 400_000
TOKEN = re.compile(r"\w+")
_vectors: dict[str, np.ndarray] = {}


def token_vector(token: str) -> np.ndarray:
    """A unit vector: each trigram adds 1 or -1 at a place that its hash picks."""
    if token not in _vectors:
        if len(_vectors) >= KEPT:
            _vectors.clear()
        out, padded = np.zeros(WIDTH), f"  {token} "
        for i in range(len(padded) - 2):
            h = zlib.crc32(padded[i : i + 3].encode())
            out[h % WIDTH] += 1 if h & 0x80000000 else -1
        _vectors[token] = out / (np.linalg.norm(out) or 1)
    return _vectors[token]


def late_interaction(queries: list[str], texts: list[str]) -> np.ndarray:
    out = np.zeros(len(queries))
    for i, (query, text) in enumerate(zip(queries, texts, strict=True)):
        asked, there = TOKEN.findall(query.lower()), list(dict.fromkeys(TOKEN.findall(text.lower())))
        if asked and there:
            out[i] = (np.array([token_vector(t) for t in asked]) @ np.array([token_vector(t) for t in there]).T).max(axis=1).mean()
    return np.round(out, 9)


def by_length(lengths: list[int], most: int = CALL) -> Iterator[list[int]]:
    """Places in calls of neighbouring lengths, so that padding to the longest stays within `most`; a longer one is alone."""
    call: list[int] = []
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        if call and lengths[i] * (len(call) + 1) > most:
            yield call
            call = []
        call.append(i)
    if call:
        yield call


def scored(pairs: DataFrame, query: str, text: str, scorer: Scorer = late_interaction, out: str = "score") -> DataFrame:
    """The pairs with a score; the texts don't come back."""
    kept = [c for c in pairs.columns if c not in (query, text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, there = batch.column(query).to_pylist(), batch.column(text).to_pylist()
            found = np.zeros(batch.num_rows)
            for call in by_length([len(t) for t in there]):
                found[call] = scorer([asked[i] for i in call], [there[i] for i in call])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found)], [*kept, out])

    filled = pairs.select(*kept, *(F.coalesce(c, F.lit("")).alias(c) for c in (query, text)))
    return filled.mapInArrow(run, T.StructType([*(pairs.schema[c] for c in kept), T.StructField(out, T.DoubleType())]))


def best(pairs: DataFrame, k: int, query_key: str, key: str, query: str, text: str, scorer: Scorer = late_interaction) -> DataFrame:
    """(query_key, key, score, rank) of each query's k best texts."""
    if k < 1:
        raise ValueError("k must be 1 or more")
    scores = scored(pairs.select(query_key, key, query, text), query, text, scorer)
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def salient(docs: DataFrame, key: str, text: str, seeds: list[str], first: int = 3, scorer: Scorer = late_interaction) -> DataFrame:
    """(key, place, sentence, score): the `first` sentences of each document that are most like one of the seed queries, by place; ties go to the earlier one."""
    if not seeds:
        raise ValueError("no seeds")
    sentences = docs.select(key, F.posexplode(X.sentences(F.col(text))).alias("place", "sentence"))
    asked = sentences.withColumn("__seed", F.explode(F.array(*map(F.lit, seeds)))).withColumn("__text", F.col("sentence"))
    scores = scored(asked, "__seed", "__text", scorer).groupBy(key, "place").agg(F.first("sentence").alias("sentence"), F.max("score").alias("score"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "place")
    return scores.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= first).drop("__n")
