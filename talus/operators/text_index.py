"""An inverted text index: postings by term with classes and positions, a dictionary with trigrams, and searches that read only the postings they ask for.

`build` writes, for three kinds of terms, one row for each term and shard of the documents (those that a task reads one after the other, SHARD_ROWS
documents or about SHARD_WORDS words at most, so that a shard is inverted in one task's memory and no list is grouped by a shuffle):
  stem   words of prose, folded and without English endings, no stopwords
  plain  words as they are, folded: tags, projects, paths
  token  runs of a-z, 0-9 and _, lower-cased, of the fields that misspelt queries ask
A row has the documents' ids in rising order, for each a letter with the class of weight of the heaviest field with the term, how often it
comes, and where (fields and documents one after the other; not for tokens, whose search takes no places), and the row's heaviest class, by
which whole shards are passed over. Ids and places are flat, as a list of lists is several times as large in a shuffle. The files are of Parquet's second version, which keeps ids and places as packed differences.
Rows are in BUCKETS folders by hash and sorted by term, so that a term is a few pages of a file. A word in a third of all documents is as
many rows as there are shards. The dictionary has each token's number of documents, and its trigrams in rows of their own.

Searches give what the scans in `search.text_matches` and `fulltext.matches` give, without reading texts. Keys are whole numbers, each once.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from . import lineage
from .fulltext import WEIGHTS, terms

SHARD_ROWS, SHARD_WORDS, BUCKETS = 50_000, 1_000_000, 64
#: Bytes of a row group: what a writer holds.
GROUP = 32 << 20
#: Words of similar spelling that become one filter; more are joined.
FEW_WORDS = 1000
STEM, PLAIN, TOKEN = "stem", "plain", "token"


@dataclass(frozen=True)
class TextIndex:
    path: str

    def postings(self, spark: SparkSession, kind: str) -> DataFrame:
        return spark.read.parquet(f"{self.path}/postings").filter(F.col("kind") == kind)

    def dictionary(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/dictionary")

    def grams(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/grams")


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


#: Words that this doesn't find keep their ends.
_ENDING = re.compile("|".join(f"(?:{pattern})" for pattern, _ in X.ENDINGS))


@cache
def _stem(word: str) -> str | None:
    """The term that a word of prose is known by, if any."""
    return None if word in X.STOPWORDS else X.stem_of(word) if _ENDING.search(word) else word


class _Numbers(dict):
    """The number of each word's term, -1 for words that are none; words of one term have one number."""

    def __init__(self, kind: str, terms: dict[tuple[str, str], int]):
        self.kind, self.terms = kind, terms

    def __missing__(self, word: str) -> int:
        term = _stem(word) if self.kind == STEM else word
        self[word] = n = -1 if term is None else self.terms.setdefault((self.kind, term), len(self.terms))
        return n


class _Shard:
    """The words of some documents, by number; `postings` turns them over."""

    def __init__(self, fields: list[tuple[str, str, str]], ranks: dict[str, int]):
        self.ranks, self.terms, self.ids, self.words, self.lengths = ranks, {}, [], array("i"), array("i")
        self.fields = [(_Numbers(kind, self.terms), ranks[weight]) for kind, _, weight in fields]

    def add(self, key: int, words: list[list[str]]) -> None:
        """A document, with the words of each field."""
        self.ids.append(key)
        for (numbers, _), ws in zip(self.fields, words, strict=True):
            self.words.extend(map(numbers.__getitem__, ws))
            self.lengths.append(len(ws))

    def postings(self, shard: int) -> pa.RecordBatch:
        """A row for each term; documents by rising id, their places in order."""
        ids, lengths, n = np.array(self.ids, np.int64), np.array(self.lengths, np.int64), len(self.fields)
        place = np.empty(len(ids), np.int64)
        place[np.argsort(ids, kind="stable")] = np.arange(len(ids))
        names, term = list(self.terms), np.array(self.words, np.int64)
        kept = np.flatnonzero(term >= 0)
        at = np.arange(len(term)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(np.tile(np.arange(n, dtype=np.int64) << 40, len(ids)) + 1, lengths)
        at, doc = at[kept], np.repeat(np.repeat(place, n), lengths)[kept]
        rank = np.repeat(np.tile(np.array([r for _, r in self.fields], np.int8), len(ids)), lengths)[kept]
        order = np.argsort(term[kept] * len(ids) + doc, kind="stable")  # a document's places were in order
        term, doc, at, rank = term[kept][order], doc[order], at[order], rank[order]
        starts = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])])  # of each term's documents
        lists = np.flatnonzero(np.r_[True, term[starts][1:] != term[starts][:-1]])  # of each term
        best = np.minimum.reduceat(rank, starts)
        cuts = np.r_[lists, len(starts)].astype(np.int32)
        weights = pa.array(list(self.ranks))
        letters = pa.py_buffer(np.frombuffer("".join(self.ranks).encode(), np.uint8)[best].tobytes())  # a class is one letter
        spots = pa.array(np.r_[starts, len(at)][cuts].astype(np.int32))
        placed = pa.array([k == TOKEN for k, _ in names])
        return pa.RecordBatch.from_pydict({
            "kind": pa.array([k for k, _ in names]), "term": pa.array([t for _, t in names]), "shard": pa.array(np.full(len(names), shard, np.int64)),
            "n": pa.array(np.diff(cuts)), "best": weights.take(pa.array(np.minimum.reduceat(best, lists))),
            "ids": pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.sort(ids)[doc[starts]])), "classes": pa.StringArray.from_buffers(len(names), pa.py_buffer(cuts), letters),
            "tfs": pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.diff(np.r_[starts, len(at)]).astype(np.int32))), "positions": pa.ListArray.from_arrays(spots, pa.array(at), mask=placed),
        })


POSTINGS = "kind string, term string, shard long, n int, best string, ids array<long>, classes string, tfs array<int>, positions array<long>"
#: Documents that are Python objects at a time.
SLICE = 100


def postings(docs: DataFrame, key: str, fields: list[tuple[str, str, str]]) -> DataFrame:
    """POSTINGS of (kind, field, class): each term of a shard once, with its documents, their heaviest classes and its places.

    Positions count a field's words from 1, stopwords too; a field's number times 2**40 is added.
    """
    letters, plain = regex.compile(X.WORD + "+"), re.compile("[a-z0-9_]+")
    most_rows, most_words, ranks = SHARD_ROWS, SHARD_WORDS, {w: i for i, w in enumerate(sorted({w for _, _, w in fields}))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, done = TaskContext.get().partitionId() << 32, _Shard(fields, ranks), 0
        finders = [(plain if kind == TOKEN else letters).findall for kind, _, _ in fields]
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                for i, *texts in zip(*[c.to_pylist() for c in batch.slice(start, SLICE).columns], strict=True):
                    shard.add(i, [find(text) for find, text in zip(finders, texts, strict=True)])
                    if len(shard.ids) >= most_rows or len(shard.words) >= most_words:
                        if shard.terms:
                            yield shard.postings(part + done)
                        shard, done = _Shard(fields, ranks), done + 1
            _stem.cache_clear() if _stem.cache_info().currsize > 200_000 else None
        if shard.terms:
            yield shard.postings(part + done)

    texts = [F.lower(F.coalesce(c, F.lit(""))) if kind == TOKEN else X.folded(F.col(c)) for kind, c, _ in fields]
    rows = docs.select(F.col(key).cast("long").alias("id"), *(t.alias(f"t{i}") for i, t in enumerate(texts)))
    return rows.mapInArrow(run, POSTINGS)


def build(docs: DataFrame, path: str, key: str = "id", prose: dict[str, str] | None = None, plain: dict[str, str] | None = None, tokens: list[str] = ()) -> TextIndex:
    """Write an index to `path`. `prose` and `plain` give each field's class, A to D; the fields `tokens` can be asked with misspelt words."""
    files = max(1, math.ceil(docs.count() / SHARD_ROWS))  # of a bucket, so that a frequent term is several tasks' work
    fields = [(STEM, c, w) for c, w in (prose or {}).items()] + [(PLAIN, c, w) for c, w in (plain or {}).items()] + [(TOKEN, c, "D") for c in tokens]
    out = postings(lineage.spread(docs), key, fields).withColumn("bucket", bucket(F.col("term")))
    dealt = out.repartition("kind", "bucket", F.pmod(F.xxhash64("shard"), F.lit(files))).sortWithinPartitions("kind", "bucket", "term", "shard")
    dealt.write.mode("overwrite").option("parquet.writer.version", "PARQUET_2_0").option("parquet.block.size", GROUP).partitionBy("kind", "bucket").parquet(f"{path}/postings")
    index = TextIndex(path)
    words = index.postings(docs.sparkSession, TOKEN).groupBy("term").agg(F.sum("n").alias("df")) if tokens else docs.sparkSession.createDataFrame([], "term string, df long")
    words.write.mode("overwrite").parquet(f"{path}/dictionary")
    grams = index.dictionary(docs.sparkSession).select(F.explode(X.trigrams(F.col("term"))).alias("gram"), "term")
    grams.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/grams")
    return index


def _grams(word: str) -> list[str]:
    """`X.trigrams` of an asked word."""
    padded = f"  {word} "
    return list(dict.fromkeys(padded[i : i + 3] for i in range(len(padded) - 2)))


def alike(spark: SparkSession, index: TextIndex, wanted: list[str], gate: float) -> DataFrame:
    """(asked, word): for each asked word the dictionary's words that have a share `gate` of its trigrams."""
    grams = {w: _grams(w) for w in wanted}
    every = sorted({g for gs in grams.values() for g in gs})
    asked = F.create_map(*(x for g in every for x in (F.lit(g), F.array(*(F.struct(F.lit(w).alias("asked"), F.lit(len(gs)).alias("of")) for w, gs in grams.items() if g in gs)))))
    met = index.grams(spark).filter(F.col("gram").isin(every)).select("term", F.explode(asked[F.col("gram")]).alias("a")).groupBy("a", "term").agg(F.count("*").alias("n"))
    return met.filter(F.col("n") / F.col("a.of") >= gate).select("a.asked", F.col("term").alias("word"))


def _read(spark: SparkSession, index: TextIndex, kind: str, words: list[str]) -> DataFrame:
    """The rows of some terms; only their folders and pages are read."""
    buckets = sorted(set(spark.sql("SELECT 1").select(F.array(*(bucket(F.lit(w)) for w in words))).first()[0]))  # constants
    return index.postings(spark, kind).filter(F.col("bucket").isin(buckets) & F.col("term").isin(words))


def misspelt_matches(spark: SparkSession, index: TextIndex, query: str, gate: float = 0.6) -> DataFrame:
    """(id) of the documents that have, for each content word of the query, a word of similar spelling: what `search.text_matches` finds."""
    wanted = [w for w in dict.fromkeys(re.findall("[a-z0-9_]+", query.lower())) if w not in X.STOPWORDS]
    nothing = spark.createDataFrame([], "id long")
    if not wanted:
        return nothing
    near = alike(spark, index, wanted, gate)
    few = near.limit(FEW_WORDS + 1).collect()
    if len(few) > FEW_WORDS:
        rows = index.postings(spark, TOKEN).join(near.withColumnRenamed("word", "term"), "term")
    elif {r["asked"] for r in few} != set(wanted):
        return nothing
    else:
        pairs = F.create_map(*(F.lit(x) for w in {r["word"] for r in few} for x in (w, [r["asked"] for r in few if r["word"] == w])))
        rows = _read(spark, index, TOKEN, sorted({r["word"] for r in few})).withColumn("asked", F.explode(pairs[F.col("term")]))
    found = rows.select("asked", F.explode("ids").alias("id"))
    return found.groupBy("id").agg(F.countDistinct("asked").alias("n")).filter(F.col("n") == len(wanted)).select("id")


def _weight(cls: Column) -> Column:
    return reduce(lambda out, kv: F.when(cls == kv[0], kv[1]).otherwise(out), WEIGHTS.items(), F.lit(0.0))


def _ways(query: str) -> list[tuple[str, list[str]]]:
    stems, words = terms(query)
    if not words:
        raise ValueError(f"nothing to search for: {query!r}")
    return [(kind, wanted) for kind, wanted in ((STEM, stems), (PLAIN, words)) if wanted]


def _scored(rows: DataFrame, wanted: int) -> DataFrame:
    """(id, score) of the documents that all wanted terms have in `rows`: the mean weight of the terms' heaviest fields."""
    each = rows.select("term", F.explode(F.arrays_zip(F.col("ids").alias("id"), F.split("classes", "").alias("class"))).alias("x")).select("term", "x.id", "x.class")
    summed = each.groupBy("id").agg(F.count("*").alias("n"), F.sum(_weight(F.col("class"))).alias("w"))
    return summed.filter(F.col("n") == wanted).select("id", (F.col("w") / wanted).alias("score"))


def search(spark: SparkSession, index: TextIndex, query: str) -> DataFrame:
    """(id, score): what `fulltext.matches` finds in the indexed fields."""
    found = [_scored(_read(spark, index, kind, wanted), len(wanted)) for kind, wanted in _ways(query)]
    return reduce(DataFrame.unionByName, found).groupBy("id").agg(F.max("score").alias("score"))


def top(spark: SparkSession, index: TextIndex, query: str, k: int) -> DataFrame:
    """(id, score) of the k best of `search`, ties by id, reading shards by their bounds.

    A shard's bound is the mean of its rows' heaviest classes, the larger of both ways; shards are read from the highest
    bound down, twice as many each time, until k documents score more than the next bound.
    """
    bounds = None
    for kind, wanted in _ways(query):
        here = _read(spark, index, kind, wanted).groupBy("shard").agg(F.count("*").alias("n"), (F.sum(_weight(F.col("best"))) / len(wanted)).alias("bound")).filter(F.col("n") == len(wanted)).select("shard", "bound")
        bounds = here if bounds is None else bounds.unionByName(here)
    order = [(r["bound"], r["shard"]) for r in bounds.groupBy("shard").agg(F.max("bound").alias("bound")).orderBy(F.desc("bound"), "shard").collect()]  # a row for each shard
    best, done, step = [], 0, 1
    while done < len(order):
        some = [shard for _, shard in order[done : done + step]]
        found = [_scored(_read(spark, index, kind, wanted).filter(F.col("shard").isin(some)), len(wanted)) for kind, wanted in _ways(query)]
        rows = reduce(DataFrame.unionByName, found).groupBy("id").agg(F.max("score").alias("score"))
        best += [(-r["score"], r["id"]) for r in rows.orderBy(F.desc("score"), "id").limit(k).collect()]
        best = sorted(best)[:k]
        done, step = done + step, 2 * step
        if done < len(order) and len(best) == k and -best[-1][0] > order[done][0]:
            break
    return spark.createDataFrame([(i, -s) for s, i in best], "id long, score double")


def phrase(spark: SparkSession, index: TextIndex, query: str) -> DataFrame:
    """(id, times): documents in whose prose the query's stems follow each other as in the query, stopwords counted as places, and how often."""
    words = re.findall(r"\w+", X.folded_word(query))
    placed = [(X.stem_of(w), i) for i, w in enumerate(words) if w not in X.STOPWORDS]
    if not placed:
        raise ValueError(f"nothing to search for: {query!r}")
    shifts = spark.createDataFrame(placed, "term string, shift long")
    rows = _read(spark, index, STEM, sorted({t for t, _ in placed})).join(F.broadcast(shifts), "term")  # a query's words
    owners = F.flatten(F.zip_with("ids", "tfs", lambda i, n: F.array_repeat(i, n)))
    each = rows.select("shift", F.explode(F.arrays_zip(owners.alias("id"), F.col("positions").alias("p"))).alias("x"))
    starts = each.select("x.id", (F.col("x.p") - F.col("shift")).alias("start"))
    full = starts.groupBy("id", "start").agg(F.count("*").alias("n")).filter(F.col("n") == len(placed))
    return full.groupBy("id").agg(F.count("*").alias("times"))
