"""Ranked lexical search by NRA: impact-sorted lists are read in order, and each document has an interval for its score.

The terms of a text are its runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. One pass over the texts
keeps each document's number of terms and how often it holds terms that the items ask for; it is written to the shared
folder. Its sums (documents, terms, documents of a term) give weights and impacts, all whole numbers.

The ranking reads that table where it lies, without a shuffle. A task sorts a part's postings by term and falling impact. For an
item it reads the lists of its terms in turn, in growing blocks. What was read of a document is the lower bound of its
score; the upper bound adds, for each list in which it wasn't seen yet, the impact at which that list stands. Reading ends when every
document whose upper bound reaches the k-th lower bound has both bounds equal, so that members, ties and scores are final. The best
k so far go on to the task's next part. The tasks' best are cut to k for each item, first by hashes of the documents, then in all.

Items are asked in blocks of about `BLOCK_BYTES` of text, which the driver hands to the tasks; their number grows with the items.

Defined results: a null text has no terms. Items that repeat in all columns are one item; others are ranked each, whatever their item_id.
Repeated documents are ranked each. Of equal scores the smaller doc_id comes first, null ones last. A document without any asked term has
score 0 and isn't returned; an item without terms, or an empty table, returns no rows. Columns other than doc_id, item_id and
text, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

BEST = 20
BLOCK_BYTES = 4_000_000
#: Postings and documents of a part, and postings that are read of each list first.
POSTINGS, DOCUMENTS, FIRST = 2_000_000, 50_000, 256
#: Hashes by which the tasks' best are cut first.
SALTS = 32
#: Upper case to lower case, and ASCII other than letters and digits to a blank.
TABLE = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256)).lower()


def terms(raw: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return raw.translate(TABLE).split()


def count_terms(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, tfs): a document's number of terms, and the numbers of asked terms with how often it holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ends, found, often = [], [0], [], []
            for raw in batch.column("raw"):
                words = terms(raw.as_buffer().to_pybytes()) if raw.is_valid else []
                sizes.append(len(words))
                for word, tf in Counter(words).items():
                    if word in numbers:
                        found.append(numbers[word])
                        often.append(tf)
                ends.append(len(found))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, pa.int32())) for x in (found, often)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def document_frequencies(counted: DataFrame, known: int) -> np.ndarray:
    """In how many documents each of the `known` numbers is; a task sends what it has of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(known, np.int64)
        for batch in batches:
            held += np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=known)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["term", "df"])

    out = np.zeros(known, np.int64)
    for row in counted.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row for each asked term
        out[row["term"]] = row["df"]
    return out


def first(scores: np.ndarray, documents: np.ndarray, null: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best: high scores, then small ids, null ones last."""
    return np.lexsort((documents, null, -scores))[:k]


def resolve(lists: list[tuple[np.ndarray, np.ndarray]], documents: int, k: int, least: int) -> np.ndarray:
    """Scores of `documents` documents, final for all that may be among the k best and reach `least`.

    A list has documents, each once, and what the term adds to their scores, falling. Others' scores are lower bounds.
    """
    lower, read, size = np.zeros(documents, np.int64), 0, FIRST
    while True:
        for held, adds in lists:
            lower[held[read : read + size]] += adds[read : read + size]
        read, size = read + size, 2 * size
        lists = [(held, adds) for held, adds in lists if len(adds) > read]
        upper = lower + sum(int(adds[read]) for _, adds in lists)
        for held, adds in lists:
            upper[held[:read]] -= adds[read]
        limit = max(least, int(np.partition(lower, -k)[-k]) if documents >= k else 0)
        if not ((upper >= limit) & (upper > lower)).any():
            return lower


def rank_block(counted: DataFrame, items: list[tuple[int | None, dict[int, int]]], df: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """(item, item_id, doc_id, score): the best of each task, for each item."""
    weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        best = [(none, none, none.astype(bool))] * len(items)  # scores, ids, null ids

        def rank(part: list[pa.RecordBatch]) -> None:
            whole = pa.Table.from_batches(part).combine_chunks()
            null = whole["doc_id"].is_null().to_numpy()
            ids = whole["doc_id"].fill_null(0).to_numpy()
            n, term, tf = whole["n"].to_numpy(), whole["terms"].combine_chunks(), whole["tfs"].combine_chunks()
            of = np.repeat(np.arange(len(ids)), term.value_lengths().to_numpy())
            term, tf = term.flatten().to_numpy(), tf.flatten().to_numpy().astype(np.int64)
            m = 75 + (25 * n * documents) // length
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * m[of])
            order = np.lexsort((of, -impact, term))
            of, impact, starts = of[order], impact[order], np.searchsorted(term[order], np.arange(len(weight) + 1))
            for i, (_, asked) in enumerate(items):
                scores, names, nulls = best[i]
                lists = [(of[starts[t] : starts[t + 1]], impact[starts[t] : starts[t + 1]] * (weight[t] * c)) for t, c in asked.items() if weight[t] and starts[t] < starts[t + 1]]
                if not lists:
                    continue
                got = resolve(lists, len(ids), k, int(scores[-1]) if len(scores) == k else 0)
                some = np.flatnonzero(got >= max(1, int(np.partition(got, -k)[-k]) if len(got) >= k else 1))
                scores, names, nulls = np.append(scores, got[some]), np.append(names, ids[some]), np.append(nulls, null[some])
                keep = first(scores, names, nulls, k)
                best[i] = scores[keep], names[keep], nulls[keep]

        part, held, rows = [], 0, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                piece = batch.slice(lo, 1000)
                part.append(piece)
                held, rows = held + len(piece.column("terms").flatten()), rows + piece.num_rows
                if held >= POSTINGS or rows >= DOCUMENTS:
                    rank(part)
                    part, held, rows = [], 0, 0
        if part:
            rank(part)
        for i, (scores, names, nulls) in enumerate(best):
            if len(scores):
                same = len(scores)
                yield pa.RecordBatch.from_arrays([pa.array([i] * same, pa.int32()), pa.array([items[i][0]] * same, pa.int64()), pa.array(names, mask=nulls), pa.array(scores)], ["item", "item_id", "doc_id", "score"])

    return counted.mapInArrow(run, "item int, item_id long, doc_id long, score long")


def cut_to(rows: DataFrame, keys: list, k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = BEST) -> DataFrame:
    """Each item's k best documents: item_id, rank, doc_id, score."""
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("raw")).distinct()
    size = asked.agg(F.sum(F.octet_length("raw"))).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    out = []
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("item_id", "raw"), F.lit(blocks)) == b).collect()  # about BLOCK_BYTES
        counts = [(row["item_id"], Counter(terms(bytes(row["raw"] or b"")))) for row in block]
        numbers = {term: i for i, term in enumerate(sorted({t for _, c in counts for t in c}))}
        counted = cut(count_terms(docs, numbers))
        documents, length = counted.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
        if not numbers or not documents:
            continue
        df = document_frequencies(counted, len(numbers))
        found = rank_block(counted, [(name, {numbers[t]: c for t, c in held.items()}) for name, held in counts], df, documents, length, k)
        found = cut_to(cut_to(found, ["item", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))], k), ["item"], k)
        out.append(found.select("item_id", "rank", "doc_id", "score"))
    empty = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, out) if out else empty


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
sizes AS (SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n FROM d WHERE len(ts) > 0),
sums AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
items AS (SELECT row_number() OVER () AS i, * FROM (SELECT DISTINCT item_id, text FROM benchmark)),
asked AS (
  SELECT i, item_id, term, count(*) AS c FROM (
    SELECT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM items) GROUP BY ALL),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, sums GROUP BY term, docs),
scores AS (
  SELECT i, item_id, doc_id, r, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN sizes USING (r), sums GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 20
"""
