"""Scoring texts with a Katz backoff bigram model that is trained on the corpus itself.

Tokens are words (A-Z lower-cased) and one end mark for each text. Counts r of 1 to 5 get Katz's Good-Turing discounts
d_r; larger ones are multiplied by 1 - RESERVE, so that every context keeps something to back off with. With c() for
counts over the training texts:
    p(w | v) = d_r * c(v, w) / c(v)       if c(v, w) = r > 0
             = a(v) * p(w)                else, with a(v) such that p(. | v) adds up to one; a(v) = 1 if c(v) = 0
    p(w)     = d_r * c(w) / N             if c(w) = r > 0, else what is left: the probability of an unknown word.

How it is spread out. Each task turns its texts into blocks: for a bucket of words, the pairs (context, word) that occur,
with the texts they occur in. Blocks are partitioned by word, so that a bucket holds all counts of its words and of the
pairs that end in them. Words with a large share of a sample are partitioned by pair, and pairs with a large share by
task too; their totals (bounded lists) are added up over the buckets, so that no word or pair makes a hot partition. The
sample decides where rows go, never what they count. One pass over the buckets gives counts of counts, a second one
scores. In a bucket, log p(w | v) splits into what depends on the pair and on w, known there, and on v: the term
-log c(v) is added where v stands as a word itself. Only pairs that training never saw need a(v); they meet the parts of
a(v) (sums over the words seen after v) in a second exchange by context. The parts of a text's score are added at the end.

Words are known by a 64-bit hash, contexts by 48 bits of it. Shuffled data grows with the input; nothing but the totals of
heavy words and pairs (2 * MOST_HEAVY numbers) and counts of counts goes to the driver.

Defined results: a null or empty text is one end mark; a text of any length is scored whole. Rows that repeat, also in
doc_id alone, are scored each. A null doc_id stays null, and its text is learned from. Nothing depends on an order, so that
there are no ties. With no training text every word is unknown and has probability one. An empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, is_held_out, words

HELD_OUT = (10, 0)
END, START = np.uint64(1), np.uint64(2)
CONTEXT = np.uint64(2**48 - 1)
K = 5
RESERVE = 1e-3
#: Tokens in a bucket, on average (a token with its separator is some six bytes), and in the blocks that a task makes at once.
BUCKET_TOKENS, TOKEN_BYTES, BLOCK_TOKENS = 1_500_000, 6, 2_000_000
#: Heavy means this share of a sample of about SAMPLE texts.
HEAVY_SHARE, SAMPLE, MOST_HEAVY = 1 / 2000, 4000, 2000


def hashed(docs: DataFrame) -> DataFrame:
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out(F.col("doc_id"), *HELD_OUT).alias("held_out"), words(ascii_lower(F.col("text"))).alias("w"))
    return split.select("doc_id", "held_out", F.transform("w", lambda w: F.xxhash64(w)).alias("w"))


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, protocol=5), 1)


def unpack(data: bytes) -> tuple[np.ndarray, ...]:
    return pickle.loads(zstandard.decompress(data))


def spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(33))) >> np.uint64(32)


def pair_key(w: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A 64-bit name of a pair, for routing and for the list of heavy pairs."""
    return (w * np.uint64(0x9E3779B97F4A7C15)) ^ (v * np.uint64(0xC2B2AE3D27D4EB4F))


def home_of(first_row: int, buckets: int) -> int:
    """Where the parts of a batch's scores meet."""
    return int(spread(np.array([first_row], np.uint64))[0] % np.uint64(buckets))


def found(values: np.ndarray, sorted_list: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each value is in the sorted list, and where."""
    if not len(sorted_list):
        return np.zeros(len(values), bool), np.zeros(len(values), np.int64)
    at = np.minimum(np.searchsorted(sorted_list, values), len(sorted_list) - 1)
    return sorted_list[at] == values, at


def starts_of(*keys: np.ndarray) -> np.ndarray:
    """Where a new key begins, in sorted arrays."""
    n = len(keys[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def heavy_lists(tokens: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and pairs (word, context) with a large share of a sample, by word and by pair_key; only the routing depends on it."""
    some = tokens.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, rows // SAMPLE))) == 0)
    after = F.concat("w", F.array(F.lit(int(END)).cast("bigint")))
    before = F.concat(F.array(F.lit(int(START)).cast("bigint")), "w")
    pairs = some.select(F.explode(F.arrays_zip(after.alias("w"), before.alias("v"))).alias("p")).groupBy("p.w", "p.v").agg(F.count("*").alias("n"))
    total = some.agg(F.sum(F.size("w") + 1)).first()[0] or 0
    least = max(2, total * HEAVY_SHARE)
    heavy = pairs.filter(F.col("n") >= least).orderBy(F.desc("n")).limit(MOST_HEAVY).collect()
    alone = pairs.groupBy("w").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n")).limit(MOST_HEAVY).collect()
    as_hash = lambda xs: np.array(xs, np.int64).view(np.uint64)
    heavy_words = np.sort(as_hash([r["w"] for r in alone]))
    w, v = as_hash([r["w"] for r in heavy]), as_hash([r["v"] for r in heavy]) & CONTEXT
    inside = found(w, heavy_words)[0]
    w, v = w[inside], v[inside]
    order = np.argsort(pair_key(w, v))
    return heavy_words, w[order], v[order]


def build_blocks(batch: pa.RecordBatch, first_row: int, salt: int, buckets: int, heavy_words: np.ndarray, heavy_pairs: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(bucket, data) of the texts in a batch: H and the list of its texts once, B and a block for each bucket of words."""
    lists = batch.column("w")
    flat = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    doc_ids, named = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
    held = batch.column("held_out").to_numpy(zero_copy_only=False)
    n, total = len(lengths), len(flat) + len(lengths)
    last = np.cumsum(lengths + 1) - 1
    inner = np.ones(total, bool)
    inner[last] = False
    w = np.full(total, END, np.uint64)
    w[inner] = flat
    inner[:] = True
    inner[last - lengths] = False
    v = np.full(total, START, np.uint64)
    v[inner] = flat
    v &= CONTEXT
    doc = np.repeat(np.arange(n, dtype=np.uint32), lengths + 1)
    heavy = found(w, heavy_words)[0]
    route = w.copy()
    if heavy.any():
        keys = pair_key(w[heavy], v[heavy])
        route[heavy] = keys + np.where(found(keys, heavy_pairs)[0], np.uint64(salt + 1), np.uint64(0))
    bucket = (spread(route) % np.uint64(buckets)).astype(np.uint32)
    order = np.lexsort((v, w, bucket))
    bucket, w, v, doc = bucket[order], w[order], v[order], doc[order]
    yield home_of(first_row, buckets), b"H" + pack(first_row, doc_ids, named, held, lengths + 1)
    edges = np.r_[starts_of(bucket), total] if total else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        mine, which = np.unique(doc[a:b], return_inverse=True)
        pairs = starts_of(w[a:b], v[a:b])
        words_at = starts_of(w[a:b][pairs])
        context = v[a:b][pairs].view(np.uint8).reshape(-1, 8)[:, :6]
        which = which.astype(np.uint16 if len(mine) < 2**16 else np.uint32)
        yield int(bucket[a]), b"B" + pack(w[a:b][pairs][words_at], np.diff(np.r_[words_at, len(pairs)]).astype(np.uint32), np.ascontiguousarray(context.T), np.diff(np.r_[pairs, b - a]).astype(np.uint32), which, first_row, mine, held[mine])


class Block:
    def __init__(self, data: bytes) -> None:
        words_, per_word, context, self.times, self.which, self.first_row, self.mine, held = unpack(data)
        self.w = np.repeat(words_, per_word)
        wide = np.zeros((len(self.w), 8), np.uint8)
        wide[:, :6] = context.T
        self.v = wide.reshape(-1).view(np.uint64)
        self.pairs = len(self.w)
        self.trained = np.add.reduceat((~held[self.which]).astype(np.int32), np.r_[0, np.cumsum(self.times, dtype=np.int64)[:-1]])


class Bucket:
    """All blocks of a bucket, with the counts of their pairs and words, and lists of texts that only pass through."""

    def __init__(self, blocks: list[Block], headers: list[bytes], heavy_words: np.ndarray, heavy_pairs: np.ndarray) -> None:
        self.blocks, self.headers = blocks, headers

        def taken(name: str, kind: type) -> np.ndarray:
            """One array of all blocks', which let go of theirs."""
            out = np.concatenate([np.zeros(0, kind), *(getattr(b, name) for b in blocks)])
            for b in blocks:
                setattr(b, name, None)
            return out

        w, v = taken("w", np.uint64), taken("v", np.uint64)
        order = np.lexsort((v, w))
        w, v = w[order], v[order]
        at = starts_of(w, v)
        self.pair_of = np.empty(len(w), np.int32)
        self.pair_of[order] = np.repeat(np.arange(len(at), dtype=np.int32), np.diff(np.r_[at, len(w)]))
        self.w, self.v = w[at], v[at]
        del w, v
        self.count = np.add.reduceat(taken("trained", np.int32)[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64)
        del order
        at = starts_of(self.w)
        sums = np.add.reduceat(self.count, at) if len(at) else self.count
        self.word_at, self.word_sums = at, sums
        self.word_count = np.repeat(sums, np.diff(np.r_[at, len(self.w)]))
        self.heavy_word, self.word_index = found(self.w, heavy_words)
        inside, self.pair_index = found(pair_key(self.w, self.v), heavy_pairs)
        self.heavy_pair = inside & self.heavy_word

    def statistics(self, n_words: int, n_pairs: int) -> np.ndarray:
        """Counts of counts 1 to K + 1 of words and pairs, distinct words, all without heavy ones; tokens; totals of heavy ones."""
        alone = ~self.heavy_word[self.word_at]
        light = self.count[~self.heavy_pair]
        words_ = self.word_sums[alone]
        return np.concatenate([
            np.bincount(words_[words_ <= K + 1], minlength=K + 2)[1 : K + 2],
            np.bincount(light[light <= K + 1], minlength=K + 2)[1 : K + 2],
            [(words_ > 0).sum(), self.count.sum()],
            np.bincount(self.word_index[self.heavy_word], self.count[self.heavy_word], n_words)[:n_words] if n_words else [],
            np.bincount(self.pair_index[self.heavy_pair], self.count[self.heavy_pair], n_pairs)[:n_pairs] if n_pairs else [],
        ]).astype(np.float64)


def katz_discounts(counts_of_counts: np.ndarray) -> np.ndarray:
    """d_1 to d_K from n_1 to n_(K+1); where the counts are too few for a discount between 0 and 1, r - 1/2 of r."""
    r = np.arange(1, K + 1)
    n = np.asarray(counts_of_counts, np.float64)
    with np.errstate(all="ignore"):
        common = (K + 1) * n[K] / n[0]
        d = ((r + 1) * n[1:] / (r * n[:-1]) - common) / (1 - common)
    return np.where(np.isfinite(d) & (d > 0) & (d < 1), d, (r - 0.5) / r)


class Model:
    """Discounts, totals and the counts of heavy words and pairs."""

    def __init__(self, stats: np.ndarray, heavy_words: np.ndarray, heavy_pairs: np.ndarray, texts: int) -> None:
        self.heavy_words, self.heavy_pairs, self.texts = heavy_words, heavy_pairs, texts
        at = 2 * (K + 1) + 2
        self.word_totals = stats[at : at + len(heavy_words)].astype(np.int64)
        self.pair_totals = stats[at + len(heavy_words) :].astype(np.int64)
        few = lambda x: np.bincount(x[x <= K + 1], minlength=K + 2)[1 : K + 2]
        n_words = stats[: K + 1] + few(self.word_totals)
        n_pairs = stats[K + 1 : 2 * K + 2] + few(self.pair_totals)
        self.vocabulary = int(stats[at - 2]) + int((self.word_totals > 0).sum())
        self.tokens = int(stats[at - 1])
        self.word_discounts, self.pair_discounts = katz_discounts(n_words), katz_discounts(n_pairs)
        small = float((n_words[:K] * np.arange(1, K + 1) * self.word_discounts).sum())
        large = (1 - RESERVE) * (self.tokens - float((n_words[:K] * np.arange(1, K + 1)).sum()))
        self.unknown = 1 - (small + large) / self.tokens if self.tokens else 1.0

    @staticmethod
    def _discount(r: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.where(r <= K, d[np.clip(r, 1, K) - 1], 1 - RESERVE)

    def p_word(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self._discount(c, self.word_discounts) * c / max(self.tokens, 1), self.unknown)

    def mass(self, r: np.ndarray) -> np.ndarray:
        """d_r * r."""
        return self._discount(r, self.pair_discounts) * r

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.vocabulary + 1)))


def score_bucket(bucket: Bucket, model: Model, buckets: int, number: int) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, kind, data): 0: sums for contexts, 1: unseen pairs by context, 2: texts of a batch, 3: parts of their scores."""
    r, c = bucket.count.copy(), bucket.word_count.copy()
    c[bucket.heavy_word] = model.word_totals[bucket.word_index[bucket.heavy_word]]
    r[bucket.heavy_pair] = model.pair_totals[bucket.pair_index[bucket.heavy_pair]]
    p = model.p_word(c)
    value = np.log10(np.where(r > 0, model.mass(np.maximum(r, 1)), p))
    value -= np.where((bucket.w != END) & (c > 0), np.log10(np.maximum(c, 1)), 0)
    base = model.base(c)
    keep = np.flatnonzero((r > 0) & ~bucket.heavy_pair)  # heavy pairs stand in many buckets: see heavy_sums
    yield from _by_context(buckets, 0, bucket.v[keep], p[keep], model.mass(r[keep]), r[keep])
    for data in bucket.headers:
        yield number, 2, data
    at = 0
    for block in bucket.blocks:
        pair = np.repeat(bucket.pair_of[at : at + block.pairs], block.times)
        at += block.pairs
        n = len(block.mine)
        sums = (np.bincount(block.which, c[pair] > 0, n).astype(np.int64), np.bincount(block.which, base[pair], n), np.bincount(block.which, value[pair], n))
        yield home_of(block.first_row, buckets), 3, pack(block.first_row, block.mine, *sums)
        unseen = np.flatnonzero(r[pair] == 0)
        if len(unseen):
            yield from _by_context(buckets, 1, bucket.v[pair[unseen]], block.first_row + block.mine[block.which[unseen]].astype(np.int64))


def heavy_sums(model: Model, w: np.ndarray, v: np.ndarray, buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """What the heavy pairs (2000 at most) add to the sums of their contexts."""
    r, c = model.pair_totals, model.word_totals[found(w, model.heavy_words)[1]] if len(w) else np.zeros(0, np.int64)
    keep = np.flatnonzero(r > 0)
    yield from _by_context(buckets, 0, v[keep], model.p_word(c[keep]), model.mass(r[keep]), r[keep])


def _by_context(buckets: int, kind: int, v: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    to = (spread(v) % np.uint64(buckets)).astype(np.uint32)
    order = np.lexsort((v, to))
    to, v = to[order], v[order]
    columns = [x[order] for x in columns]
    edges = np.r_[starts_of(to), len(to)]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        part, mine = v[a:b], [x[a:b] for x in columns]
        if kind == 0:
            at = starts_of(part)
            part, mine = part[at], [np.add.reduceat(x, at) for x in mine]
        else:  # the same context again and again in one text
            order_ = np.lexsort((mine[0], part))
            part, rows = part[order_], mine[0][order_]
            at = starts_of(part, rows)
            part, mine = part[at], [rows[at], np.diff(np.r_[at, b - a]).astype(np.uint32)]
        yield int(to[a]), kind, pack(part, *mine)


def back_off(sums: list[bytes], needs: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """log c(v) + log a(v) of all unseen pairs, added up by text."""
    nothing = [np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), np.zeros(0, np.int64)]
    v, p, mass, count = (np.concatenate(x) for x in zip(*(unpack(s) for s in sums), strict=True)) if sums else nothing
    order = np.argsort(v, kind="stable")
    at = starts_of(v[order])
    context = v[order][at]
    p, mass, count = (np.add.reduceat(x[order], at) if len(at) else x for x in (p, mass, count))
    weight = np.log10(np.maximum(count - mass, 1e-300) / np.maximum(1 - p, 1e-300))  # log10(c(v) * a(v))
    rows, added = [], []
    for data in needs:
        v, row, times = unpack(data)
        known, where = found(v, context)
        rows.append(row[known])
        added.append(weight[where[known]] * times[known])
    mine, which = np.unique(np.concatenate(rows), return_inverse=True)
    if len(mine):
        zero = np.zeros(len(mine), np.int64)
        yield mine, np.full(len(mine), -(2**63), np.int64), zero.astype(bool), zero.astype(bool), zero, zero, zero.astype(np.float64), np.bincount(which, np.concatenate(added), len(mine))


def whole_texts(headers: list[bytes], parts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """The parts of the scores of each batch's texts, added up."""
    batches = {}
    for data in headers:
        first_row, doc_ids, named, held, n_tokens = unpack(data[1:])
        n = len(doc_ids)
        batches[first_row] = (first_row + np.arange(n), doc_ids, named, held, n_tokens, np.zeros(n, np.int64), np.zeros(n), np.zeros(n))
    for data in parts:
        first_row, mine, *sums = unpack(data)
        for total, part in zip(batches[first_row][5:], sums, strict=True):
            total[mine] += part
    yield from batches.values()


PARTS = "row_id long, doc_id long, named boolean, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each whole text."""
    spark = docs.sparkSession
    tokens = hashed(docs)
    held = is_held_out(F.col("doc_id"), *HELD_OUT)
    seen = docs.agg(F.count("*"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1), F.count_if(~held)).first()
    rows, size, texts = (x or 0 for x in seen)
    buckets = max(8, int(size) // (BUCKET_TOKENS * TOKEN_BYTES) + 1)
    heavy_words, heavy_w, heavy_v = heavy_lists(tokens, rows)
    heavy_pairs = pair_key(heavy_w, heavy_v)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            edges = np.searchsorted(np.cumsum(pc.list_value_length(batch.column("w")).to_numpy(zero_copy_only=False) + 1), BLOCK_TOKENS * np.arange(1, batch.num_rows + 1))
            edges = np.unique(np.r_[0, edges, batch.num_rows])
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                for bucket, data in build_blocks(batch.slice(lo, hi - lo), (task << 40) + row, task, buckets, heavy_words, heavy_pairs):
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([data], pa.binary())], ["bucket", "data"])
                row += hi - lo

    # One bucket in a partition; an RDD of it, since its shuffle files then serve both passes over the buckets.
    placed = tokens.mapInArrow(blocks, "bucket int, data binary").repartitionById(buckets, "bucket").rdd

    def by_bucket(records: Iterator[tuple[int, bytes]]) -> Iterator[tuple[int, Bucket]]:
        waiting: dict[int, list[bytes]] = {}
        for number, data in records:
            waiting.setdefault(number, []).append(bytes(data))
        for number in list(waiting):
            mine = waiting.pop(number)
            yield number, Bucket([Block(x[1:]) for x in mine if x[:1] == b"B"], [x for x in mine if x[:1] == b"H"], heavy_words, heavy_pairs)

    width = 2 * (K + 1) + 2 + len(heavy_words) + len(heavy_pairs)
    stats = placed.mapPartitions(lambda x: (b.statistics(len(heavy_words), len(heavy_pairs)) for _, b in by_bucket(x))).treeAggregate(np.zeros(width), np.add, np.add)
    model = Model(stats, heavy_words, heavy_pairs, texts)
    scored = placed.mapPartitions(lambda x: (out for number, b in by_bucket(x) for out in score_bucket(b, model, buckets, number)))
    extra = spark.sparkContext.parallelize(list(heavy_sums(model, heavy_w, heavy_v, buckets)), 1)
    met = spark.createDataFrame(scored.union(extra), "bucket int, kind int, data binary", verifySchema=False).repartitionById(int(buckets), "bucket")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[bytes], ...]] = {}
        names = [x.split()[0] for x in PARTS.split(", ")]
        for batch in batches:
            for number, kind, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held.setdefault(number, ([], [], [], []))[kind].append(data)
        for number in list(held):
            sums, needs, headers, parts = held.pop(number)
            for rows in (*whole_texts(headers, parts), *(back_off(sums, needs) if needs else ())):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names)

    parts = met.mapInArrow(finish, PARTS)
    whole = parts.groupBy("row_id").agg(F.max("doc_id").alias("doc_id"), F.max("named").alias("named"), F.max("held_out").alias("held_out"), *(F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")))
    # Every text starts after the start mark, whose count is the number of training texts.
    start = float(np.log10(texts)) if texts else 0.0
    return whole.select(F.when(F.col("named"), F.col("doc_id")).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", (F.col("score") - start).alias("score"))
