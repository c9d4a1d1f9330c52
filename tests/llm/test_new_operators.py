"""Packing, ranked search and conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from pyspark.sql import functions as F

from talus.llm import lexical, packing, queries, repair

SPECIAL = {"<|endoftext|>": 50256}
PATHS = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, SPECIAL)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_library(library):
    """All code points, in several neighbourhoods, and long runs."""
    encoder = packing.Encoder(*PATHS)
    texts = []
    for lo in range(0, 0x110000, 64):
        chars = [chr(c) for c in range(lo, lo + 64) if not 0xD800 <= c < 0xE000]
        texts.append("".join(f"a{c}b {c}1{c}  {c} .{c}{c}\n{c} '{c}s" for c in chars))
    texts += ["<|endoftext|>", " <|endoftext|><|endoftext|> x", "y" * 30_000, " " * 3000 + "z", "\n " * 2000, "ab?" * 5000, "", "<|endo<|endoftext|>"]
    want = [e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    assert all(encoder.ids(t).tolist() == w for t, w in zip(texts, want, strict=True))


def padding(n, size):
    return 0 if n & (n - 1) == 0 else size - n


@pytest.mark.parametrize("size", [4, 8, 16])
def test_cuts_are_the_cheapest(size):
    rng = random.Random(size)
    for _ in range(200):
        ends = np.cumsum([rng.randint(1, 3 * size) for _ in range(rng.randint(1, 6))])
        sentences = np.array(sorted(rng.sample(range(1, ends[-1] + 1), rng.randint(0, min(6, ends[-1])))), np.int64)
        at, cost = packing.places(ends, sentences, size)
        best = {0: 0}
        for p, c in zip(at.tolist()[1:], cost.tolist()[1:], strict=True):
            best[p] = min(best[q] + padding(p - q, size) + c + packing.EACH for q in best if 0 < p - q <= size)
        cuts = packing.cheapest_cuts(at, cost, size).tolist()
        assert cuts[-1] == ends[-1]
        costs = dict(zip(at.tolist(), cost.tolist(), strict=True))
        assert sum(padding(b - a, size) + costs[b] + packing.EACH for a, b in itertools.pairwise([0, *cuts])) == best[ends[-1]]


def check_packing(rows, library, size=1024):
    """Every id of every document in exactly one piece, pieces without gaps in their sequences."""
    by_doc, by_sequence = {}, {}
    for text, found in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for r in sorted(found, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
            by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert at == len(ids)
        by_doc[text] = len(ids)
    lost = total = 0
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
        lost, total = lost + padding(at, size), total + at
    return lost, total


def test_packing_of_the_sample(sample, library):
    texts = {r.doc_id: r.text for r in sample.collect()}
    got = {}
    for r in packing.pack(sample, *PATHS).collect():
        got.setdefault(r.doc_id, []).append(r)
    lost, total = check_packing([(texts[d], got[d]) for d in texts], library)
    assert set(got) == set(texts) and lost < 0.01 * total


def test_packing_of_hard_rows(docs, none, library):
    got = packing.pack(docs.coalesce(1), *PATHS).collect()
    assert packing.pack(none, *PATHS).count() == 0
    starts = [i for i, r in enumerate(sorted(got, key=lambda r: (r.sequence_id, r.offset))) if r.start == 0]
    assert len(starts) == docs.count()  # repeated rows and the null doc_id are packed each
    assert sum(r.length for r in got) == sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs.collect())
    assert [(r.length, r.doc_tokens) for r in got if r.doc_id in (3, 4)] == [(1, 1), (1, 1)]
    # A long row alone is cut into full sequences: the memory of a portion is that of its documents.
    long = packing.pack(docs.filter("doc_id = 6"), *PATHS).collect()
    assert sum(r.length == 1024 for r in long) >= len(long) - 2


# Ranked search


def brute_search(docs, items, k=20):
    import math

    split = [(d, re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for d, t in docs]
    split = [(d, Counter(ts), len(ts)) for d, ts in split if ts]
    n_docs, length = len(split), sum(n for _, _, n in split)
    df = Counter(t for _, c, _ in split for t in c)
    out = []
    for item, text in set(items):
        terms = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        scored = []
        for d, c, n in split:
            m = 75 + (25 * n * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms if t in c)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def search_rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


@pytest.mark.parametrize("first, postings, block", [(1, 50, 40), (4, 300, 10**6), (256, 10**6, 10**6)])
def test_search_equals_brute_force(spark, monkeypatch, first, postings, block):
    """Small reads, parts and blocks give the same as large ones; ties, repeated rows, null ids and texts, hot terms."""
    monkeypatch.setattr(lexical, "FIRST", first)
    monkeypatch.setattr(lexical, "POSTINGS", postings)
    monkeypatch.setattr(lexical, "BLOCK_BYTES", block)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["Ünder", "中文", "a1"]
    docs = [(i, " ".join(["the"] * rng.randint(0, 3) + rng.choices(words, k=rng.randint(0, 12)))) for i in range(300)]
    docs += [(None, "w1 w2 the"), (None, None), (7, "w3, W3! w4"), (7, "w3, W3! w4"), (900, ""), (901, "...")] + [(1000 + i, "w1 w2 w3") for i in range(60)]
    items = [(i, " ".join(rng.choices([*words, "the", "THE", "absent"], k=6))) for i in range(8)] + [(3, "w1"), (3, "w1"), (None, "w2-w2 中文"), (99, None), (98, "absent")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(1)).repartition(3)
    got = lexical.search(table, spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("x")))
    assert search_rows(got) == brute_search(docs, items)


def test_search_of_empty_tables(spark, none, docs):
    items = spark.createDataFrame([(1, "the dog")], "item_id long, text string")
    assert lexical.search(none, items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert search_rows(lexical.search(docs, items)) == brute_search([(r.doc_id, r.text) for r in docs.collect()], [(1, "the dog")])


def test_bounds_close_before_lists_end():
    """A rare term decides: the long list of a weak one is not read to its end when all that may be best is final."""
    read = []

    class Watched(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, slice) and key.stop and key.start:
                read.append(key.stop)
            return super().__getitem__(key)

    many = np.arange(100_000)
    weak = np.full(100_000, 1).view(Watched)
    got = lexical.resolve([(np.arange(20), np.arange(1020, 1000, -1)), (many, weak)], 100_000, 20, 0)
    assert (got[:20] == np.arange(1021, 1001, -1)).all() and max(read, default=0) < 100_000


# Conversation repair


def cost_of(rows, audit):
    """What an audit costs and the role initials it leads to, or None if it isn't possible; initials of new rows are free to be right."""
    spoken, cost, i = [], 0, 0
    for x in audit:
        if x == "I":
            spoken.append("*")
            cost += 5
            continue
        if i == len(rows):
            return None
        initial, must_go, truncated = rows[i]
        i += 1
        if x == "D":
            cost += 2
            continue
        if must_go:
            return None
        cost += 5 * truncated + (x == "R")
        spoken.append("*" if x == "R" else initial)
    if i < len(rows):
        return None
    body = spoken[1:] if spoken and spoken[0] == "s" else spoken
    right = len(body) % 2 == 0 and all(x in ("*", "ua"[k % 2]) for k, x in enumerate(body)) and (bool(body) or not spoken)
    return cost if right else None


def brute_repair(rows):
    best = None
    for inserts in range(3):
        for kinds in itertools.product("DKR", repeat=len(rows)):
            for places in itertools.combinations_with_replacement(range(len(rows) + 1), inserts):
                audit = "".join("I" * places.count(i) + x for i, x in enumerate([*kinds, ""]))
                cost = cost_of(rows, audit)
                if cost is not None:
                    best = min(best or (cost, audit), (cost, audit))
    return best


def parsed(rows):
    parser = repair.Parser()
    for row in rows:
        parser.push(*row)
    cost, edits, tail = parser.finish()
    return cost, ("".join(edits) + tail).translate(repair.INITIALS)


def test_parser_equals_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        rows = [(rng.choice("uuaas? "), rng.random() < 0.15, rng.random() < 0.15) for _ in range(rng.randint(0, 5))]
        assert parsed(rows) == brute_repair(rows), rows


def brute_summary(rows):
    """rows: (turn, role, text) of one conversation, damaged."""
    key = lambda r: hashlib.sha256("\n".join([b"1".hex().upper(), "null" if r[0] is None else str(r[0]).encode().hex().upper(), r[1].encode().hex().upper(), r[2]]).encode()).hexdigest()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], key(r)))
    seen, marks, counts = set(), [], Counter()
    for _, role, text in rows:
        end = text.rstrip(" \t\n\v\f\r")[-1:]
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""
        seen.add((role, text))
        counts[fault] += 1
        marks.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marks))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = parsed(marks)
    spoken, i = [], 0
    for x in audit:
        if x != "D":
            place = len(spoken) - (1 if spoken and spoken[0][:1] == "s" else 0)
            name = ("user", "assistant")[place % 2]
            spoken.append(f"{name}:" if x == "I" else f"{rows[i][1] if x == 'K' else name}:{rows[i][2]}")
        i += x != "I"
    return gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(spoken).encode()).hexdigest()


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("seed", range(3))
def test_summaries_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = ["Hi.", "Yes!", "cut off", " ", "", "ok? ", "Long " * 50 + "end."]
    rows = [(rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(["user", "assistant", "system", "tool", " ", ""]), rng.choice(texts)) for _ in range(rng.randint(5, 14))]
    rows += [rows[0]] * 4
    table = spark.createDataFrame([(1, *r, "x") for r in rows], "conv_id long, turn long, role string, text string, digest string").repartition(4)
    ids = spark.createDataFrame([(1,), (2,), (None,)], "conv_id long")
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in repair.summaries(table, ids).collect()}
    assert got[1] == brute_summary(rows)
    assert got[2] == got[None] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repair_of_null_and_long_conversations(spark):
    """A null conversation, null roles and texts, one conversation of 30,000 turns, a row that comes 20,000 times."""
    odd = spark.createDataFrame([(None, None, None, None), (None, 1, "user", "a.")], "conv_id long, turn long, role string, text string")
    long = spark.range(30_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat("id", F.lit(".")).alias("text"))
    same = spark.range(20_000).select(F.lit(2).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("Same.").alias("text"))
    every = odd.union(long).union(same)
    got = {r.conv_id: r for r in repair.summaries(every, every.select("conv_id").distinct()).collect()}
    assert (got[1].cost, got[1].audit, got[1].illegal) == (0, "K" * 30_000, 0)
    assert got[1].repaired_sha256 == hashlib.sha256("\n".join(f"{'user' if i % 2 == 0 else 'assistant'}:{i}." for i in range(30_000)).encode()).hexdigest()
    assert (got[2].duplicate, got[2].illegal, got[2].cost) == (19_999, 19_999, 2 * 20_000) and set(got[2].audit) == {"D"}
    assert (got[None].blank, got[None].cost, got[None].audit) == (1, 4, "DD")
    assert repair.summaries(every.limit(0), every.select("conv_id").limit(0)).count() == 0
    turns = [(r.role, r.text) for r in repair.repaired_turns(every.filter("conv_id = 1")).orderBy("place", "part").take(2)]
    assert turns == [("user", "0."), ("assistant", "1.")]


def test_queries_are_registered():
    assert {"op11_packing", "op12_lexical_search", "op13_conversation_repair"} <= set(queries.queries())
