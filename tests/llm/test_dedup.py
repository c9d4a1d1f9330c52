import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from talus.llm import components, exact_dedup, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups_by_hand(rows):
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    top = lambda ds: max(ds, key=lambda d: -(2**63) if d is None else d)
    return sorted((repr((d, top(groups[t or ""]), len(groups[t or ""]), d == top(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest())) for d, t in rows))


def test_exact_groups(docs, sample):
    for table in (docs, sample):
        got = sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in exact_dedup.duplicate_groups(table).collect())
        assert got == groups_by_hand([(r.doc_id, r.text) for r in table.collect()])


def test_exact_keeps_columns_and_one_row_of_repeats(docs, none):
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i) == [2, 4, 5, 6, 7, 8, 9, 10] and ids.count(None) == 1
    assert exact_dedup.duplicate_groups(none).count() == 0 and exact_dedup.deduplicate(none).count() == 0


@pytest.mark.parametrize("rows", [0, 5, 3_000, 30_000_000])
def test_filters_merge_without_loss(rows):
    """Every split of the bits: the shapes of a tiny and of a large table; a few fingerprints repeat, one very often."""
    shape = exact_dedup.Shape(rows)
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 2**64, 500, dtype=np.uint64) >> np.uint64(rng.integers(0, 20)) for _ in range(4)]
    parts += [parts[0][:50], np.full(700, parts[1][0]), np.array([0, 2**64 - 1, 0], np.uint64)]
    filters = []
    for part in parts:
        batches = iter([pa.RecordBatch.from_arrays([pa.array(part.view(np.int64))], ["fp"])])
        filters += exact_dedup.build_filters(batches, shape)
    in_order = sorted(filters, key=lambda x: x.column("block")[0].as_py())
    got = {}
    for out in exact_dedup.merge_filters(iter(in_order), shape):
        got |= dict(zip(out.column("fp").to_pylist(), out.column("copies").to_pylist(), strict=True))
    values, counts = np.unique(np.concatenate(parts), return_counts=True)
    assert got == {int(v.astype(np.int64)): int(c) for v, c in zip(values, counts, strict=True) if c > 1}


def test_exact_with_shuffled_fingerprints(docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    got = sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in exact_dedup.duplicate_groups(docs).collect())
    assert got == groups_by_hand([(r.doc_id, r.text) for r in docs.collect()])


CLASHES = {"lang_pred": "__ID", "keep_id": "__sha", "n_chars": "__nth"}


def test_clashing_columns_pass(docs):
    clash = docs.withColumnsRenamed(CLASHES)
    for stage in (exact_dedup.deduplicate, simhash.keep_one_of_each):
        out = stage(clash)
        assert out.columns == clash.columns
        assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in clash.collect()} and out.count() >= 8


def fingerprint_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(values):
    """value -> smallest value that can be reached by steps of at most 3 bits."""
    values = sorted(set(values))
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if bin(a ^ b).count("1") <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_simhash_documents(docs, sample):
    low_of = lambda x: 2**63 if x is None else x
    for table in (docs, sample.limit(150)):
        rows = [(r.doc_id, fingerprint_by_hand(r.text)) for r in table.collect()]
        part = components_by_hand(p for _, p in rows)
        low = {}
        for d, p in rows:
            low[part[p]] = min(d, low.get(part[p], d), key=low_of)
        want = sorted(repr((d, f"{p:016x}", low[part[p]])) for d, p in rows)
        assert sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in simhash.near_duplicates(table).collect()) == want


def test_links_join_all_that_is_near(spark):
    rnd = random.Random(5)
    values = set()
    for _ in range(40):
        x = rnd.getrandbits(64)
        values.add(x)
        for _ in range(rnd.randint(0, 10)):
            y = x
            for b in rnd.sample(range(64), rnd.randint(1, 5)):
                y ^= 1 << b
            values.add(y)
            x = rnd.choice([x, y])
    x = rnd.getrandbits(64)
    for _ in range(60):  # three bits apart inside one block
        y = x
        for b in rnd.sample(range(22), 3):
            y ^= 1 << b
        values.add(y)
    values |= {0, 2**64 - 1, 7, 2**63}
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    links = simhash.near_links(nodes)
    assert all(bin((r.a ^ r.b) & 2**64 - 1).count("1") <= 3 for r in links.collect())
    part = {r.node: r.component for r in components.connected_components(links).collect()}
    got, want = defaultdict(set), defaultdict(set)
    for v, low in components_by_hand(values).items():
        got[part.get(signed(v), signed(v))].add(v)
        want[low].add(v)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_simhash_empty_and_stage(docs, none):
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one_of_each(none).count() == 0
    kept = simhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 3 in ids and 4 not in ids and 8 in ids and 9 in ids


@pytest.mark.parametrize("edges, want", [([], {}), ([(1, 1)], {}), ([(i, i + 1) for i in range(30)], {i: 0 for i in range(31)}), ([(0, 9), (9, 3), (4, 5)], {0: 0, 9: 0, 3: 0, 4: 4, 5: 4})])
def test_components(spark, edges, want):
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == want
