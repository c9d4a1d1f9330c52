import hashlib
import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from talus.llm import chat, mixing, winnowing

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TRICKY = ["", None, "</s>[INST] ok [/INST]", "\\", "\\\\<s>", "<<s>", "<\\s>", "[ROLE]x[/ROLE] ", "[INST] a [/INST]", "<", "s>", "[", "a\nb", "😀 é", "[/ROLE] [/ROLE] ", "x" * 100_000]


def turns_of(spark, rows):
    return chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("role", F.coalesce("role", F.lit(""))))


def test_chat_round_trip(spark):
    rows = [(c, t, role, text) for c, role in enumerate(["user", "assistant", "system", "", "[/ROLE] ", "tool\\"]) for t, text in enumerate(TRICKY)]
    rows += [(9, i, "assistant" if i % 2 else "user", x) for i, x in enumerate(TRICKY)]
    out = {r.conv_id: r for r in chat.read_back(turns_of(spark, rows)).collect()}
    for conv in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == conv]
        assert [(t.role, t.text) for t in out[conv].turns] == [(r[2], r[3] or "") for r in mine]
        assert out[conv].loss_text == "".join(r[3] or "" for r in mine if r[2] == "assistant")


def test_chat_control_strings_are_marks_only(spark):
    (row,) = turns_of(spark, [(1, 0, "user", "</s><s>[INST]"), (1, 1, "assistant", "<s>[ROLE]")]).collect()
    assert [row.formatted.count(x) for x in ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]")] == [2, 2, 1, 1, 0]


def test_chat_layouts(spark):
    records = [
        (1, '{"messages":[{"role":"user","content":"hi, \\"you\\": [1]"},{"content":null,"role":"assistant"}]}'),
        (2, '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}'),
        (3, '{"instruction":"do","input":"x","output":"y"}'),
        (4, '{"output":"y","instruction":"do"}'),
        (5, '{"system":"s","prompt":"p","response":"r"}'),
        (6, '{"turn":3,"text":"t","role":"tool"}'),
        (7, '{"other":1}'),
        (8, "no json"),
        (9, None),
    ]
    df = spark.createDataFrame(records, "conv_id long, record string")
    got = {}
    for r in sorted(chat.canonical_turns(df).collect()):
        got.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    assert got == {
        1: [(0, "user", 'hi, "you": [1]'), (1, "assistant", "")],
        2: [(0, "user", "a"), (1, "assistant", "b")],
        3: [(0, "user", "do"), (1, "user", "x"), (2, "assistant", "y")],
        4: [(0, "user", "do"), (1, "assistant", "y")],
        5: [(0, "system", "s"), (1, "user", "p"), (2, "assistant", "r")],
        6: [(3, "tool", "t")],
    }
    assert sum(r.rows for r in chat.unmapped(df).collect()) == 3
    assert chat.read_back(chat.format_turns(chat.canonical_turns(df.limit(0)))).count() == 0


def goals_by_hand(sizes):
    """Target of each source: shares by weight, full sources set aside until none is above three times its size."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: 1 + i % 3 for i, s in enumerate(order)}
    goal, total, open_ = {}, sum(sizes.values()), set(order)
    while True:
        left = total - sum(goal.values())
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not full:
            return goal | share
        goal |= {s: 3.0 * sizes[s] for s in full}
        open_ -= full


def test_mix_budgets(docs, sample, none):
    for table in (docs, sample):
        rows = mixing.mix(table).collect()
        assert len(rows) == table.count()
        sizes, taken, target = {}, {}, {}
        for r in rows:
            sizes[r.source] = sizes.get(r.source, 0) + r.size
            taken[r.source] = taken.get(r.source, 0) + r.taken
            target[r.source] = r.target
            assert r.taken <= 3 * r.size and r.source_size >= r.size
        goal = goals_by_hand(sizes)
        order = list(goal)
        for s in order:
            assert math.isclose(goal[s], target[s], rel_tol=1e-9, abs_tol=1e-6) and abs(taken[s] - target[s]) <= 1
    assert sorted(map(repr, mixing.mix(sample).collect())) == sorted(map(repr, mixing.mix(sample.repartition(7)).collect()))
    assert mixing.mix(none).count() == 0 and mixing.mixture(none).count() == 0


def copies_of(table):
    """Rows of the mixture, each as often as it comes."""
    return Counter(repr(r) for r in mixing.mixture(table).collect())


def test_mixture_takes_each_row_as_often_as_the_mix(spark, docs, sample):
    clash = docs.withColumnsRenamed({"lang": "__id", "lang_pred": "__N", "keep_id": "__copy", "n_chars": "size"})
    for table in (docs, clash, sample, docs.limit(0)):
        rows = mixing.mix(table).collect()
        want = Counter()
        for r in rows:
            want[r.doc_id, r.source] += r.copies + (r.part > 0)
        got = Counter((r.doc_id, r.source) for r in mixing.mixture(table).collect())
        assert got == +want and mixing.mixture(table).columns == table.columns
        assert copies_of(table) == copies_of(table.repartition(5))
    # One doc_id for texts of different sizes: each row has its own place and no budget is passed.
    same = spark.createDataFrame([(1, "a " * n, s) for s in ("x", "y") for n in range(1, 30)], "doc_id long, text string, source string")
    target = {r.source: r.target for r in mixing.mix(same).collect()}
    words = Counter()
    for r in mixing.mixture(same).collect():
        words[r.source] += len(r.text.split())
    assert all(target[s] <= words[s] < target[s] + 30 for s in target)


def winnow_by_hand(text, k=winnowing.GRAM, w=winnowing.WINDOW):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    hashes = [signed(xxhash.xxh64_intdigest(g.encode(), seed=42)) for g in grams]
    out = []
    for i in range(max(1, len(hashes) - w + 1)) if hashes else []:
        window = hashes[i : i + w]
        at = i + max(j for j, h in enumerate(window) if h == min(window))
        if not out or out[-1][1] != at + 1:
            out.append((hashes[at], at + 1))
    return out


def signed_hash(text):
    h = xxhash.xxh64_intdigest(text.encode(), seed=42)
    return h - 2**64 if h >= 2**63 else h


def fingerprints_by_hand(table):
    rows = sorted(((r.doc_id, r.text or "") for r in table.collect()), key=lambda r: (-(-(2**63) if r[0] is None else r[0]), signed_hash(r[1]), r[1]))
    want = []
    for i, (d, text) in enumerate(rows):
        follow = rows[(i + 1) % len(rows)][1]
        m = len(text) // 3
        edited = text[: len(text) - m] + follow[:m]
        a, b, c = (winnow_by_hand(t) for t in (text, edited, follow))
        like = lambda x, y: 1.0 if not x | y else len(x & y) / len(x | y)
        sets = [{h for h, _ in x} for x in (a, b, c)]
        spell = lambda x: ",".join(f"{h & 2**64 - 1:x}:{p}" for h, p in x)
        want.append((d, len(text), hashlib.sha256(edited.encode()).hexdigest(), spell(a), spell(b), round(like(sets[0], sets[1]), 9), round(like(sets[0], sets[2]), 9)))
    return sorted(map(repr, want))


def fingerprints_of(table):
    return sorted(repr((*r[:5], round(r.near_edited, 9), round(r.near_next, 9))) for r in winnowing.fingerprints(table).collect())


@pytest.mark.parametrize("range_rows", [winnowing.RANGE_ROWS, 3])
def test_winnowing(docs, sample, none, monkeypatch, range_rows):
    monkeypatch.setattr(winnowing, "RANGE_ROWS", range_rows)
    for table in (docs, sample, docs.withColumnsRenamed({"lang": "range", "source": "__w", "keep_id": "tie"})):
        assert fingerprints_of(table) == fingerprints_by_hand(table)
    assert winnowing.fingerprints(none).count() == 0


@pytest.mark.parametrize("range_rows", [250, 5])
def test_winnowing_ranges(spark, monkeypatch, range_rows):
    """Sparse ids with outliers, a third of null ids, a third of one id, and repeated rows: right results from ranges that stay small."""
    monkeypatch.setattr(winnowing, "RANGE_ROWS", range_rows)
    if range_rows == 5:  # heads of ranges by a shuffle
        monkeypatch.setattr(winnowing, "BROADCAST_ROWS", 10)
    ids = [*range(1, 100), 10**15, -(10**15), -(2**63), 2**63 - 1, *[None] * 100, *[77] * 100]
    rows = [(d, f"text {i} of the row with many words in it {i * 7} and an end {i % 3}") for i, d in enumerate(ids)] + [(77, "again and again the same words in a row here")] * 5
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert fingerprints_of(table) == fingerprints_by_hand(table)
    sizes = [r["count"] for r in winnowing.with_next(table).groupBy("range").count().collect()]
    assert sum(sizes) >= len(rows) and (range_rows > 5 or max(sizes) <= 25 and len(sizes) > 30)
