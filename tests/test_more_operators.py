"""More fixtures with known outcomes, and operators without SQL against brute force."""

import datetime as dt
import hashlib
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from talus.functions import references, text, tumblers
from talus.operators import aspects, catalog, chunking, fulltext, graph, lineage, notes, predicates, ranking, results, search, tables, taxonomy
from talus.plans import library
from talus.streaming import jobs


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


VECTORS = [(i, [float(np.cos(0.3 * i * i)), float(np.sin(0.3 * i * i)), 0.1 * i]) for i in range(40)]


def cosine(a, b):
    a, b = np.array(a), np.array(b)
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


def test_limits_and_nearest_query_inside_batches(spark, monkeypatch):
    chunks = spark.createDataFrame(VECTORS, "id long, embedding array<double>")
    asked = chunks.filter("id < 7").withColumn("most", F.when(F.col("id") % 2 == 0, 0.2).otherwise(0.9))
    want = sorted((q, i) for q, a in VECTORS[:7] for i, b in VECTORS if 1 - cosine(a, b) <= (0.2 if q % 2 == 0 else 0.9))
    best = sorted((i, min(range(7), key=lambda q: (round(1 - cosine(VECTORS[q][1], b), 12), q))) for i, b in VECTORS)
    for block in (10_000, 3):
        monkeypatch.setattr(search, "BLOCK_QUERIES", block)
        assert values(search.distances(asked, chunks, None, query_key="id", most="most"), "query_id", "id") == want
        assert values(search.closest_query(asked, chunks, query_key="id"), "id", "query_id") == best
        assert search.closest_query(asked.limit(0), chunks, query_key="id").count() == 0


def test_text_gate_with_many_similar_words(spark, monkeypatch):
    rows = [(i, f"the word is relea{c}ed here under a licen{d}e") for i, (c, d) in enumerate(itertools.product("stvx", "cs"))] + [(99, "nothing"), (98, None), (97, "released")]
    docs = spark.createDataFrame(rows, "id long, text string")
    few = values(search.text_matches(docs, "released license"), "id")
    with monkeypatch.context() as m:  # tokens in place of a pattern
        m.setattr(search, "PATTERN_WORDS", 0)
        assert values(search.text_matches(docs, "released license"), "id") == few
    whole = spark.createDataFrame([(1, "Licence: license."), (2, "a_license licenses7"), (3, "sublicense")], "id long, text string")
    assert values(search.text_matches(whole, "license", gate=1.0), "id") == [(1,)]
    monkeypatch.setattr(search, "FEW_WORDS", 1)
    assert values(search.text_matches(docs, "released license"), "id") == few and (1,) in few and (97,) not in few
    assert search.text_matches(docs, "zzz license").count() == 0 and search.text_matches(docs, "the of").count() == 0


def test_ranks_over_parts(spark):
    rnd = random.Random(4)
    rows = [(i, rnd.choice([0.5, rnd.random()])) for i in range(300)]
    order = [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))]
    df = spark.createDataFrame(rows, "id long, d double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in (1, 20):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = [r.id for r in tables.ranks(df, "d", "id", "rank").orderBy("rank").collect()]
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert got == order
    assert tables.ranks(df.limit(0), "d", "id", "rank").count() == 0


def test_one_model(spark):
    good = spark.createDataFrame([("a", "m", 3), ("b", "m", 3)], "collection string, model string, dimension int")
    search.one_model(good)
    with pytest.raises(ValueError, match="different models"):
        search.one_model(good.union(spark.createDataFrame([("c", "n", 3)], good.schema)))
    chunks = spark.createDataFrame([(1, "a", [1.0, 0.0, 0.0]), (2, "b", [0.0, 1.0, 0.0]), (3, "c", [1.0, 0.0, 0.0])], "id long, collection string, embedding array<double>")
    every = good.union(spark.createDataFrame([("c", "n", 3)], good.schema))
    assert values(search.in_collections(chunks.filter("id = 1"), chunks, every, ["a", "b"], 5, query_key="id"), "id") == [(1,), (2,)]
    with pytest.raises(ValueError):
        search.in_collections(chunks.filter("id = 1"), chunks, every, ["a", "c"], 5, query_key="id")


def test_contradictions_need_less_than_the_limit(spark):
    far = np.arccos(0.7)
    rows = [(0, 1, "x", "a", [1.0, 0.0]), (0, 2, "x", "b", [0.99, 0.01]), (0, 3, "x", "b", [0.0, 1.0]), (0, 4, "y", "b", [1.0, 0.0]), (0, 5, "x", "", [1.0, 0.0]), (1, 1, "x", "a", [1.0, 0.0]), (1, 6, "x", "b", [float(np.cos(far)), float(np.sin(far))])]
    hits = spark.createDataFrame(rows, "query_id int, id int, collection string, agent string, embedding array<double>")
    assert values(ranking.contradictions(hits).filter("contradicted"), "query_id", "id") == [(0, 1), (0, 2)]
    (row,) = hits.filter("query_id = 1 AND id = 6").collect()
    limit = 1 - cosine([1.0, 0.0], row.embedding)
    assert ranking.contradictions(hits.filter("query_id = 1"), least=limit).filter("contradicted").count() == 0
    assert ranking.contradictions(hits.filter("query_id = 1"), least=limit + 1e-9).filter("contradicted").count() == 2


def ward_by_hand(points, k):
    """Merge the two clusters whose union adds least to the squared error, counted anew each time."""
    error = lambda c: ((points[c] - points[c].mean(axis=0)) ** 2).sum()
    clusters = [[i] for i in range(len(points))]
    while len(clusters) > k:
        a, b = min(itertools.combinations(range(len(clusters)), 2), key=lambda p: error(clusters[p[0]] + clusters[p[1]]) - error(clusters[p[0]]) - error(clusters[p[1]]))
        clusters[a] += clusters.pop(b)
    return sorted(map(sorted, clusters))


def test_clusters_of_results(spark):
    points = np.random.default_rng(2).normal(size=(23, 4))
    rows = [(q, i, float(i), points[i].tolist()) for q, n in ((0, 23), (1, 2), (2, 1), (3, 7)) for i in range(n)]
    hits = spark.createDataFrame(rows, "query_id int, id int, distance double, embedding array<double>")
    out = results.cluster_results(hits).collect()
    for q, n, k in ((0, 23, 5), (1, 2, 2), (2, 1, 1), (3, 7, 2)):
        mine = [r for r in out if r.query_id == q]
        got = sorted(sorted(r.id for r in mine if r.cluster == c) for c in {r.cluster for r in mine})
        assert got == ward_by_hand(points[:n], k) and len(mine) == n
        for r in mine:
            assert r.label == str(min(x.id for x in mine if x.cluster == r.cluster))
    assert results.cluster_results(hits.limit(0)).count() == 0


def test_topics_are_found_and_split(spark):
    rnd = np.random.default_rng(3)
    centres = np.eye(4)
    rows = [(i, (centres[i % 4] + 0.05 * rnd.normal(size=4)).tolist(), i % 2) for i in range(80)]
    chunks = spark.createDataFrame(rows, "id long, embedding array<double>, topic_id int")
    found = dict(values(taxonomy.nearest_means(chunks.withColumn("c", F.lit("c")), "c", F.lit(4)), "id", "topic_id"))
    assert len(found) == 80 and len({(i % 4, t) for i, t in found.items()}) == 4
    parts = values(taxonomy.split_topic(chunks, 1, 2), "id", "topic_id", "child")
    assert {i for i, _, _ in parts} == {i for i in range(80) if i % 2} and len({(i % 4, c) for i, _, c in parts}) == 2
    assert tuple(one(spark, *(taxonomy.cluster_count(n) for n in (4, 5, 100, 10_000)))) == (0, 5, 10, 33)


def test_greedy_topic_matching_equals_brute_force(spark):
    rnd = np.random.default_rng(5)
    old, new = ([(i, v.tolist()) for i, v in enumerate(rnd.normal(size=(n, 3)))] for n in (9, 7))
    frame = lambda rows: spark.createDataFrame(rows, "topic_id int, embedding array<double>")
    want, left = {}, sorted((-round(cosine(a, b), 12), i, j) for i, a in old for j, b in new if cosine(a, b) >= 0.1)
    for _, i, j in left:
        if i not in want and j not in want.values():
            want[i] = j
    assert dict(values(taxonomy.match_topics(frame(old), frame(new), 0.1), "old_id", "new_id")) == want
    manual = spark.createDataFrame([(100 + i, i) for i in range(9)], "id long, topic_id int")
    chunks = spark.createDataFrame([(100 + i, new[i % 7][1]) for i in range(8)], "id long, embedding array<double>")
    moved = {r.id: (r.topic_id, r.route) for r in taxonomy.carry_over(manual, frame(old), frame(new), chunks, 0.1).collect()}
    for i in range(9):
        expected = (want[i], "matched") if i in want else (i % 7, "nearest") if i < 8 else None
        assert moved.get(100 + i) == expected
    labelled = frame(old).withColumn("label", F.concat(F.lit("t"), "topic_id")).withColumn("review_status", F.lit("accepted"))
    merged = {r.topic_id: (r.label, r.review_status) for r in taxonomy.merge_labels(labelled, frame(new), 0.1).collect()}
    back = {j: i for i, j in want.items()}
    assert merged == {j: (f"t{back[j]}", "accepted") if j in back else (None, "pending") for j, _ in new}


def test_choice_keeps_to_the_first_run_within_the_band(spark):
    schema = "query_id int, id int, confidence double, rank long"
    costs = spark.createDataFrame([(1, 9.0), (2, 1.0), (3, 0.5), (5, 2.0)], "id int, cost double")
    pick = lambda rows: values(library.choose(spark.createDataFrame([(0, *r) for r in rows], schema), costs), "id")
    assert pick([(1, 0.80, 1), (2, 0.78, 2), (3, 0.60, 3)]) == [(2,)]
    assert pick([(1, 0.60, 1), (3, 0.80, 2), (2, 0.59, 3)]) == [(1,)]  # demoted from above: the run ends there
    assert pick([(1, 0.60, 1), (2, 0.65, 2)]) == [(2,)] and pick([(4, 0.60, 1), (6, 0.60, 2)]) == [(4,)] and pick([(4, 0.60, 1), (1, 0.58, 2)]) == [(1,)]
    assert pick([(1, None, 1), (2, None, 2)]) == [(1,)]


def test_plan_candidates(spark):
    schema = "id int, query string, description string, tags string, embedding array<double>, scope_tags string, grown boolean, project string, successes int, failures int, dimensions map<string,string>"
    plan = lambda i, scope="", grown=False, project=None, ok=1, bad=0, verb="research", v=(1.0, 0.0): (i, f"plan {i}", "finds papers by an author", "papers", list(v), scope, grown, project, ok, bad, {"verb": verb, "domain": "prose"})
    plans = spark.createDataFrame([plan(1), plan(2, "Docs__a,code"), plan(3, "code__x"), plan(4, grown=True), plan(5, grown=True, project="p"), plan(6, ok=0, bad=3), plan(7, verb="debug"), plan(8, "docs__", v=(0.0, 1.0))], schema)
    ids = lambda *a: [r[0] for r in values(library.candidates(plans, *a), "id")]
    assert ids(None, None) == [1, 2, 3, 4, 5, 7, 8] and ids({"verb": "query"}, None) == [1, 2, 3, 4, 5, 8] and ids({"verb": "debug", "domain": "prose"}, None) == [7]
    assert ids(None, "docs__a") == [1, 2, 5, 7, 8] and ids(None, "docs__") == [1, 2, 5, 7, 8] and ids(None, "docs") == [1, 5, 7] and ids(None, "all") == [1, 4, 5, 7]
    asked = spark.createDataFrame([(0, "PLAN  8 ", [1.0, 0.0]), (1, "papers author", [-1.0, 0.0]), (2, "xyzzy", [-1.0, 0.0])], "query_id int, text string, embedding array<double>")
    got = library.match_or_text(asked, plans, "docs__a", 3).collect()
    assert [(r.id, round(r.score, 4)) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0] == [(8, 1.15), (2, 1.15), (1, 1.0)]
    assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 1] == [1, 2, 5] and all(r.confidence is None for r in got if r.query_id == 1)
    assert not [r for r in got if r.query_id == 2]


def test_usable_plans(spark):
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [(1, day(1), None, None, 1, 0, None), (2, day(1), None, 5, 1, 0, None), (3, day(1), day(28), 5, 1, 0, None), (4, day(1), None, None, 0, 3, None), (6, day(1), None, None, 0, 2, None), (7, day(1), None, None, 0, 1, None), (8, day(1), None, None, 1, 9, None), (5, day(1), None, None, 0, 0, day(2))]
    plans = spark.createDataFrame(rows, "id int, created_at timestamp, last_used timestamp, ttl_days int, successes int, failures int, disabled_at timestamp")
    assert values(library.usable(plans, day(31)), "id") == [(1,), (3,), (6,), (7,), (8,)]


def windows_by_hand(body, lines, overlap, most):
    """The longest window that fits, found by trying every end."""
    rows = [piece for line in body.splitlines() for piece in (chunking.split_line(line, most) if len(line.encode()) > most else [line])]
    out, start = [], 0
    while True:
        end = next(e for e in range(min(start + lines, len(rows)), start, -1) if e == start + 1 or len("\n".join(rows[start:e]).encode()) <= most)
        out.append((start + 1, end, "\n".join(rows[start:end])))
        if end == len(rows):
            return out
        start += max(1, int((end - start) * (1 - overlap)))


@pytest.mark.parametrize("least", [0.5, 0.7])
def test_overlaps_by_several_first_words_equal_brute_force(spark, least):
    """All pairs that are alike, though sets that share too few of their first words are not compared; nothing is shuffled to find these."""
    rnd = random.Random(4)
    base = [rnd.sample(range(60), rnd.randint(1, 25)) for _ in range(40)]
    sets = base + [[w if rnd.random() > 0.2 else rnd.randrange(60) for w in rnd.choice(base)] for _ in range(80)]
    rows = [(i, rnd.choice(["p", None]), " ".join(f"w{x:03}" for x in s)) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "id long, project string, content string")
    share = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    got = {(r.a, r.b): r.similarity for r in notes.overlapping(df, "id", "content", least, "project").collect()}
    first = {}
    for i, project, text in rows:
        first.setdefault((project, *sorted(set(text.split()))), i)
    own = {i: first[(project, *sorted(set(text.split())))] for i, project, text in rows}
    pairs = {(x[0], y[0]): share(x[2].split(), y[2].split()) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1]}
    want = {k: v for k, v in pairs.items() if v >= least and (own[k[0]] == k[0] and own[k[1]] in k)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    reps = spark.createDataFrame([(i, [*range(i, i + 30)]) for i in range(50)], "rep long, words array<long>")
    assert "Exchange" not in notes._rarest_first(reps, least)._jdf.queryExecution().executedPlan().toString()


def test_questions_and_plans_of_the_same_words_make_no_product(spark):
    """All pairs would be a thousand million rows."""
    plans = spark.range(100_000).selectExpr("id", "'find parts' AS query", "IF(id < 3, 'of late orders', 'of orders') AS description", "'' AS tags", "'' AS scope_tags", "false AS grown", "'p' AS project", "map('verb', 'query') AS dimensions", "0 AS failures", "0 AS successes")
    asked = spark.range(5000).selectExpr("id AS query_id", "IF(id % 2 = 0, 'parts orders', 'orders late the find') AS text")
    got = library.match_text(asked, plans, k=4).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("r"))
    want = {0: [3, 4, 5, 6], 1: [0, 1, 2]}
    rows = got.collect()
    assert len(rows) == 5000 and all([tuple(x) for x in r.r] == [*enumerate(want[r.query_id % 2], 1)] for r in rows)


def test_line_windows_keep_to_bytes(spark):
    rnd = random.Random(6)
    bodies = ["\n".join("x" * rnd.randint(0, 60) for _ in range(rnd.randint(1, 80))) for _ in range(20)] + ["", "a b " * 13_000, "y" * 50_000, "p;" * 10_000, "é" * 30]
    df = spark.createDataFrame([*enumerate(bodies), (len(bodies), "a\r\nb\rc\n"), (len(bodies) + 1, None)], "id int, t string")
    for lines, most in ((10, 200), (150, chunking.MOST_BYTES)):
        got = {}
        for r in chunking.line_windows(df, "id", "t", lines, most=most).orderBy("id", "chunk_index").collect():
            got.setdefault(r.id, []).append((r.line_start, r.line_end, r.text))
            assert len(r.text.encode()) <= most
        for i, body in enumerate(bodies[:-1]):
            assert got.get(i, []) == (windows_by_hand(body, lines, 0.15, most) if body else [])
        assert [r[2] for r in got[len(bodies)]] == ["a\nb\nc"] and len(bodies) + 1 not in got
    assert "".join(chunking.split_line("a b " * 100, 50)) == "a b " * 100 and all(p.endswith(" ") for p in chunking.split_line("a b " * 100, 50))
    assert chunking.split_line("ab" * 20 + ";" + "c" * 30, 45)[0] == "ab" * 20 + ";" and chunking.split_line("z" * 100, 40) == ["z" * 40, "z" * 40, "z" * 20]


def test_line_windows_without_a_limit_of_bytes(spark, tmp_path):
    long = "é;" * 40_000
    bodies = ["><".join(["x", long, "", "a\rb\u2028c"] * 10 + [""]), "", None, "one\nline", "><".join(map(str, range(37)))]
    df = spark.createDataFrame([*enumerate(bodies)], "page_id long, html string")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    want = []
    for i, body in enumerate(bodies):
        if body is not None:
            lines = body.replace("\n", " ").split("><")
            starts = [s for s in range(0, len(lines), 17) if s == 0 or s + 3 < len(lines)]
            want += [(i, n, s + 1, min(s + 20, len(lines)), hashlib.sha256("\n".join(lines[s : s + 20]).encode()).hexdigest()) for n, s in enumerate(starts)]
    assert sorted(tuple(r) for r in __spark_entry__.queries()["line_windows"](spark, str(tmp_path)).collect()) == want


def test_header_paths(spark):
    df = spark.createDataFrame([(1, "intro\n# A\n## B\nx\n### C\n## D\n# E\ntail"), (2, "no header"), (3, "# A\n```sh\n# not a header\n```\n~~~~\n# nor this\n~~~\n## nor\n~~~~\n## B #\nTitle\n=====\n"), (4, "  \n"), (5, None)], "id int, t string")
    got = [(r.header, r.path) for r in chunking.sections(df, "id", "t").orderBy("id", "section_index").collect()]
    assert got == [("", []), ("A", ["A"]), ("B", ["A", "B"]), ("C", ["A", "B", "C"]), ("D", ["A", "D"]), ("E", ["E"]), ("", []), ("A", ["A"]), ("B", ["A", "B"]), ("Title", ["Title"])]


def test_aspect_rules(spark):
    criteria = ["trained on ImageNet", "compared with BM25", "reports accuracy", "uses an algorithm", "focuses on drift", "published at a journal", "in the year 2023", "anything else"]
    field = aspects.asked_field(F.col("value"))
    asked = spark.createDataFrame([*criteria, "papers trained on TPC-C", "the dataset is TPC-DS", "of the and", None], "string").select("value", field.alias("f"), aspects.asked_needle(F.col("value"), field).alias("n")).collect()
    assert [r.f for r in asked[:8]] == ["experimental_datasets", "experimental_baselines", "experimental_results", "proposed_method", "problem_formulation", "extras.venue", "extras.year", None]
    assert [r.n for r in asked[8:]] == ["papers", "TPC-DS", None, None]
    phrases = spark.createDataFrame([*["count distinct items", "Count", "avg confidence", "the mean confidence", "max confidence", "minimum confidence"]], "string")
    row = phrases.crossJoin(spark.createDataFrame([(5, 2, 0.4, 0.1, 0.9)], "items long, distinct_items long, avg_confidence double, min_confidence double, max_confidence double"))
    assert [r[0] for r in row.select(aspects.reduced(F.col("value"))).collect()] == [2, 5, 0.4, 0.4, 0.9, 0.1]
    facts = spark.createDataFrame([("paxos", {"venue": "VLDB", "year": "2023"}, ["YCSB"]), ("raft", {"venue": "OSDI"}, [])], "p string, extras map<string,string>, experimental_datasets array<string>")
    items = spark.createDataFrame([("paxos",), ("raft",), ("gone",)], "p string")
    assert values(aspects.criterion_filter(items, facts, ["p"], F.lit("the venue is vldb")), "p", "matched") == [("gone", False), ("paxos", True), ("raft", False)]
    assert values(aspects.item_filter(items, facts, ["p"], "extras", "osdi"), "p", "matched") == [("gone", False), ("paxos", False), ("raft", True)]
    assert values(aspects.item_groups(items, facts, ["p"], "extras.venue"), "p", "group") == [("gone", "unassigned"), ("paxos", "VLDB"), ("raft", "OSDI")]
    for bad in ("nothing", "other.entry"):
        with pytest.raises(ValueError):
            aspects.item_filter(items, facts, ["p"], bad, "x")
    each = spark.createDataFrame([("paxos", "trained on ycsb"), ("raft", "the venue is vldb"), ("gone", "in the year 2023")], "p string, asks string")
    assert values(aspects.criterion_filter(each, facts, ["p"], F.col("asks")), "p", "matched", "rationale") == [("gone", False, "no aspects"), ("paxos", True, "experimental_datasets holds ycsb"), ("raft", False, "no match")]
    with pytest.raises(Exception, match="no aspect or no search term"):
        aspects.criterion_filter(items, facts, ["p"], F.lit("anything else")).collect()
    with pytest.raises(Exception, match="no reducer"):
        row.select(aspects.reduced(F.lit("sum of squares"))).collect()
    nested = spark.createDataFrame([("paxos", {"a": {"b": "deep"}}), ("raft", {})], "p string, extras map<string,map<string,string>>")
    text = nested.select("p", F.to_json("extras").alias("extras"))
    for kind in (nested, text, text.withColumn("extras", F.parse_json("extras"))):
        assert values(aspects.item_filter(items, kind, ["p"], "extras.a.b", "DEE"), "p", "matched") == [("gone", False), ("paxos", True), ("raft", False)]


def test_copies_make_no_pairs_of_their_own(spark):
    rows = [(i, "alpha beta gamma delta") for i in range(60)] + [(100 + i, "alpha beta gamma delta epsilon") for i in range(40)] + [(200, "to be"), (201, None)]
    df = spark.createDataFrame(rows, "id long, content string")
    got = values(notes.overlapping(df, "id", "content", 0.7), "a", "b", "similarity")
    assert len(got) == 59 + 39 + 1 and (0, 100, 0.8) in got and (0, 59, 1.0) in got and (100, 139, 1.0) in got
    scoped = notes.put_or_merge(spark.createDataFrame([(1, "p", "one two three four"), (2, "q", "one two three four")], "id long, project string, content string"), spark.createDataFrame([(9, "q", "one two three four five")], "id long, project string, content string"), scope="project")
    assert dict(values(scoped, "id", "content")) == {1: "one two three four", 2: "one two three four\none two three four five"}


def overlap_by_hand(rows, least):
    sets = {i: {w for w in (t or "").lower().split() if len(w) > 2 and w not in notes.FILLERS} for i, t in rows}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}


def test_overlaps_equal_brute_force(spark):
    rnd = random.Random(8)
    words = [f"word{i}" for i in range(30)]
    rows = [(i, " ".join(rnd.sample(words, rnd.randint(1, 9)))) for i in range(120)]
    rows += [(1000 + i, " ".join(rnd.sample(t.split(), len(t.split())))) for i, t in rows[:40]]
    pairs = {(r.a, r.b): r.similarity for r in notes.overlapping(spark.createDataFrame(rows, "id long, content string"), "id", "content", 0.6).collect()}
    rep = {}
    for (a, b), s in pairs.items():
        if s == 1:
            rep[b] = a
    classes = {i: [j for j, _ in rows if rep.get(j, j) == rep.get(i, i)] for i, _ in rows}
    full = {tuple(sorted(p)) for i, _ in rows for p in itertools.combinations(classes[i], 2)}
    full |= {tuple(sorted((x, y))) for (a, b), s in pairs.items() if s < 1 for x in classes[a] for y in classes[b]}
    assert full == overlap_by_hand(rows, 0.6)


def test_note_titles(spark):
    rows = spark.createDataFrame([(1, "p", "plan", dt.datetime(2024, 1, 1)), (2, "p", "plan b", dt.datetime(2024, 1, 3)), (3, "p", "notes", dt.datetime(2024, 1, 2)), (4, "q", "plan", dt.datetime(2024, 1, 2))], "id long, project string, title string, ts timestamp")
    asked = spark.createDataFrame([("p", "plan"), ("p", "pla"), ("p", "not"), ("q", "x")], "project string, asked string")
    assert values(notes.resolve(rows, asked), "project", "asked", "matches") == [("p", "not", 1), ("p", "pla", 2), ("p", "plan", 1), ("q", "x", 0)]
    assert dict(values(notes.resolve(rows, asked).filter("id IS NOT NULL"), "asked", "id")) == {"plan": 1, "not": 3}
    assert [r.id for r in notes.listed(rows, "p").collect()] == [2, 3, 1] and notes.projects(rows, "").count() == 0 and values(notes.projects(rows, "p"), "project", "notes") == [("p", 3)]
    assert values(notes.get(rows, "q", "plan"), "id") == [(4,)]


def test_references(spark):
    texts = ["see 10.1000/x9 and DOI: 10.1145/12.7).", "(10.5555/abc).", "https://doi.org/10.1/x 10.4444/Y", "none 10.12/x", None]
    got = [one(spark, references.doi(F.lit(t).cast("string"))).c0 for t in texts]
    assert got == ["10.1145/12.7", "10.5555/abc", "10.4444/Y", None, None]
    texts = ["papers/deep-2503.07641v2.pdf", "arXiv: 2101.00001v3 text", "see 2101.12345v1.", "Page 2024.34567", None]
    assert [one(spark, references.arxiv(F.lit(t).cast("string"))).c0 for t in texts] == ["2503.07641", "2101.00001", "2101.12345", None, None]
    row = one(spark, references.uri_fault(F.lit("https://x/y")), references.uri_fault(F.lit("/plain")), references.uri_fault(F.lit("ftp://x")), references.uri_fault(F.lit("")), references.source_uri(F.lit(""), F.lit("a/b.py"), F.lit("/repo/")), references.source_uri(F.lit(None).cast("string"), F.lit("/a"), F.lit("/r")), references.source_uri(F.lit(""), F.lit(""), F.lit("/r")))
    assert tuple(row) == (None, "no scheme", "unknown scheme", None, "file:///repo/a/b.py", "file:///a", "")
    row = one(spark, references.scope_tags(F.lit(" rdr__delta-0123abCD, all,code__x-*,docs*,,docs")), references.newest_first(F.lit("2024-01-09T00")), references.is_minified(F.lit("a/HTMX.min.JS")), references.is_minified(F.lit("a.js")), references.has_shebang(F.lit("#!/bin/sh")))
    assert tuple(row) == ("code__x,docs,rdr__delta", "7975-98-90T99", True, False, True)


def test_spans_by_characters(spark):
    digest = "ab" * 32
    text_of = lambda span: one(spark, tumblers.span_text(F.lit(span), F.lit("hello world"))).c0
    assert [text_of(s) for s in (f"chash:{digest}", f"chash:{digest}:0-5", f"{digest}:6-99", f"{'ab' * 16}:3-3")] == ["hello world", "hello", "world", ""]


def test_asked_parts_of_prompts():
    long = "You are a helpful system. " * 20
    assert text.query_from(" short ") == "short" and text.query_from("") == ""
    assert text.query_from(long + "\nWhat is a quotient filter?\nThanks") == "What is a quotient filter?"
    assert text.query_from(long + "\nこれは何ですか、とても長い質問です？\n") == "これは何ですか、とても長い質問です？"
    assert text.query_from(long + "Where does it go? Then more words follow.") == "Where does it go?"
    assert text.query_from(long + "\nlast line with words\nok") == "last line with words"
    assert len(text.query_from("x" * 900)) == 500


def test_salient_sentences(spark):
    body = "Apples are red. The quick fox jumps! Is the fox quick? nothing new. Bears eat honey and the quick fox."
    got = one(spark, text.salient(F.lit(body), ["quick fox", "honey bears"], 2)).c0
    assert got == ["The quick fox jumps!", "Is the fox quick? nothing new."]
    assert one(spark, text.salient(F.lit(""), ["a"], 2)).c0 == []


def test_numeric_fields_compare_as_numbers():
    assert predicates.conditions_of(["bib_year=2020", "page_count!=07", "venue=2020", "x>=3", "y>='3'"]) == {"$and": [{"bib_year": {"$eq": 2020}}, {"page_count": {"$ne": 7}}, {"venue": {"$eq": "2020"}}, {"x": {"$gte": 3.0}}, {"y": {"$gte": "3"}}]}


def test_links_by_hand_and_by_rule(spark):
    edges = spark.createDataFrame([(1, 2, "cites"), (1, 2, "relates"), (3, 4, "cites")], "from_id long, to_id long, link_type string")
    pairs = spark.createDataFrame([(1, 2)], "from_id long, to_id long")
    assert values(graph.unlink(edges, pairs), "from_id") == [(3,)] and values(graph.unlink(edges, pairs, "cites"), "link_type") == [("cites",), ("relates",)]
    many = spark.range(11).select("id", F.lit(0).alias("to_id"))
    with pytest.raises(ValueError, match="more than 10"):
        graph.bulk_unlink(many, F.col("id") >= 0)
    assert graph.bulk_unlink(many, F.col("id") >= 0, confirmed=True).count() == 0 and graph.bulk_unlink(many, F.col("id") >= 1).count() == 1
    docs = spark.createDataFrame([(1, "1.1.1", "a.py", "T", None), (2, "1.1.2", "b.py", "T", None), (5, "1.1.5", "a.py", None, dt.datetime(2024, 1, 1))], "id long, tumbler string, path string, title string, deleted_at timestamp")
    asked = spark.createDataFrame([(1, "1.1.2", "cites"), (1, "1.1.5", None), (1, "9.9", "cites"), (1, "xyz", "cites"), (7, "1.1.2", "cites")], "from_id long, target string, link_type string")
    assert values(graph.auto_links(asked, docs, edges), "from_id", "target", "outcome") == [(1, "1.1.2", "exists"), (1, "1.1.5", "created"), (1, "9.9", "missing"), (1, "xyz", "invalid"), (7, "1.1.2", "missing")]
    assert values(graph.links_for_file(edges, docs, "a.py"), "to_id", "direction") == [(2, "out"), (2, "out")] and graph.links_for_file(edges, docs, "b.py").count() == 2
    names = spark.createDataFrame([("1.1.2",), ("a.py",), ("T",), ("1.1.5",)], "asked string")
    assert values(graph.resolve(names, docs).filter("id IS NOT NULL"), "asked", "id", "by") == [("1.1.2", 2, "tumbler"), ("T", 1, "title"), ("a.py", 1, "path")]
    manifest = spark.createDataFrame([(2, 70), (2, 71), (2, 70)], "doc_id long, chunk_id long")
    found = graph.reached(spark.createDataFrame([(1,), (99,)], "node long"), edges, docs.withColumn("collection", F.lit("c")), manifest, link_types=["cites"])
    assert values(found.filter("id IS NOT NULL"), "tumbler", "id") == [("1.1.2", 70), ("1.1.2", 71)] and values(found, "tumbler")[0] == ("1.1.1",)


def test_gaps_and_loose_chunks(spark):
    docs = spark.createDataFrame([(1, "c", 3, "h", "A"), (2, "c", 0, "h", "A"), (3, "c", 0, "", "B"), (4, "", 0, "h", ""), (5, "c", 1, "", "C")], "id long, collection string, chunk_count int, content_hash string, title string")
    manifest = spark.createDataFrame([(1, 0, 10), (5, 0, 11)], "doc_id long, position long, chunk_id long")
    assert values(catalog.gaps(docs, manifest), "id", "expected", "have", "ghost") == [(1, 3, 1, False), (2, 0, 0, True)]
    chunks = spark.createDataFrame([(20, 2, "C"), (21, 1, "C"), (22, 1, ""), (23, 1, None), (24, 1, "Z"), (21, 1, "C")], "chunk_id long, chunk_index long, title string").withColumn("collection", F.lit("c"))
    elsewhere = chunks.withColumn("collection", F.lit("d"))
    assert not values(catalog.link_loose(manifest, docs, elsewhere, "title", "title"), "doc_id")
    counts = ("collection", "linked_chunks", "linked_docs", "loose_chunks", "loose_groups")
    assert values(catalog.loose_groups(docs, chunks.union(elsewhere), "title", "title"), *counts) == [("c", 2, 1, 3, 2), ("d", 0, 0, 5, 3)]
    assert values(catalog.link_loose(manifest, docs, chunks, "title", "title"), "doc_id", "position", "chunk_id") == [(5, 1, 21), (5, 2, 20)]


def test_replay_and_bounded_files(spark, tmp_path):
    lines = [{"k": "a", "n": 1, "v": "x", "gone": False}, {"k": "a", "n": 2, "v": "y", "gone": False}, {"k": "b", "n": 1, "v": "z", "gone": False}, {"k": "b", "n": 2, "v": "z", "gone": True}]
    (tmp_path / "log.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    got = jobs.replay(spark, str(tmp_path / "log.jsonl"), "k string, n long, v string, gone boolean", ["k"], "n", "gone")
    assert values(got, "k", "v") == [("a", "y")]
    spark.range(1000).select("id", (F.col("id") % 2).alias("collection")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, collection long").parquet(str(tmp_path / "in"))
    jobs.append_chunks(stream, str(tmp_path / "out"), str(tmp_path / "state"), most=100).awaitTermination()
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 100


def test_small_tables_are_spread(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "one"))
    assert lineage.spread(spark.read.parquet(str(tmp_path / "one"))).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert values(lineage.spread(spark.range(3)), "id") == [(0,), (1,), (2,)]


STEMS = {
    "license": "licens", "licenses": "licens", "licensed": "licens", "licensing": "licens", "classes": "class", "ponies": "pony", "pony": "pony",
    "hopping": "hop", "hopped": "hop", "need": "need", "status": "status", "class": "class", "red": "red", "as": "as", "café": "café", "v2ing": "v2ing",
}


def test_stems_and_folds(spark):
    words = [(w, s) for w, s in STEMS.items()]
    got = spark.createDataFrame(words, "w string, s string").select("s", text.stem(F.col("w")))
    assert all(a == b for a, b in got.collect())
    assert all(text.stem_of(w) == s for w, s in words)
    texts = ["Élève ẾTRE", "e\u0301te\u0301", "Ёлка ά", "naïve ﬁ ß", ""]
    assert [text.folded_word(t) for t in texts] == ["eleve etre", "ete", "елка α", "naive ﬁ ß", ""]
    got = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string").select("i", text.folded(F.col("t")))
    assert values(got, *got.columns) == [(i, t) for i, t in enumerate([*map(text.folded_word, texts), ""])]


def test_text_search_over_fields(spark):
    rows = [
        (1, "Releasing the licenses", "a.b.Planner", "rdr,review"), (2, "a license", "x", "released"), (3, None, "the", None), (4, "planned", None, "the"),
        (5, "RELEASED license", "released", "licenses"), (5, "RELEASED license", "released", "licenses"), (6, "relicensed released", "", ""),
    ]
    docs = spark.createDataFrame(rows, "id int, content string, title string, tags string")
    find = lambda q, prose, plain=None: values(fulltext.matches(docs, q, prose, plain).select("id", F.round("score", 6).alias("score")), "id", "score")
    assert find("license release", {"content": "B"}) == [(1, 0.4), (5, 0.4), (5, 0.4)]
    # Fields of prose add up, the heaviest one counts.
    assert find("release license", {"content": "B", "title": "A"}) == [(1, 0.4), (5, 0.7), (5, 0.7)]
    assert find("release license", {"content": "B", "tags": "D"}) == [(1, 0.4), (2, 0.25), (5, 0.4), (5, 0.4)]
    # Words of dotted titles; plain fields keep endings and stopwords.
    assert find("planner", None, {"title": "C"}) == [(1, 0.2)]
    assert find("the", {"content": "A"}, {"title": "C", "tags": "D"}) == [(3, 0.2), (4, 0.1)]
    assert find("licens", None, {"tags": "A"}) == []
    assert find("released", {"content": "D"}, {"tags": "A"}) == [(1, 0.1), (2, 1.0), (5, 0.1), (5, 0.1), (6, 0.1)]
    for asked, plain in (("the", None), ("", {"tags": "A"}), (" ,.", {"tags": "A"})):
        with pytest.raises(ValueError, match="nothing to search"):
            fulltext.matches(docs, asked, {"content": "A"}, plain)
    assert fulltext.matches(docs.limit(0), "license", {"content": "A"}).count() == 0
