"""Fixtures with known outcomes: nulls, ties, empty tables, errors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from talus.functions import scores, text, tumblers, vectors
from talus.operators import aspects, catalog, chunking, graph, keyed, notes, predicates, ranking, search, tables, taxonomy
from talus.plans import library
from talus.sources import exchange
from talus.streaming import jobs


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_text_gate_before_vectors(spark):
    chunks = spark.createDataFrame([
        ("c1", "tenant isolation policy", [1.0, 0.0]), ("c2", "the policy of tenant isolation", [0.6, 0.8]), ("c3", "isolation policy for a tenant", [0.8, 0.6]),
        ("c4", "nothing alike", [0.995, 0.0998749]), ("c5", "other words", [0.0, 1.0]), ("c6", "tenant policy isolation", [-1.0, 0.0]),
    ], "id string, text string, embedding array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0])], "q int, embedding array<double>")
    for query in ("tenant isolation policy", "tenant isolaton policy"):
        got = search.hybrid(asked, chunks, query, 10, query_key="q").orderBy("rank").collect()
        assert [r.id for r in got] == ["c1", "c3", "c2", "c6"] and [round(r.distance, 6) for r in got] == [0, 0.2, 0.4, 2]
    assert search.hybrid(asked, chunks, "zzqq xkcd glorp", 10, query_key="q").count() == 0
    assert search.hybrid(asked, chunks, "the of and", 10, query_key="q").count() == 0


def test_nearest_edges(spark):
    chunks = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(9, [2.0, 0.0])], "q long, embedding array<double>")
    assert values(search.nearest(asked, chunks, 3, query_key="q"), "id", "distance", "rank") == [(1, 1.0, 3), (2, 0.0, 1), (3, 0.0, 2)]
    assert search.nearest(asked, chunks.limit(0), 3, query_key="q").count() == 0
    assert search.nearest(asked.limit(0), chunks, 3, query_key="q").count() == 0
    with pytest.raises(ValueError):
        search.nearest(asked, chunks, 0, query_key="q")
    with pytest.raises(Exception, match="different length"):
        search.nearest(asked, chunks.union(spark.createDataFrame([(4, [1.0])], chunks.schema)), 3, query_key="q").collect()
    assert values(chunks.select("id", vectors.cosine_distance("embedding", F.array(F.lit(1.0), F.lit(0.0))).alias("d")), "id", "d") == [(1, 1.0), (2, 0.0), (3, 0.0)]


def test_predicates(spark):
    df = spark.createDataFrame([(1, {"a": "5", "b": "x"}), (2, {"a": "10"}), (3, {"b": "y"}), (4, {"a": "n/a"})], "id int, m map<string,string>")
    ids = lambda c: [r[0] for r in values(df.filter(predicates.where(c, predicates.in_map("m"))), "id")]
    assert ids({"a": 5}) == [1] and ids({"a": {"$ne": "5"}}) == [2, 3, 4]
    assert ids({"a": {"$in": []}}) == [] and ids({"a": {"$nin": []}}) == [1, 2, 3, 4] and ids({"a": {"$nin": ["5"]}}) == [2, 3, 4]
    assert ids({"a": {"$gte": 6}}) == [2] and ids({"a": {"$lt": "2"}}) == [2]
    assert ids({"$or": [{"a": 5}, {"b": "y"}]}) == [1, 3] and ids({}) == [1, 2, 3, 4]
    assert ids(predicates.conditions_of(["a>=5", "b!=x"])) == [2]
    for bad in ({"a": {"$like": "x"}}, {"a": {"$gt": 1, "$lt": 2}}, {"a": {"$gt": [1]}}, {"$not": []}, {"$or": []}):
        with pytest.raises(ValueError):
            predicates.where(bad, predicates.in_map("m"))
    for bad in (["a="], ["a"], ["a=1", "a=2"]):
        with pytest.raises(ValueError):
            predicates.conditions_of(bad)


def test_walks_equal_breadth_first_search(spark):
    edges = [("x", "a"), ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "b")]
    rows = [(*e, "cites") for e in edges] + [("b", "c", "relates")]
    df, seeds = spark.createDataFrame(rows, "from_id string, to_id string, link_type string"), spark.createDataFrame([("a",)], "node string")
    for direction in ("out", "in", "both"):
        for depth in (1, 2, 3):
            for types in (["cites"], None):
                steps = [(s, d) for s, d, t in rows if types is None or t in types]
                steps = {"out": steps, "in": [(d, s) for s, d in steps], "both": steps + [(d, s) for s, d in steps]}[direction]
                seen, front = {"a": 0}, {"a"}
                for hop in range(1, depth + 1):
                    front = {d for s, d in steps if s in front} - set(seen)
                    seen |= dict.fromkeys(front, hop)
                assert dict(values(graph.walk(seeds, df, depth, direction, types), "node", "hops")) == seen
    with pytest.raises(ValueError):
        graph.walk(seeds, df, 1, "up")


def test_tombstones(spark):
    docs = spark.createDataFrame([("live", None), ("dead", dt.datetime(2020, 1, 1)), ("fresh", dt.datetime(2020, 3, 1))], "id string, deleted_at timestamp")
    manifest = spark.createDataFrame([("live", "c1"), ("dead", "c2"), ("live", "c3"), ("dead", "c3"), ("fresh", "c5"), ("dead", "c5")], "doc_id string, chunk_id string")
    chunks = spark.createDataFrame([(f"c{i}",) for i in range(1, 6)], "id string")
    assert values(catalog.visible_chunks(chunks, manifest, docs), "id") == [("c1",), ("c3",), ("c4",)]
    assert values(catalog.purgeable(chunks, manifest, docs, dt.datetime(2020, 1, 1)), "id") == [("c2",)]


def test_health_ignores_missing_dates(spark):
    docs = spark.createDataFrame([("a", "k", dt.datetime(2020, 1, 1), None), ("b", "k", dt.datetime(2099, 1, 1), None), ("c", "k", None, None)], "id string, collection string, indexed_at timestamp, deleted_at timestamp")
    edges = spark.createDataFrame([("a", "b", "cites")], "from_id string, to_id string, link_type string")
    (row,) = catalog.health(docs, edges, dt.datetime(2024, 1, 1)).collect()
    assert (row.docs, row.orphans, row.stale_ratio) == (3, 2, 0.5)


def test_normalisation(spark):
    def norm(xs):
        df = spark.createDataFrame([(i, float(x), 0) for i, x in enumerate(xs)], "i int, v double, q int")
        return [r[1] for r in values(df.select("i", F.round(ranking.normalized(F.col("v"), ["q"]), 6).alias("n")), "i", "n")]

    assert norm([42]) == [1.0] and norm([3, 3]) == [0, 0] and norm([0, 0.5, 1]) == [0, 0.5, 1]
    df = spark.createDataFrame([("a", 0.1, 0.1), ("a", 0.3, 0.1), ("b", 0.2, 0.2)], "g string, distance double, f double")
    assert [r.distance for r in ranking.interleave(df, "g", ["distance"], "distance").collect()] == [0.1, 0.2, 0.3]


def test_tumblers(spark):
    df = spark.createDataFrame([("1.1.10",), ("1.1.3.0",), ("1.1.3",), ("2",)], "t string")
    assert [r.t for r in df.orderBy(tumblers.parsed(F.col("t"))).collect()] == ["1.1.3", "1.1.3.0", "1.1.10", "2"]
    t = F.lit("1.1.3")
    row = spark.range(1).select(tumblers.ancestors(t).alias("a"), tumblers.common_ancestor(t, F.lit("1.1.9")).alias("c"), tumblers.common_ancestor(t, F.lit("2.1")).alias("n"), tumblers.is_prefix(F.lit("1.1"), F.lit("1.10")).alias("p"), tumblers.ancestors(F.lit("7")).alias("e"), tumblers.span_parts(F.lit("3:100-250")).alias("s"), tumblers.span_parts(F.lit("x")).alias("x")).first()
    assert (row.a, row.c, row.n, row.p, row.e, tuple(row.s), row.x) == (["1", "1.1", "1.1.3"], "1.1", None, False, ["7"], ("chunk", "3", 100, 250), None)


def test_ttl():
    assert [scores.ttl_days(x) for x in ("30d", "4w", "permanent", "Never")] == [30, 28, None, None]
    for bad in ("0d", "", "3", "36501d", "-1d"):
        with pytest.raises(ValueError):
            scores.ttl_days(bad)


def test_topics(spark):
    schema = "topic_id int, source_collection string"
    df = spark.createDataFrame([(1, "c1"), (1, "c2"), (2, "c1"), (3, "c3"), (4, "c4"), (4, None)], schema)
    assert dict(values(taxonomy.icf(df), "topic_id", "icf")) == {1: 1.0, 2: 2.0, 3: 2.0, 4: 2.0}
    assert taxonomy.icf(spark.createDataFrame([(1, "c1")], schema)).count() == 0
    sims = spark.createDataFrame([("g", x) for x in (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98)], "g string, similarity double")
    assert values(taxonomy.audit(sims, "g", 0.5), "p10", "p50", "p90", "below") == [(0.2, 0.6, 0.95, 4)]
    old = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "topic_id int, embedding array<double>")
    new = spark.createDataFrame([(7, [0.9, 0.1]), (8, [0.99, 0.01]), (9, [0.1, 1.0])], "topic_id int, embedding array<double>")
    assert values(taxonomy.match_topics(old, new), "old_id", "new_id") == [(1, 8), (2, 9)]


def test_aspects(spark):
    facts = spark.createDataFrame([("paxos", ["TPC-C", "YCSB"], "VLDB"), ("raft", ["YCSB"], "OSDI")], "p string, datasets array<string>, venue string")
    items = spark.createDataFrame([("paxos",), ("raft",), ("gone",)], "p string")
    assert values(aspects.item_filter(items, facts, ["p"], "datasets", "tpc-c"), "p", "matched") == [("gone", False), ("paxos", True), ("raft", False)]
    plus = spark.createDataFrame([("paxos", ["TPC-C-plus"], 0.9), ("raft", ["TPC-C"], 0.8)], "p string, datasets array<string>, confidence double")
    assert values(aspects.item_filter(items, plus, ["p"], "datasets", "TPC-C"), "p", "matched") == [("gone", False), ("paxos", False), ("raft", True)]
    with pytest.raises(ValueError):
        aspects.item_filter(items, plus, ["p"], "confidence", "0.9")
    assert values(aspects.item_groups(items, facts, ["p"], "venue"), "p", "group") == [("gone", "unassigned"), ("paxos", "VLDB"), ("raft", "OSDI")]
    with pytest.raises(ValueError):
        aspects.item_groups(items, facts, ["p"], "datasets")
    asked = spark.createDataFrame([("papers that use the YCSB dataset",), ("use TPC-C and the like",)], "c string")
    found = asked.select(aspects.asked_field(F.col("c")).alias("f"), aspects.asked_needle(F.col("c"), F.lit(None)).alias("n")).collect()
    assert found[0].f == "experimental_datasets" and found[1].n == "TPC-C"


def test_notes(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "alpha beta gamma epsilon"), (3, "other words entirely"), (4, ""), (5, None)], "id long, content string")
    assert values(notes.overlapping(df, "id", "content", 0.6), "a", "b") == [(1, 2)]
    assert notes.overlapping(df, "id", "content", 0.7).count() == 0
    added = spark.createDataFrame([(10, "alpha beta gamma delta zeta"), (11, "nothing in common")], "id long, content string")
    assert dict(values(notes.put_or_merge(df, added).filter("id in (1, 10, 11)"), "id", "content")) == {1: "alpha beta gamma delta\nalpha beta gamma delta zeta", 11: "nothing in common"}
    with pytest.raises(ValueError):
        notes.find(df, "the and")


def test_tables(spark):
    old = spark.createDataFrame([(1, "a", {"x": "1", "y": "2"}), (2, "b", None)], "id int, v string, m map<string,string>")
    new = spark.createDataFrame([(1, "c", {"x": "9"}), (3, "d", {"z": "0"})], old.schema)
    got = {r.id: (r.v, r.m) for r in tables.upsert(old, new, ["id"], ("m",)).collect()}
    assert got == {1: ("c", {"x": "9", "y": "2"}), 2: ("b", {}), 3: ("d", {"z": "0"})}
    with pytest.raises(ValueError):
        tables.delete(old)
    log = spark.createDataFrame([("k", 1, "a", False), ("k", 2, "b", False), ("g", 1, "x", False), ("g", 2, "x", True)], "key string, line int, v string, gone boolean")
    assert values(tables.last_writes(log, ["key"], "line", "gone"), "key", "v") == [("k", "b")]


def test_chunking(spark):
    df = spark.createDataFrame([(1, "\n".join(map(str, range(25)))), (2, ""), (3, "# A\nbody\n## B\nmore")], "id int, t string")
    assert values(chunking.line_windows(df.filter("id < 3"), "id", "t", 10), "id", "line_start", "line_end") == [(1, 1, 10), (1, 9, 18), (1, 17, 25)]
    assert values(chunking.sections(df.filter("id = 3"), "id", "t"), "header", "text") == [("A", "body"), ("B", "more")]
    assert [r.text for r in chunking.sentence_windows(spark.createDataFrame([(1, "One. Two! Three? Four.")], "id int, t string"), "id", text.sentences(F.col("t")), 10).collect()] == ["One. Two!", "Three?", "Four."]


def test_plans():
    good = {"description": "d", "dimensions": {"verb": "v", "scope": "s"}, "plan_json": {"steps": [{"tool": "traverse", "args": {"purpose": "p"}}]}}
    library.check_template(good)
    for bad in ({**good, "description": ""}, {**good, "plan_json": {"steps": [{}]}}, {**good, "plan_json": {"steps": [{"tool": "traverse", "args": {}}]}}):
        with pytest.raises(ValueError):
            library.check_template(bad)
    assert library.identity({"Verb": "A", "scope": "B"}) == library.identity({"scope": "b", "verb": "a"})


def test_exchange(spark, tmp_path):
    df = spark.createDataFrame([(1, "/old/a.py"), (2, "/old/b.md"), (3, None)], "id int, path string")
    assert values(df.filter(exchange.chosen(F.col("path"), ("*.py", "*.md"), ("*/b*",))), "id") == [(1,), (3,)]
    assert values(df.select("id", exchange.remapped(F.col("path"), (("/old/a", "/x"), ("/old", "/new"))).alias("p")).filter("p is not null"), "p") == [("/new/b.md",), ("/x.py",)]
    exchange.export_collection(df, str(tmp_path / "e"), "m", 3)
    assert exchange.import_collection(spark, str(tmp_path / "e"), "m", 3).count() == 3
    with pytest.raises(ValueError):
        exchange.import_collection(spark, str(tmp_path / "e"), "m", 4)


def test_streams(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", (F.col("event_type") == "error").alias("gone"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    jobs.keep_last(stream(), ["user_id"], "event_id", "gone", str(tmp_path / "t"), str(tmp_path / "c1")).awaitTermination()
    last = keyed.read(spark, str(tmp_path / "t"))
    assert values(last, "user_id", "event_id") == values(tables.last_writes(events, ["user_id"], "event_id", "gone"), "user_id", "event_id")
    jobs.append_chunks(stream(), str(tmp_path / "o"), str(tmp_path / "c2"), "event_type").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == events.count()
    query = jobs.telemetry_windows(stream(), late="40 days").writeStream.format("memory").queryName("w").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == events.count()
    queue = spark.createDataFrame([(1, "waiting", None, 0), (2, "claimed", dt.datetime(2024, 1, 1), 2), (3, "claimed", dt.datetime(2024, 1, 1, 0, 9), 0)], "id int, status string, claimed_at timestamp, tries int").withColumn("enqueued_at", F.col("id"))
    assert values(jobs.claimable(queue, dt.datetime(2024, 1, 1, 0, 10), 9), "id") == [(1,), (2,)]
    done = jobs.settle(queue, spark.createDataFrame([(1, True), (2, False)], "id int, ok boolean"))
    assert values(done, "id", "status", "tries") == [(1, "done", 0), (2, "failed", 3), (3, "claimed", 0)]


def test_hits_are_all_chunks(spark, sf, tmp_path):
    """1200 chunks, of which the 600 of collection c0 are the nearest to chunk 0."""
    import __spark_entry__

    rows = [(i, [1.0, 0.001 * (i + 1)] if i < 600 else [0.2, 1.0 + i], 0 if i < 600 else 1 + i % 3) for i in range(1200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.read.parquet(f"{sf}/orders.parquet").limit(20).write.parquet(f"{tmp_path}/orders.parquet")
    spark.read.parquet(f"{sf}/region.parquet").write.parquet(f"{tmp_path}/region.parquet")
    queries = __spark_entry__.queries()
    got = {name: queries[name](spark, str(tmp_path)) for name in ("overfetch", "doc_dedup", "diagnostics", "threshold", "min_max_normalize", "hybrid_score", "link_boost", "topic_boost", "exact_boost", "rerank_merge", "round_robin_interleave")}
    for name in ("min_max_normalize", "hybrid_score", "link_boost", "topic_boost"):
        assert got[name].count() == 1199
    assert values(got["diagnostics"], "collection", "raw", "dropped") == [("c0", 599, 0), ("c1", 200, 200), ("c2", 200, 200), ("c3", 200, 200)]
    assert values(got["overfetch"].groupBy("collection").count(), "collection", "count") == [("c0", 20), ("c1", 40), ("c2", 40), ("c3", 40)]
    assert values(got["doc_dedup"], "topic") == [(0,), (1,), (2,), (3,)] and got["threshold"].count() == 1199
    assert values(got["round_robin_interleave"].groupBy("collection").count(), "count") == [(10,)] * 4
    assert got["exact_boost"].count() == 1199 + 1 and got["rerank_merge"].count() == 200
    assert min(r.score for r in got["exact_boost"].collect()) < 0.4


def test_more_queries_than_a_block_holds(spark):
    rows = spark.range(10_007).select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("embedding"))
    few = rows.filter("id < 3")
    near = search.nearest(rows, few, 1, query_key="id", skip_self=True)
    assert near.count() == near.select("query_id").distinct().count() == 10_007
    assert values(near.filter("query_id IN (0, 1, 2, 10006)"), "query_id", "id") == [(0, 1), (1, 2), (2, 1), (10006, 2)]


def test_aliases_of_any_length(spark):
    to = {i: i + 1 for i in range(100)} | {200: 201, 201: 202, 202: 203, 203: 201, 300: 300, 400: 999, 500: 400}
    got = dict(values(graph.resolve_aliases(spark.createDataFrame([(i, to.get(i)) for i in [*to, 100, 600]], "id long, alias_of long"), "id", "alias_of"), "id", "target"))
    for i in [*to, 100, 600]:
        seen = [i]
        while seen[-1] in to and to[seen[-1]] not in seen:
            seen.append(to[seen[-1]])
        assert got.pop(i) == seen[-1]
    assert not got
    one = spark.createDataFrame([(1, None), (2, 1)], "id long, alias_of long")
    assert values(graph.resolve_aliases(one, "id", "alias_of"), "id", "target") == [(1, 1), (2, 1)]
    assert graph.resolve_aliases(one.limit(0), "id", "alias_of").count() == 0


def test_all_evidence(spark):
    from talus.operators import steps

    (row,) = steps.agree(spark.range(250).withColumn("g", F.lit(0)), "g", "id").collect()
    assert not row.ok and len(row.evidence) == 250


def test_suggested_links_hold_stems_anywhere(spark):
    docs = spark.createDataFrame([(1, "query_planner", "Notes"), (2, "chunk", "Query Planner Design"), (3, "api", "On chunking, api"), (4, None, "query-planner_chunk"), (5, "planner", None), (6, "_ab_", "ab")], "id long, stem string, title string")
    edges = spark.createDataFrame([(1, 4)], "from_id long, to_id long")
    codes, designs = docs.select("id", "stem"), docs.select("id", "title")
    assert values(graph.suggest_links(codes, designs, edges), "from_id", "to_id") == [(1, 2), (2, 3), (2, 4), (5, 2), (5, 4)]
    assert graph.suggest_links(codes.limit(0), designs, edges).count() == 0
    plural = spark.createDataFrame([(9, "RDR 12: Retry Budgets for clients")], "id long, title string")
    assert values(graph.suggest_links(spark.createDataFrame([(8, "retry_budget")], "id long, stem string"), plural, edges), "from_id", "to_id") == [(8, 9)]
