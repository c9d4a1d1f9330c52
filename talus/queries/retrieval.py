"""Scans, predicates, vector and text search, ranking."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import vectors as V
from ..operators import batches as BA
from ..operators import keyed as KM
from ..operators import lineage
from ..operators import predicates as P
from ..operators import ranking as R
from ..operators import search as S
from ..operators import tables as T
from ..operators import text_index as TI
from ..operators import vector_index as VI
from .registry import query, table

COS = "1 - list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
HITS = f"""SELECT id, collection, kind, topic, round(d, 6) AS distance, CAST((id * 37) % 101 AS DOUBLE) / 100 AS frecency, id % 17 = 0 AS cached
  FROM (SELECT c.id, c.collection, c.kind, c.topic, {COS.format(a='c.embedding', b='q.embedding')} AS d FROM {{chunks}} c, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE c.id <> 0)"""


def hits(spark, sf_dir):
    """Every chunk but chunk 0, with its distance to it: limits are those of the ranking steps, by collection."""
    chunks = table(spark, sf_dir, "chunks")
    asked = chunks.filter("id = 0").select("embedding").scalar()
    far = F.round(F.round(V.cosine_distance("embedding", "__asked"), 12), 6)
    near = chunks.filter("id <> 0").withColumn("__asked", asked).withColumn("distance", far)
    return near.select("id", "collection", "kind", "topic", "distance", ((F.col("id") * 37) % 101 / 100.0).cast("double").alias("frecency"), (F.col("id") % 17 == 0).alias("cached"))


@query("flagship", f"""
WITH h AS ({HITS}), k AS (SELECT * FROM h WHERE distance <= 1.0),
s AS (SELECT *, CASE WHEN count(*) OVER () = 1 THEN 0.0 ELSE 1 - (distance - min(distance) OVER ()) / (max(distance) OVER () - min(distance) OVER () + 1e-9) END AS near FROM k),
l AS (SELECT from_id AS id, sum(CASE link_type WHEN 'implements' THEN 1.0 WHEN 'relates' THEN 0.5 WHEN 'cites' THEN 0.5 ELSE 0.0 END) AS w FROM {{links}} GROUP BY 1)
SELECT s.id, s.collection, s.distance, round(s.near + 0.15 * least(1.0, coalesce(l.w, 0)), 6) AS score FROM s LEFT JOIN l USING (id)
ORDER BY score DESC, id LIMIT 50""")
def flagship(spark, sf_dir):
    """Filter, nearest neighbours, normalisation, link boost, top 50."""
    kept = hits(spark, sf_dir).filter("distance <= 1.0").withColumn("__one", F.lit(1))
    scored = R.with_normalized(kept, {"score": F.col("distance")}, ["__one"]).withColumn("score", 1 - F.col("score"))
    boosted = R.link_boost(scored, table(spark, sf_dir, "links").select(F.col("from_id").alias("id"), "link_type"), "id")
    return boosted.select("id", "collection", "distance", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(50)


@query("scan_collection_get", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 20 ORDER BY p_partkey LIMIT 25 OFFSET 10")
def scan_collection_get(spark, sf_dir):
    return T.page(table(spark, sf_dir, "part").filter("p_size > 20").select("p_partkey", "p_name", "p_size"), ["p_partkey"], 25, 10)


@query("peek", "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 10")
def peek(spark, sf_dir):
    return T.page(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_id"], 10)


@query("count", "SELECT collection, count(*) AS n FROM {chunks} GROUP BY 1")
def count(spark, sf_dir):
    return table(spark, sf_dir, "chunks").groupBy("collection").agg(F.count("*").alias("n"))


@query("store_get_many", """SELECT w.place, w.id, p.text, p.id IS NOT NULL AS found FROM (SELECT range AS place, range * 97 AS id FROM range(40)) w LEFT JOIN {parts} p USING (id)""")
def store_get_many(spark, sf_dir):
    wanted = spark.range(40).select(F.col("id").alias("place"), (F.col("id") * 97).alias("id"))
    return T.get_many(table(spark, sf_dir, "parts").drop("collection"), "id", wanted).select("place", "id", "text", "found")


@query("store_list", """SELECT id, text, (SELECT count(*) FROM {parts}) > 60 AS has_more FROM (SELECT id, text FROM {parts} ORDER BY id LIMIT 20 OFFSET 40)""")
def store_list(spark, sf_dir):
    return T.page_with_more(table(spark, sf_dir, "parts").select("id", "text"), ["id"], 20, 40)


@query("lookup_chash", "SELECT source, count(*) AS n FROM documents WHERE sha256(text) = (SELECT sha256(text) FROM documents WHERE doc_id = 3) GROUP BY 1")
def lookup_chash(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("chash"))
    return docs.join(F.broadcast(docs.filter("doc_id = 3").select("chash").distinct()), "chash", "left_semi").groupBy("source").agg(F.count("*").alias("n"))


@query("distinct_collections", "SELECT DISTINCT collection FROM {docs}")
def distinct_collections(spark, sf_dir):
    return table(spark, sf_dir, "docs").select("collection").distinct()


@query("registered_chashes", "SELECT DISTINCT sha256(text) AS chash FROM documents WHERE source = 'src0'")
def registered_chashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("source = 'src0'").select(F.sha2("text", 256).alias("chash")).distinct()


@query("jsonl_replay", """SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'""")
def jsonl_replay(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", (F.col("event_type") == "error").alias("gone"))
    return T.last_writes(log, ["user_id"], "event_id", "gone").select("user_id", "event_type", "value")


@query("keyed_merge", """SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_type <> 'error'""")
def keyed_merge(spark, sf_dir):
    """`jsonl_replay` by merges into key buckets: the log in three batches, the second one twice and the first one late."""
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", (F.col("event_type") == "error").alias("gone"))
    path = lineage.new_folder(spark, "keyed")
    batch = lambda n: log.filter(F.col("event_id") % 3 == n)
    KM.create(batch(1), path, ["user_id"], "event_id", 16)
    for number, n in ((1, 2), (1, 2), (2, 0), (3, 1)):
        KM.merge(batch(n), path, ["user_id"], "event_id", number)
    return KM.read(spark, path).select("user_id", "event_type", "value")


@query("line_cache_cut", """WITH s AS (SELECT doc_id, n_chars % 97 AS weight, CASE WHEN right(text, 1) = chr(10) THEN string_split(left(text, length(text) - 1), chr(10)) ELSE string_split(text, chr(10)) END AS l FROM documents WHERE text <> ''),
b AS (SELECT doc_id, weight, CAST(list_sum(list_transform(l, lambda x, i: strlen(x) + strlen(CAST(doc_id AS VARCHAR)) + strlen(CAST(i AS VARCHAR)) + 3)) AS BIGINT) AS bytes FROM s)
SELECT doc_id, weight, bytes FROM (SELECT *, sum(bytes) OVER (ORDER BY weight DESC, doc_id) - bytes AS before FROM b) WHERE before < 1000000""")
def line_cache_cut(spark, sf_dir):
    """The documents of a line cache of about a million bytes, by weight."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 97).alias("weight"), "text")
    return BA.cached(docs, "weight", "doc_id", "text", 1_000_000)


@query("write_batches", """WITH RECURSIVE d AS (SELECT l_returnflag AS collection, l_orderkey AS document, count(*) AS rows, CAST(sum(CAST(l_quantity AS BIGINT) * 1000) AS BIGINT) AS bytes FROM lineitem GROUP BY ALL),
p AS (SELECT *, CAST(floor((sum(rows + 1) OVER (PARTITION BY collection ORDER BY document) - rows - 1) / 200000) AS BIGINT) AS stretch FROM d),
o AS (SELECT *, row_number() OVER (PARTITION BY collection, stretch ORDER BY document) AS i FROM p),
w AS (SELECT collection, stretch, document, rows, bytes, i, CAST(0 AS BIGINT) AS batch, rows AS n, bytes AS b FROM o WHERE i = 1
  UNION ALL SELECT o.collection, o.stretch, o.document, o.rows, o.bytes, o.i, CASE WHEN f THEN w.batch + 1 ELSE w.batch END, CASE WHEN f THEN 0 ELSE w.n END + o.rows, CASE WHEN f THEN 0 ELSE w.b END + o.bytes
  FROM w JOIN (SELECT * FROM o) o ON o.collection = w.collection AND o.stretch = w.stretch AND o.i = w.i + 1, LATERAL (SELECT w.n + o.rows > 300 OR w.b + o.bytes > 2000000 AS f) x)
SELECT collection, document, rows, bytes, collection || '/' || stretch || '/' || batch AS batch FROM w""")
def write_batches(spark, sf_dir):
    """Whole orders in batches of 300 lines and two million bytes at most."""
    chunks = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("collection"), F.col("l_orderkey").alias("document"), (F.col("l_quantity").cast("long") * 1000).alias("size"))
    return BA.packed(chunks, "collection", "document", "size", 300, 2_000_000)


@query("upsert", """SELECT coalesce(b.p_partkey, a.p_partkey) AS id, CASE WHEN b.p_partkey IS NOT NULL THEN 'new ' || b.p_name ELSE a.p_name END AS name
FROM (SELECT * FROM part WHERE p_partkey % 3 <> 0) a FULL JOIN (SELECT * FROM part WHERE p_partkey % 2 = 0) b ON a.p_partkey = b.p_partkey""")
def upsert(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    return T.upsert(part.filter("id % 3 <> 0"), part.filter("id % 2 = 0").withColumn("name", F.concat(F.lit("new "), "name")), ["id"])


@query("update", """SELECT a.c_custkey AS id, coalesce(b.c_mktsegment, a.c_mktsegment) AS segment FROM customer a LEFT JOIN (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'MOVED' END AS c_mktsegment FROM customer WHERE c_custkey % 2 = 0) b USING (c_custkey)""")
def update(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return T.update(old, old.filter("id % 2 = 0").select("id", F.when(F.col("id") % 4 == 0, "MOVED").alias("segment")), ["id"])


@query("delete", "SELECT s_suppkey, s_name FROM supplier WHERE NOT (s_acctbal < 0) AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_partkey < 100)")
def delete(spark, sf_dir):
    gone = table(spark, sf_dir, "lineitem").filter("l_quantity > 49 AND l_partkey < 100").select(F.col("l_suppkey").alias("s_suppkey")).distinct()
    return T.delete(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), gone, ["s_suppkey"], F.col("s_acctbal") < 0).select("s_suppkey", "s_name")


@query("rename_collection", "SELECT CASE collection WHEN 'c1' THEN 'moved' ELSE collection END AS collection, count(*) AS n FROM {chunks} GROUP BY 1")
def rename_collection(spark, sf_dir):
    moved = F.when(F.col("collection") == "c1", "moved").otherwise(F.col("collection"))
    return table(spark, sf_dir, "chunks").select(moved.alias("collection")).groupBy("collection").agg(F.count("*").alias("n"))


@query("line_cache", """WITH l AS (SELECT id, n_chars, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS line_no FROM (SELECT doc_id AS id, n_chars, text AS content FROM documents)),
t AS (SELECT * FROM l WHERE contains(line, 'License') ORDER BY n_chars DESC, id, line_no LIMIT 20)
SELECT id, CAST(line_no AS BIGINT) AS line_no, line, round(1 - CAST(row_number() OVER (ORDER BY n_chars DESC, id, line_no) - 1 AS DOUBLE) / count(*) OVER (), 6) AS score FROM t""")
def line_cache(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars", "text")
    return T.line_cache(docs, "id", "text", "n_chars", "License", 20).select("id", F.col("line_no").cast("long").alias("line_no"), "line", F.round("score", 6).alias("score"))


def _events_where(name, conditions, sql):
    @query(name, f"SELECT event_id, user_id FROM events WHERE {sql}")
    def run(spark, sf_dir):
        return table(spark, sf_dir, "events").filter(P.where(conditions, P.in_json("props"))).select("event_id", "user_id")


K = "json_extract_string(props, '$.k')"
_events_where("where_eq", {"k": 69}, f"{K} = '69'")
_events_where("where_ne", {"k": {"$ne": "69"}}, f"{K} IS DISTINCT FROM '69'")
_events_where("where_in", {"k": {"$in": [1, 2, 3]}}, f"{K} IN ('1', '2', '3')")
_events_where("where_nin", {"k": {"$nin": [1, 2, 3]}}, f"{K} IS NULL OR {K} NOT IN ('1', '2', '3')")
_events_where("where_range", {"k": {"$gte": 80}}, f"TRY_CAST({K} AS DOUBLE) >= 80")
_events_where("where_range_text", {"k": {"$lt": "5"}}, f"{K} < '5'")
_events_where("where_mongo", {"$or": [{"k": {"$lt": 5}}, {"$and": [{"k": {"$gt": 50}}, {"k": {"$lte": 52}}]}], "absent": {"$ne": "x"}}, f"TRY_CAST({K} AS DOUBLE) < 5 OR (TRY_CAST({K} AS DOUBLE) > 50 AND TRY_CAST({K} AS DOUBLE) <= 52)")
_events_where("where_parse", P.conditions_of(["k>=10", "k<20", "k!=15"]), f"TRY_CAST({K} AS DOUBLE) >= 10 AND TRY_CAST({K} AS DOUBLE) < 20 AND {K} IS DISTINCT FROM '15'")


@query("path_scope", "SELECT page_id, url FROM pages WHERE starts_with(url, 'http://th')")
def path_scope(spark, sf_dir):
    return table(spark, sf_dir, "pages").filter(F.col("url").startswith("http://th")).select("page_id", "url")


@query("max_file_chunks", """SELECT d.id, m.n FROM {docs} d LEFT JOIN (SELECT doc_id, count(*) AS n FROM {manifest} GROUP BY 1) m ON d.id = m.doc_id WHERE m.n IS NULL OR m.n <= 3""")
def max_file_chunks(spark, sf_dir):
    counts = table(spark, sf_dir, "manifest").groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "docs").select("id").join(counts, "id", "left").filter("n IS NULL OR n <= 3")


@query("cosine_distance", f"SELECT c.id, round({COS.format(a='c.embedding', b='q.embedding')}, 6) AS distance FROM {{chunks}} c, (SELECT embedding FROM embeddings WHERE vec_id = 7) q")
def cosine_distance(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks")
    asked = chunks.filter("id = 7").select("embedding").scalar()
    return chunks.withColumn("q", asked).select("id", F.round(V.cosine_distance("embedding", "q"), 6).alias("distance"))


KNN = f"""SELECT query_id, id, distance, CAST(rank AS BIGINT) AS rank FROM (
  SELECT q.id AS query_id, c.id, round({COS.format(a='c.embedding', b='q.embedding')}, 6) AS distance,
         row_number() OVER (PARTITION BY q.id ORDER BY round({COS.format(a='c.embedding', b='q.embedding')}, 12), c.id) AS rank
  FROM {{chunks}} c, (SELECT id, embedding FROM {{chunks}} WHERE %s) q WHERE %s) WHERE rank <= %d"""


def _near(df):
    return df.select("query_id", "id", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


@query("knn_query", KNN % ("id % 20 = 0", "true", 10))
def knn_query(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks")
    return _near(S.nearest(chunks.filter("id % 20 = 0"), chunks, 10, query_key="id"))


@query("search_filtered", KNN % ("id % 20 = 0", "c.collection = 'c1'", 5))
def search_filtered(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks")
    return _near(S.nearest(chunks.filter("id % 20 = 0"), chunks.filter("collection = 'c1'"), 5, query_key="id"))


def indexed(spark, sf_dir):
    """An index of all chunks, with the column that predicates ask for."""
    return VI.build(table(spark, sf_dir, "chunks"), lineage.new_folder(spark, "vector-index"), keep=["collection"])


@query("vector_index_exact", KNN % ("id % 20 = 0", "true", 10))
def vector_index_exact(spark, sf_dir):
    return _near(VI.search(indexed(spark, sf_dir), table(spark, sf_dir, "chunks").filter("id % 20 = 0"), 10, exact=True, query_key="id"))


@query("vector_index_filtered", KNN % ("id % 20 = 0", "c.collection = 'c1'", 10))
def vector_index_filtered(spark, sf_dir):
    asked = table(spark, sf_dir, "chunks").filter("id % 20 = 0")
    return _near(VI.search(indexed(spark, sf_dir), asked, 10, F.col("collection") == "c1", exact=True, query_key="id"))


@query("vector_index_recall", "SELECT count(*) AS queries, true AS all_full, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def vector_index_recall(spark, sf_dir):
    """Searches by codes against the true ten nearest under a predicate: every query gets ten rows, and recall is 0.9 or more."""
    chunks, wanted = table(spark, sf_dir, "chunks"), F.col("collection") == "c1"
    asked = chunks.filter("id % 20 = 0")
    truth = S.nearest(asked, chunks.filter(wanted), 10, query_key="id")
    found = lineage.cut(VI.search(indexed(spark, sf_dir), asked, 10, wanted, query_key="id"))
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).agg((F.min("n") == 10).alias("all_full"))
    return VI.recall(found, truth).agg(F.count("*").alias("queries"), (F.sum("found") / F.sum("wanted") >= 0.9).alias("enough")).crossJoin(full).select("queries", "all_full", "enough")


@query("search_multi_collection", KNN % ("id = 3", "c.collection IN ('c0', 'c2')", 30))
def search_multi_collection(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks")
    models = chunks.groupBy("collection").agg(F.lit("m").alias("model"), F.max(F.size("embedding")).alias("dimension"))
    return _near(S.in_collections(chunks.filter("id = 3"), chunks, models, ["c0", "c2"], 30, query_key="id"))


@query("live_nn_probe", KNN.replace("WHERE rank", "WHERE true AND rank") % ("id % 20 = 0", "c.id <> q.id", 1))
def live_nn_probe(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks")
    return _near(S.nearest(chunks.filter("id % 20 = 0"), chunks, 1, query_key="id", skip_self=True))


CENTROIDS = "(SELECT label AS topic_id, list(x ORDER BY pos) AS embedding FROM (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"


def centroids(spark, sf_dir):
    return V.mean_vector(table(spark, sf_dir, "chunks").withColumnRenamed("topic", "topic_id"), ["topic_id"], "embedding", "embedding")


@query("ann_centroid", f"""SELECT id, topic_id, similarity FROM (SELECT c.id, t.topic_id, round(1 - ({COS.format(a='c.embedding', b='t.embedding')}), 6) AS similarity,
  row_number() OVER (PARTITION BY c.id ORDER BY round({COS.format(a='c.embedding', b='t.embedding')}, 12), t.topic_id) AS n FROM {{chunks}} c, {CENTROIDS} t WHERE c.id % 20 = 0) WHERE n <= 3""")
def ann_centroid(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks").filter("id % 20 = 0")
    near = S.nearest(chunks, centroids(spark, sf_dir), 3, query_key="id", key="topic_id")
    return near.select(F.col("query_id").alias("id"), F.col("id").alias("topic_id"), F.round(1 - F.col("distance"), 6).alias("similarity"))


TOKENS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))"
GRAMS = "list_distinct([substring('  ' || {w} || ' ', CAST(i AS INT), 3) for i in range(1, length({w}) + 2)])"
GATE = f"""w AS (SELECT doc_id AS id, unnest({TOKENS}) AS word FROM documents),
g AS (SELECT word, {GRAMS.format(w='word')} AS grams FROM (SELECT DISTINCT word FROM w)),
a AS (SELECT asked, {GRAMS.format(w='asked')} AS grams FROM (SELECT unnest(['relesed', 'license']) AS asked)),
alike AS (SELECT word, asked FROM g, a WHERE CAST(len(list_intersect(g.grams, a.grams)) AS DOUBLE) / len(a.grams) >= 0.6),
m AS (SELECT id FROM w JOIN alike USING (word) GROUP BY 1 HAVING count(DISTINCT asked) = 2)"""


def texts_with_vectors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    return docs.join(table(spark, sf_dir, "chunks").select("id", "embedding"), "id")


@query("text_gate", f"WITH {GATE} SELECT id FROM m")
def text_gate(spark, sf_dir):
    """Misspelt on purpose: trigrams find `released`."""
    return S.text_matches(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "the relesed license").select("id")


def notes_index(spark, sf_dir):
    """The stored text index of the notes, built when the documents have changed."""
    build = lambda folder: TI.build(table(spark, sf_dir, "notes"), folder, "id", {"content": "B"}, {"project": "A", "tags": "C"}, ["content"])
    return TI.TextIndex(lineage.stored(spark, "text-index-4", f"{sf_dir}/documents.parquet", build))


@query("text_index_gate", f"WITH {GATE} SELECT id FROM m")
def text_index_gate(spark, sf_dir):
    """`text_gate` from the stored index."""
    return TI.misspelt_matches(spark, notes_index(spark, sf_dir), "the relesed license")


HYBRID = f"""WITH {GATE}, h AS (SELECT c.id, {COS.format(a='c.embedding', b='q.embedding')} AS distance FROM {{chunks}} c JOIN m USING (id), (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"""


@query("hybrid_search", HYBRID + " SELECT id, round(distance, 6) AS distance FROM h ORDER BY round(distance, 12), id LIMIT 10")
def hybrid_search(spark, sf_dir):
    """The stored index of the texts opens the gate; no text is read."""
    chunks = table(spark, sf_dir, "chunks")
    inside = TI.misspelt_matches(spark, notes_index(spark, sf_dir), "relesed license")
    got = S.nearest(chunks.filter("id = 0"), chunks.join(inside, "id", "left_semi"), 10, query_key="id")
    return got.select("id", F.round("distance", 6).alias("distance"))


@query("hybrid_search_rrf", HYBRID + """, r AS (SELECT h.id, CAST(row_number() OVER (ORDER BY round(distance, 12), h.id) AS BIGINT) AS vector_rank, CAST(row_number() OVER (ORDER BY n_chars, h.id) AS BIGINT) AS text_rank FROM h JOIN documents ON doc_id = h.id)
SELECT id, vector_rank, text_rank, round(1 / (60.0 + vector_rank) + 1 / (60.0 + text_rank), 6) AS score FROM r""")
def hybrid_search_rrf(spark, sf_dir):
    gated = S.text_matches(texts_with_vectors(spark, sf_dir), "relesed license")
    asked = table(spark, sf_dir, "chunks").filter("id = 0").select("embedding").scalar()
    far = gated.withColumn("asked", asked).select("id", V.cosine_distance("embedding", "asked").alias("distance"), F.char_length("text").alias("n_chars"))
    return S.fused(far, "distance", "n_chars").withColumn("score", F.round("score", 6))


SCOPED = f"""WITH d AS (SELECT m.doc_id AS document, c.id, round({COS.format(a='c.embedding', b='q.embedding')}, 12) AS distance FROM {{chunks}} c JOIN {{manifest}} m ON m.chunk_id = c.id JOIN {{docs}} d ON d.id = m.doc_id, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE d.deleted_at IS NULL AND %s)
SELECT document, id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY distance, id) AS n FROM d) WHERE n = 1 ORDER BY round(distance, 12), document LIMIT 25"""


def _scoped(spark, sf_dir, docs):
    chunks = table(spark, sf_dir, "chunks")
    asked = chunks.filter("id = 0").select("embedding").scalar()
    owners = table(spark, sf_dir, "manifest").join(docs.filter("deleted_at IS NULL").select(F.col("id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("document"), F.col("chunk_id").alias("id"))
    # Only what is in scope is scored.
    far = chunks.join(owners.select("id").distinct(), "id", "left_semi").withColumn("__asked", asked).select("id", F.round(V.cosine_distance("embedding", "__asked"), 12).alias("distance"))
    best = S.best_of_document(owners.join(far, "id"), ["document"])
    return S.top(best, 25, ["distance", "document"]).select("document", "id", F.round("distance", 6).alias("distance"))


@query("search_metadata_scoped", SCOPED % "d.content_type = 'F' AND contains(lower(d.author), 'author 1') AND d.year = 1997 AND (d.tumbler = '1' OR starts_with(d.tumbler, '1.')) AND d.collection = '1-URGENT'")
def search_metadata_scoped(spark, sf_dir):
    docs = S.in_scope(table(spark, sf_dir, "docs"), "F", "AUTHOR 1", 1997, "1", F.col("collection") == "1-URGENT")
    return _scoped(spark, sf_dir, docs)


#: Topics by their label: two collections use `topic 3`, one of them for another topic.
TOPICS = "(SELECT DISTINCT topic AS topic_id, 'topic ' || CAST(CASE WHEN topic = 7 THEN 3 ELSE topic END AS STRING) AS label, collection FROM {chunks})"


@query("search_topic_scoped", KNN % ("id = 0", f"c.id IN (SELECT x.id FROM {{chunks}} x JOIN {TOPICS} t ON t.topic_id = x.topic WHERE t.label = 'topic 3' AND t.collection = 'c3')", 15))
def search_topic_scoped(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks")
    label = F.concat(F.lit("topic "), F.when(F.col("topic") == 7, 3).otherwise(F.col("topic")).cast("string"))
    topics = chunks.select(F.col("topic").alias("topic_id"), label.alias("label"), "collection").distinct()
    members = S.topic_members(topics, chunks.select("id", F.col("topic").alias("topic_id")), "topic 3", "c3")
    return _near(S.nearest(chunks.filter("id = 0"), chunks.join(members, "id", "left_semi"), 15, query_key="id"))


REACH = """r AS (SELECT id, min(h) AS hops FROM (SELECT 5 AS id, 0 AS h UNION ALL
 SELECT CASE WHEN l.from_id = 5 THEN l.to_id ELSE l.from_id END, 1 FROM {links} l WHERE l.from_id = 5 OR l.to_id = 5 UNION ALL
 SELECT CASE WHEN b.from_id = x.id THEN b.to_id ELSE b.from_id END, 2 FROM (SELECT CASE WHEN l.from_id = 5 THEN l.to_id ELSE l.from_id END AS id FROM {links} l WHERE l.from_id = 5 OR l.to_id = 5) x JOIN {links} b ON b.from_id = x.id OR b.to_id = x.id) GROUP BY 1)"""


@query("search_graph_hop", f"WITH {REACH}, " + (SCOPED % "d.id IN (SELECT id FROM r)")[5:])
def search_graph_hop(spark, sf_dir):
    from ..operators import graph

    seeds = spark.range(5, 6).select(F.col("id").alias("node"))
    near = graph.walk(seeds, table(spark, sf_dir, "links"), 2, "both").select(F.col("node").alias("id"))
    return _scoped(spark, sf_dir, table(spark, sf_dir, "docs").join(near, "id", "left_semi"))


@query("doc_dedup", f"WITH h AS ({HITS}) SELECT topic, id, distance FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY distance, id) AS n FROM h) WHERE n = 1")
def doc_dedup(spark, sf_dir):
    return S.best_of_document(hits(spark, sf_dir).select("topic", "id", "distance"), ["topic"])


@query("overfetch", f"WITH h AS ({HITS}) SELECT id, collection, distance FROM (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY distance, id) AS n FROM h) WHERE n <= greatest(5, 10 * CASE WHEN kind IN ('knowledge', 'docs', 'rdr') THEN 4 ELSE 2 END)")
def overfetch(spark, sf_dir):
    return R.overfetch(hits(spark, sf_dir), 10).select("id", "collection", "distance")


LIMIT = "CASE kind WHEN 'code' THEN 0.45 WHEN 'knowledge' THEN 0.65 WHEN 'docs' THEN 0.65 WHEN 'rdr' THEN 0.65 ELSE 0.55 END"


@query("threshold", f"WITH h AS ({HITS}) SELECT id, kind, distance FROM h WHERE distance * 0.6 <= {LIMIT}")
def threshold(spark, sf_dir):
    return hits(spark, sf_dir).filter(R.within_limit(F.col("kind"), F.col("distance") * 0.6)).select("id", "kind", "distance")


@query("diagnostics", f"WITH h AS ({HITS}) SELECT collection, count(*) AS raw, count(*) FILTER (distance > {LIMIT}) AS dropped, count(*) FILTER (distance <= {LIMIT}) AS kept, CAST(max({LIMIT}) AS DOUBLE) AS limit_used, min(distance) AS top_distance FROM h GROUP BY 1")
def diagnostics(spark, sf_dir):
    return R.limit_report(hits(spark, sf_dir))


@query("min_max_normalize", f"WITH h AS ({HITS}) SELECT id, round(CASE WHEN count(*) OVER w = 1 THEN 1.0 ELSE (distance - min(distance) OVER w) / (max(distance) OVER w - min(distance) OVER w + 1e-9) END, 6) AS norm FROM h WINDOW w AS (PARTITION BY collection)")
def min_max_normalize(spark, sf_dir):
    return R.with_normalized(hits(spark, sf_dir), {"norm": F.col("distance")}, ["collection"]).select("id", F.round("norm", 6).alias("norm"))


@query("hybrid_score", f"""WITH h AS ({HITS}), n AS (SELECT *, min(distance) FILTER (NOT cached) OVER w AS lo, max(distance) FILTER (NOT cached) OVER w AS hi, min(frecency) FILTER (NOT cached) OVER w AS flo, max(frecency) FILTER (NOT cached) OVER w AS fhi FROM h WINDOW w AS (PARTITION BY collection))
SELECT id, round(CASE WHEN cached THEN 0.5 WHEN kind = 'code' THEN 0.7 * (1 - (distance - lo) / (hi - lo + 1e-9)) + (1 - 0.7) * (frecency - flo) / (fhi - flo + 1e-9) ELSE 1 - (distance - lo) / (hi - lo + 1e-9) END, 6) AS score FROM n""")
def hybrid_score(spark, sf_dir):
    return R.hybrid_score(hits(spark, sf_dir), ["collection"]).select("id", F.round("score", 6).alias("score"))


@query("file_size_penalty", "SELECT doc_id, round(least(1.0, CAST(3 AS DOUBLE) / greatest(1, count(*))), 6) AS factor FROM {manifest} GROUP BY 1")
def file_size_penalty(spark, sf_dir):
    from ..functions import scores

    return table(spark, sf_dir, "manifest").groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.round(scores.size_penalty(F.col("n"), 3), 6).alias("factor"))


@query("quality_boost", """SELECT p_partkey, round(CASE WHEN p_size - 5 > 0 THEN 0.5 * ln(p_size - 5 + 1) / ln(10001) + 0.5 * pow(0.5, greatest(0, date_diff('day', make_date(CAST(2000 + p_partkey % 20 AS INT), 6, 15), DATE '2024-01-30')) / 730.0) ELSE 0.0 END, 6) AS quality FROM part""")
def quality_boost(spark, sf_dir):
    import datetime as dt

    from ..functions import scores

    year = (2000 + F.col("p_partkey") % 20).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(scores.quality(F.col("p_size") - 5, scores.age_of_year(year, dt.date(2024, 1, 30))), 6).alias("quality"))


@query("link_boost", f"""WITH h AS ({HITS}), l AS (SELECT from_id AS id, sum(CASE link_type WHEN 'implements' THEN 1.0 WHEN 'relates' THEN 0.5 WHEN 'cites' THEN 0.5 ELSE 0.0 END) AS w FROM {{links}} GROUP BY 1)
SELECT id, round(1 - distance + 0.15 * least(1.0, coalesce(w, 0)), 6) AS score FROM h LEFT JOIN l USING (id)""")
def link_boost(spark, sf_dir):
    """Links that leave a hit count."""
    scored = hits(spark, sf_dir).withColumn("score", 1 - F.col("distance"))
    return R.link_boost(scored, table(spark, sf_dir, "links").select(F.col("from_id").alias("id"), "link_type"), "id").select("id", F.round("score", 6).alias("score"))


@query("topic_boost", f"""WITH h AS ({HITS}), t AS (SELECT topic, count(*) AS n FROM h GROUP BY 1), l AS (SELECT a, b FROM (VALUES (0, 1), (2, 5)) v(a, b))
SELECT h.id, h.topic, round(greatest(0.0, distance - CASE WHEN n > 1 THEN 0.1 ELSE 0.0 END - CASE WHEN EXISTS (SELECT 1 FROM l, t t2 WHERE (l.a = h.topic AND l.b = t2.topic) OR (l.b = h.topic AND l.a = t2.topic)) THEN 0.05 ELSE 0.0 END), 6) AS distance FROM h JOIN t USING (topic)""")
def topic_boost(spark, sf_dir):
    linked = table(spark, sf_dir, "region").filter("r_regionkey IN (0, 2)").select(F.col("r_regionkey").alias("a"), F.when(F.col("r_regionkey") == 0, 1).otherwise(5).alias("b"))
    out = R.topic_boost(hits(spark, sf_dir).withColumn("q", F.lit(0)), ["q"], "topic", linked)
    return out.select("id", "topic", F.round("distance", 6).alias("distance"))


@query("salience_boost", """SELECT doc_id, round(0.025 * len(list_intersect(['the', 'license', 'and', 'le'], list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')))) / 4.0, 6) AS boost FROM documents""")
def salience_boost(spark, sf_dir):
    asked = F.array(*map(F.lit, ("the", "license", "and", "le")))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(R.salience_boost(asked, X.tokens(F.col("text"))), 6).alias("boost"))


@query("contradiction_flag", f"""WITH n AS ({KNN % ("id % 20 = 0", "true", 30)}), c AS (SELECT n.query_id, n.id, e.collection, e.embedding, CAST(e.topic AS STRING) || CAST(e.id % 2 AS STRING) AS agent FROM n JOIN {{chunks}} e USING (id)),
p AS (SELECT a.query_id, a.id AS a, b.id AS b FROM c a JOIN c b ON a.query_id = b.query_id AND a.id < b.id AND a.collection = b.collection AND a.agent <> b.agent WHERE {COS.format(a='a.embedding', b='b.embedding')} < 0.6)
SELECT c.query_id, c.id, c.collection, EXISTS (SELECT 1 FROM p WHERE p.query_id = c.query_id AND (p.a = c.id OR p.b = c.id)) AS contradicted FROM c""")
def contradiction_flag(spark, sf_dir):
    """Among the 30 nearest chunks of each search."""
    chunks = table(spark, sf_dir, "chunks")
    near = S.nearest(chunks.filter("id % 20 = 0"), chunks, 30, query_key="id").select("query_id", "id")
    found = near.join(chunks, "id").withColumn("agent", F.concat(F.col("topic").cast("string"), (F.col("id") % 2).cast("string")))
    return R.contradictions(found, least=0.6).select("query_id", "id", "collection", "contradicted")


@query("exact_boost", f"""WITH h AS ({HITS}), e AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 10 = 0)
SELECT id, round(CASE WHEN id IN (SELECT id FROM e) THEN least(1.0, 1 - distance + 0.15) ELSE 1 - distance END, 6) AS score FROM h UNION ALL SELECT id, 0.4 FROM e WHERE id NOT IN (SELECT id FROM h)""")
def exact_boost(spark, sf_dir):
    exact = table(spark, sf_dir, "chunks").filter("id % 10 = 0").select("id")
    return R.exact_boost(hits(spark, sf_dir).withColumn("score", 1 - F.col("distance")), exact, "id").withColumn("score", F.round("score", 6))


@query("rerank_merge", f"WITH h AS ({HITS}) SELECT id, distance, CASE WHEN id % 3 = 0 THEN CAST((id * 31) % 97 AS DOUBLE) END AS score FROM h ORDER BY score IS NULL, score DESC, distance, id LIMIT 200")
def rerank_merge(spark, sf_dir):
    scored = hits(spark, sf_dir).select("id", "distance", F.when(F.col("id") % 3 == 0, ((F.col("id") * 31) % 97).cast("double")).alias("score"), F.struct("distance", "id").alias("order"))
    return R.rerank(scored, "order", "score", 200).drop("order")


@query("round_robin_interleave", f"""WITH h AS ({HITS}), r AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY distance, id) AS turn, min(distance) OVER (PARTITION BY collection) AS seen FROM h)
SELECT id, collection, CAST(turn AS BIGINT) AS turn FROM r ORDER BY turn, seen, collection LIMIT 40""")
def round_robin_interleave(spark, sf_dir):
    return R.interleave(hits(spark, sf_dir), "collection", ["distance", "id"], "distance", 40).select("id", "collection", F.col("turn").cast("long").alias("turn"))


@query("ndcg", """WITH g AS (SELECT l_suppkey AS q, l_orderkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_partkey, l_linenumber, l_quantity) AS rank, CAST(l_quantity AS INT) % 4 AS grade FROM lineitem),
b AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY grade DESC, rank) AS best FROM g)
SELECT q, round(CASE WHEN sum(w) > 0 THEN sum(h) / sum(w) ELSE 0.0 END, 6) AS ndcg FROM (SELECT q, CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END AS h, CASE WHEN best <= 10 THEN (pow(2, grade) - 1) / log2(best + 1) ELSE 0 END AS w FROM b) GROUP BY 1""")
def ndcg(spark, sf_dir):
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    graded = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("q"), F.row_number().over(order).alias("rank"), (F.col("l_quantity").cast("int") % 4).alias("grade"))
    return R.ndcg(graded, ["q"], "rank", "grade", 10).withColumn("ndcg", F.round("ndcg", 6))
