"""Clusters of results, analysis steps, scoped reads and the smaller catalog reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..operators import catalog as C
from ..operators import graph as G
from ..operators import rerank as RR
from ..operators import results as R
from ..operators import search as S
from ..operators import steps as D
from ..operators import taxonomy as X2
from ..streaming import sessions as SE
from .registry import query, table
from .retrieval import COS, hits


MATCH = 0.2
HALVES = ", ".join(f"{name} AS (SELECT label AS topic_id, list(x ORDER BY pos) AS embedding FROM (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings WHERE vec_id % 2 = {i}) GROUP BY 1, 2) GROUP BY 1)" for i, name in enumerate(("old", "new")))
#: Greedy one-to-one matching: each round takes the best pair that is left; ten topics take ten rounds at most.
_PAIRS = f"w AS (SELECT o.topic_id AS old_id, n.topic_id AS new_id, row_number() OVER (ORDER BY round({COS.format(a='o.embedding', b='n.embedding')}, 12), o.topic_id, n.topic_id) AS r FROM old o, new n WHERE {COS.format(a='o.embedding', b='n.embedding')} <= 1 - {MATCH})"
_ROUNDS = ", ".join(f"g{i} AS (SELECT * FROM g{i - 1} UNION ALL (SELECT old_id, new_id FROM w WHERE old_id NOT IN (SELECT old_id FROM g{i - 1}) AND new_id NOT IN (SELECT new_id FROM g{i - 1}) ORDER BY r LIMIT 1))" for i in range(1, 11))
GREEDY = f"{_PAIRS}, g0 AS (SELECT old_id, new_id FROM w LIMIT 0), {_ROUNDS}, g AS (SELECT * FROM g10)"


@query("cluster_results")
def cluster_results(spark, sf_dir):
    """Ward clusters of the 30 nearest chunks of each query."""
    chunks = table(spark, sf_dir, "chunks")
    near = S.nearest(chunks.filter("id % 20 = 0"), chunks, 30, query_key="id")
    return R.cluster_results(near.select("query_id", "id", "distance").join(chunks.select("id", "embedding"), "id"))


@query("topic_grouping", "SELECT vec_id AS id, label % 4 AS g, 2 * count(CASE WHEN vec_id % 3 > label % 4 - 1 THEN label END) OVER (PARTITION BY label % 4) >= count(*) OVER (PARTITION BY label % 4) AS by_topic FROM embeddings")
def topic_grouping(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 4).alias("g"), F.when(F.col("vec_id") % 3 > F.col("label") % 4 - 1, F.col("label")).alias("topic"))
    return R.topic_or_cluster(rows, "g", "topic").select("id", "g", "by_topic")


@query("section_filter", "SELECT doc_id FROM documents WHERE NOT regexp_matches(text, '(?i)^(references|bibliography)')")
def section_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(~F.col("text").rlike("(?i)^(references|bibliography)")).select("doc_id")


@query("tenant_filter", "SELECT event_id FROM events WHERE user_id = 7")
def tenant_filter(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("tenant", F.col("user_id").cast("string"))
    return C.of_tenant(events, "7").select("event_id")


@query("author_substring", "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'r#00000001')")
def author_substring(spark, sf_dir):
    return C.search(table(spark, sf_dir, "customer"), contains={"c_name": "R#00000001"}).select("c_custkey", "c_name")


@query("catalog_search", "SELECT p_partkey, p_name FROM part WHERE (contains(lower(p_name), 'ring') OR contains(lower(p_type), 'ring')) AND p_brand = 'Brand#2'")
def catalog_search(spark, sf_dir):
    return C.search(table(spark, sf_dir, "part"), "RING", ["p_name", "p_type"], equals={"p_brand": "Brand#2"}).select("p_partkey", "p_name")


@query("catalog_show", "SELECT d.id, coalesce(o.n, 0) AS links_out, coalesce(i.n, 0) AS links_in, coalesce(o.l, '') AS out, coalesce(i.l, '') AS into FROM {docs} d LEFT JOIN (SELECT from_id AS id, count(*) AS n, string_agg(to_id || ' ' || link_type, ',' ORDER BY to_id, link_type) AS l FROM {links} GROUP BY 1) o USING (id) LEFT JOIN (SELECT to_id AS id, count(*) AS n, string_agg(from_id || ' ' || link_type, ',' ORDER BY from_id, link_type) AS l FROM {links} GROUP BY 1) i ON i.id = d.id")
def catalog_show(spark, sf_dir):
    out = C.show(table(spark, sf_dir, "docs"), table(spark, sf_dir, "links"))
    spelled = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["id"].cast("string"), F.lit(" "), x["link_type"])), ",").alias(c)
    return out.select("id", "links_out", "links_in", spelled("out"), spelled("into"))


@query("collection_vector_stats", """WITH v AS (SELECT *, TIMESTAMP '2024-01-01' + to_days(CAST(id % 28 AS INT)) AS written FROM {chunks} WHERE id NOT IN (SELECT chunk_id FROM {manifest} m JOIN {docs} d ON d.id = m.doc_id GROUP BY 1 HAVING NOT bool_or(d.deleted_at IS NULL)))
SELECT collection, count(*) AS chunks, CASE WHEN min(len(embedding)) = max(len(embedding)) THEN CAST(max(len(embedding)) AS INT) END AS dimension, CAST(CAST(max(written) AS DATE) AS VARCHAR) AS last_write FROM v GROUP BY 1""")
def collection_vector_stats(spark, sf_dir):
    chunks = table(spark, sf_dir, "chunks").withColumn("written_at", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 28).cast("int")))
    visible = C.visible_chunks(chunks, table(spark, sf_dir, "manifest"), table(spark, sf_dir, "docs"))
    return C.vector_stats(visible).withColumn("last_write", F.col("last_write").cast("string"))


@query("resolve_chash", "SELECT user_id AS chash, event_type AS collection FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'view', ts DESC, event_type) AS n FROM events) WHERE n = 1")
def resolve_chash(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("chash"), F.col("event_type").alias("collection"), F.col("ts").alias("created_at"))
    return C.resolve_chunk(rows, "chash", "view")


@query("traverse_purpose", "WITH e AS (SELECT from_id AS s, to_id AS d FROM {links} WHERE link_type IN ('cites', 'implements', 'relates')), a AS (SELECT DISTINCT e.d AS node FROM e WHERE e.s IN (SELECT id FROM {docs} WHERE id % 20 = 0)) SELECT node, CAST(min(hops) AS INT) AS hops FROM (SELECT id AS node, 0 AS hops FROM {docs} WHERE id % 20 = 0 UNION ALL SELECT node, 1 FROM a UNION ALL SELECT e.d, 2 FROM a JOIN e ON e.s = a.node) GROUP BY 1")
def traverse_purpose(spark, sf_dir):
    seeds = table(spark, sf_dir, "docs").filter("id % 20 = 0").select(F.col("id").alias("node"))
    return G.traverse(seeds, table(spark, sf_dir, "links"), purpose="factual-evidence", depth=2)


@query("suggest_links", r"""WITH c AS (SELECT page_id AS id, replace(lower(regexp_extract(html, 'href="/([^"]*)"', 1)), '_', '') AS stem FROM pages), d AS (SELECT page_id AS id, regexp_replace(lower(regexp_extract(html, '<title>([^<]*)</title>', 1)), '[-_ ]', '', 'g') AS title FROM pages),
m AS (SELECT DISTINCT c.id AS from_id, d.id AS to_id FROM c JOIN d ON contains(d.title, c.stem) AND length(c.stem) > 3 AND c.id <> d.id), e AS (SELECT l_partkey AS from_id, l_suppkey AS to_id FROM lineitem)
SELECT from_id, to_id FROM m WHERE NOT EXISTS (SELECT 1 FROM e WHERE (e.from_id = m.from_id AND e.to_id = m.to_id) OR (e.from_id = m.to_id AND e.to_id = m.from_id))""")
def suggest_links(spark, sf_dir):
    """Pages whose first linked file's name stands in another page's title."""
    pages = table(spark, sf_dir, "pages")
    codes = pages.select(F.col("page_id").alias("id"), F.regexp_extract("html", 'href="/([^"]*)"', 1).alias("stem"))
    designs = pages.select(F.col("page_id").alias("id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id"))
    return G.suggest_links(codes, designs, edges)


@query("split_topic")
def split_topic(spark, sf_dir):
    return X2.split_topic(table(spark, sf_dir, "chunks").withColumnRenamed("topic", "topic_id"), 3, 3)


def halves(spark, sf_dir):
    """Topics of one half of the chunks, and of the other with a turned label."""
    chunks = table(spark, sf_dir, "chunks").withColumnRenamed("topic", "topic_id")
    return chunks, *(V.mean_vector(chunks.filter(f"id % 2 = {i}"), ["topic_id"], "embedding", "embedding") for i in (0, 1))


@query("rebuild_assignments", f"""WITH {HALVES}, {GREEDY}, manual AS (SELECT id, topic AS topic_id, embedding FROM {{chunks}}),
r AS (SELECT m.id, g.new_id, m.embedding FROM manual m LEFT JOIN g ON g.old_id = m.topic_id),
s AS (SELECT id, topic_id, sim FROM (SELECT r.id, n.topic_id, 1 - round({COS.format(a='r.embedding', b='n.embedding')}, 12) AS sim, row_number() OVER (PARTITION BY r.id ORDER BY round({COS.format(a='r.embedding', b='n.embedding')}, 12), n.topic_id) AS k FROM r, new n WHERE r.new_id IS NULL) WHERE k = 1)
SELECT id, new_id AS topic_id, 'matched' AS route FROM r WHERE new_id IS NOT NULL UNION ALL SELECT id, topic_id, 'nearest' FROM s WHERE sim > 0.2""")
def rebuild_assignments(spark, sf_dir):
    """Assignments to the topics of one half, carried over to those of the other."""
    chunks, old, new = halves(spark, sf_dir)
    return X2.carry_over(chunks.select("id", "topic_id"), old, new, chunks.select("id", "embedding"), MATCH, 0.2)


@query("merge_labels", f"""WITH {HALVES}, {GREEDY} SELECT n.topic_id, 'topic ' || CAST(g.old_id AS STRING) AS label, CASE WHEN g.old_id IS NULL THEN 'pending' WHEN g.old_id % 2 = 0 THEN 'accepted' ELSE 'pending' END AS review_status, g.old_id FROM new n LEFT JOIN g ON g.new_id = n.topic_id""")
def merge_labels(spark, sf_dir):
    """Labels of the topics of one half of the chunks, given to those of the other."""
    _, old, new = halves(spark, sf_dir)
    status = F.when(F.col("topic_id") % 2 == 0, "accepted").otherwise("pending")
    return X2.merge_labels(old.select("topic_id", F.concat(F.lit("topic "), F.col("topic_id").cast("string")).alias("label"), status.alias("review_status"), "embedding"), new, MATCH)


@query("operator_extract", "SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, nullif(regexp_extract(html, '<html lang=\"([a-z]+)\"', 1), '') AS lang FROM pages")
def operator_extract(spark, sf_dir):
    return D.extract(table(spark, sf_dir, "pages"), "html", {"title": "<title>([^<]*)</title>", "lang": '<html lang="([a-z]+)"'}).select("page_id", "title", "lang")


@query("operator_rank", "SELECT doc_id, round(len(list_intersect(['license', 'released', 'mit'], list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')))) / 3.0, 6) AS score FROM documents ORDER BY score DESC, doc_id LIMIT 25")
def operator_rank(spark, sf_dir):
    return D.rank(table(spark, sf_dir, "documents"), "text", "the license released MIT", "doc_id").limit(25).select("doc_id", F.round("score", 6).alias("score"))


@query("operator_compare", "SELECT coalesce(a.c_custkey, b.c_custkey) AS id, CASE WHEN b.c_custkey IS NULL THEN 'a' WHEN a.c_custkey IS NULL THEN 'b' ELSE 'changed' END AS side FROM (SELECT * FROM customer WHERE c_custkey % 5 <> 0) a FULL JOIN (SELECT c_custkey, c_mktsegment, c_nationkey FROM customer WHERE c_custkey % 3 <> 0) b ON a.c_custkey = b.c_custkey WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_nationkey IS DISTINCT FROM b.c_nationkey % 20")
def operator_compare(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n"))
    return D.compare(rows.filter("id % 5 <> 0"), rows.filter("id % 3 <> 0").withColumn("n", F.col("n") % 20), "id", "n")


@query("operator_summarize", r"""SELECT doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, ' ')), lambda s: s <> '')[1:2], ' ') AS summary FROM documents""")
def operator_summarize(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", D.summary(F.col("text"), 2).alias("summary"))


@query("operator_generate", "SELECT s_suppkey, 'Supplier ' || s_name || ' in ' || CAST(s_nationkey AS STRING) AS output FROM supplier")
def operator_generate(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", D.filled("Supplier {name} in {nation}", name=F.col("s_name"), nation=F.col("s_nationkey")).alias("output"))


@query("operator_check", "SELECT c_nationkey, count(DISTINCT c_mktsegment) <= 1 AS ok, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ',') AS evidence FROM customer GROUP BY 1")
def operator_check(spark, sf_dir):
    return D.agree(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment").select("c_nationkey", "ok", F.array_join("evidence", ",").alias("evidence"))


@query("operator_verify", "SELECT doc_id, len(list_intersect(['released', 'mit', 'license'], list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')))) >= 3 AS verified FROM documents")
def operator_verify(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", D.verified(F.lit("It was released with the MIT license"), F.col("text")).alias("verified"))


@query("session_scope", "SELECT user_id, count(*) AS entries, count(DISTINCT event_type) AS kinds, max(event_id) AS last FROM events GROUP BY 1")
def session_scope(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("entries"), F.countDistinct("event_type").alias("kinds"), F.max("event_id").alias("last"))


@query("session_summary", "SELECT collection, created_by, count(*) AS links, count(DISTINCT from_id) AS sources FROM {links} l JOIN {docs} d ON d.id = l.from_id GROUP BY 1, 2")
def session_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "docs").select(F.col("id").alias("from_id"), "collection")
    return table(spark, sf_dir, "links").join(docs, "from_id").groupBy("collection", "created_by").agg(F.count("*").alias("links"), F.countDistinct("from_id").alias("sources"))


@query("squeezed_titles", "SELECT doc_id, sha256(regexp_replace(trim(lower(text), ' '), '\\s+', ' ', 'g')) AS digest FROM documents")
def squeezed_titles(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.squeezed(F.col("text")), 256).alias("digest"))


@query("answer_steps", """SELECT topic, count(*) AS hits, min(distance) AS best FROM (SELECT * FROM (SELECT c.id, c.topic, round(1 - list_cosine_similarity(CAST(c.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS distance FROM {chunks} c, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE c.id <> 0) ORDER BY distance, id LIMIT 100) GROUP BY 1""")
def answer_steps(spark, sf_dir):
    """Search, then group and reduce: a stored plan's steps composed by hand."""
    return S.top(hits(spark, sf_dir), 100, ["distance", "id"]).groupBy("topic").agg(F.count("*").alias("hits"), F.min("distance").alias("best"))


@query("rerank_pairs")
def rerank_pairs(spark, sf_dir):
    """The two replies of each conversation that are most like its first question, by late interaction."""
    rows = table(spark, sf_dir, "conversations")
    asked = rows.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("query"))
    pairs = rows.filter("role = 'assistant'").join(asked, "conv_id")
    return RR.best(pairs, 2, "conv_id", "turn", "query", "text").withColumn("score", F.round("score", 6))


@query("salient_scored")
def salient_scored(spark, sf_dir):
    """The three sentences of each document that are most like one of two questions."""
    return RR.salient(table(spark, sf_dir, "documents"), "doc_id", "text", ["released under a license", "the rest of the day"]).select("doc_id", "place", F.round("score", 6).alias("score"), F.sha2("sentence", 256).alias("digest"))


@query("session_promotions", """WITH r AS (SELECT CAST(user_id AS VARCHAR) AS session, CASE WHEN event_type = 'error' THEN 'close' ELSE 'put' END AS kind, CASE WHEN event_type <> 'error' THEN event_type END AS key, props AS value, value > 20 AS flagged, ts FROM events),
o AS (SELECT *, row_number() OVER w AS place, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 172800000000 OR lag(kind) OVER w = 'close' THEN 1 ELSE 0 END AS fresh FROM r WINDOW w AS (PARTITION BY session ORDER BY ts, kind, key NULLS FIRST, value NULLS FIRST)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY place) AS n FROM o), e AS (SELECT session, n, epoch_us(max(ts)) AS last, bool_or(kind = 'close') AS closed FROM n GROUP BY 1, 2),
c AS (SELECT session, n, CASE WHEN closed THEN last ELSE last + 172800000000 END AS closed_us, CASE WHEN closed THEN 'closed' ELSE 'idle' END AS reason FROM e WHERE closed OR last + 172800000000 < (SELECT epoch_us(max(ts)) FROM r)),
p AS (SELECT session, n, key, arg_max(value, place) AS value, arg_max(flagged, place) AS flagged FROM n WHERE kind = 'put' GROUP BY 1, 2, 3)
SELECT session, CAST(closed_us AS BIGINT) AS closed_us, reason, key, value FROM p JOIN c USING (session, n) WHERE flagged""")
def session_promotions(spark, sf_dir):
    """A user's events as scratch entries: errors close a session, and so do two days without an event."""
    event = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.when(event == "error", "close").otherwise("put").alias("kind"), F.when(event != "error", event).alias("key"), F.col("props").alias("value"), (F.col("value") > 20).alias("flagged"), "ts")
    out = SE.promoted(rows, dt.timedelta(days=2))
    return out.select("session", F.unix_micros("closed_at").alias("closed_us"), "reason", "key", "value")
