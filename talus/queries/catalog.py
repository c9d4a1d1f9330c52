"""Catalog, link graph, tumblers and set operations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import tumblers as A
from ..operators import catalog as C
from ..operators import graph as G
from ..operators import health as H
from ..operators import intervals as V
from ..operators import tables as T
from ..operators import telemetry as L
from ..operators import titles as TT
from .registry import query, table

CUT = dt.datetime(1998, 1, 1)
LIVE = "(SELECT * FROM {docs} WHERE deleted_at IS NULL)"


@query("catalog_stats", f"SELECT count(*) AS docs, count(DISTINCT author) AS owners, count(DISTINCT collection) AS collections, count(DISTINCT content_type) AS content_types, (SELECT count(DISTINCT chunk_id) FROM {{manifest}} WHERE doc_id IN (SELECT id FROM {LIVE})) AS chunks, (SELECT count(*) FROM {{links}}) AS links FROM {LIVE}")
def catalog_stats(spark, sf_dir):
    return C.totals(table(spark, sf_dir, "docs"), table(spark, sf_dir, "links"), table(spark, sf_dir, "manifest"), "author")


@query("collection_doc_counts", f"SELECT collection, count(*) AS n FROM {LIVE} GROUP BY 1")
def collection_doc_counts(spark, sf_dir):
    return C.live(table(spark, sf_dir, "docs")).groupBy("collection").agg(F.count("*").alias("n"))


@query("catalog_list", f"SELECT id, collection, content_type, (SELECT count(*) FROM {LIVE} WHERE content_type = 'P') > 40 AS has_more FROM {LIVE} WHERE content_type = 'P' ORDER BY id LIMIT 30 OFFSET 10")
def catalog_list(spark, sf_dir):
    return T.page_with_more(C.live(table(spark, sf_dir, "docs")).filter("content_type = 'P'").select("id", "collection", "content_type"), ["id"], 30, 10)


@query("coverage_by_content_type", f"WITH e AS (SELECT from_id AS id FROM {{links}} UNION SELECT to_id FROM {{links}}) SELECT content_type, count(*) AS total, count(e.id) AS linked FROM {LIVE} d LEFT JOIN e USING (id) GROUP BY 1")
def coverage_by_content_type(spark, sf_dir):
    return C.coverage(table(spark, sf_dir, "docs"), table(spark, sf_dir, "links"))


INBOUND = f"(SELECT DISTINCT to_id AS id FROM {{links}} WHERE from_id IN (SELECT id FROM {LIVE}))"


@query("orphan_documents", f"SELECT d.id, d.collection FROM {LIVE} d WHERE d.indexed_at < TIMESTAMP '1998-01-01' AND d.id NOT IN (SELECT id FROM {INBOUND})")
def orphan_documents(spark, sf_dir):
    return C.orphans(table(spark, sf_dir, "docs"), table(spark, sf_dir, "links"), CUT).select("id", "collection")


@query("collection_health", f"""SELECT collection, count(*) AS docs, CAST(CAST(max(indexed_at) AS DATE) AS STRING) AS last_indexed, count(*) FILTER (i.id IS NULL) AS orphans,
round(CAST(count(*) FILTER (indexed_at < TIMESTAMP '1998-01-01') AS DOUBLE) / count(indexed_at), 6) AS stale_ratio FROM {LIVE} d LEFT JOIN {INBOUND} i USING (id) GROUP BY 1""")
def collection_health(spark, sf_dir):
    out = C.health(table(spark, sf_dir, "docs"), table(spark, sf_dir, "links"), CUT)
    return out.withColumn("last_indexed", F.col("last_indexed").cast("date").cast("string")).withColumn("stale_ratio", F.round("stale_ratio", 6))


SEARCHED = "CASE user_id % 6 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' WHEN 3 THEN '9-NONE' ELSE '5-LOW' END"
OWN = "CASE l_suppkey % 4 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' WHEN 2 THEN '3-MEDIUM' ELSE '4-NOT SPECIFIED' END"


@query("collection_health_report", f"""WITH d AS (SELECT * FROM {LIVE}), c AS (SELECT collection, count(*) AS n FROM {{manifest}} JOIN {{docs}} d ON d.id = doc_id WHERE chunk_id % 9 <> 0 GROUP BY 1),
h AS (SELECT collection, max(indexed_at) AS last, count(*) FILTER (i.id IS NULL) AS orphans, CAST(count(*) FILTER (indexed_at < TIMESTAMP '1998-01-01') AS DOUBLE) / nullif(count(indexed_at), 0) AS stale FROM d LEFT JOIN {INBOUND} i USING (id) GROUP BY 1),
s AS (SELECT {SEARCHED} AS collection, avg(CASE WHEN kept_count = 0 THEN 1.0 ELSE 0.0 END) AS zero, quantile_cont(top_distance, 0.5) AS mid FROM {{log}} GROUP BY 1),
a AS (SELECT o_orderpriority AS src, {OWN} AS own, l_suppkey % 40 AS topic_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority <> '5-LOW' OR l_suppkey % 4 = 3),
r AS (SELECT own AS collection, rank() OVER (ORDER BY count(DISTINCT src) DESC) AS place FROM a WHERE src <> own GROUP BY own),
t AS (SELECT src, topic_id, count(*) AS n, row_number() OVER (PARTITION BY src ORDER BY count(*) DESC, topic_id) AS k FROM a GROUP BY 1, 2), u AS (SELECT src AS collection, CAST(sum(n) FILTER (k <= 10) AS DOUBLE) / sum(n) AS share FROM t GROUP BY 1),
x AS (SELECT collection, count(*) AS n FROM {{docs}} WHERE id % 2 = 0 GROUP BY 1)
SELECT collection, CAST(coalesce(c.n, 0) AS BIGINT) AS chunk_count, CAST(CAST(last AS DATE) AS VARCHAR) AS last_indexed, round(zero, 6) AS zero_hit_rate, round(mid, 6) AS median_query_distance, CAST(place AS DOUBLE) AS cross_projection_rank, CAST(coalesce(orphans, 0) AS BIGINT) AS orphans, round(stale, 6) AS stale_ratio, round(share, 6) AS hub_domination,
CASE WHEN c.n > 0 THEN round(least(1.0, CAST(x.n AS DOUBLE) / c.n), 6) END AS hash_coverage FROM (SELECT DISTINCT collection FROM {{docs}}) LEFT JOIN h USING (collection) LEFT JOIN c USING (collection) LEFT JOIN s USING (collection) LEFT JOIN r USING (collection) LEFT JOIN u USING (collection) LEFT JOIN x USING (collection)""")
def collection_health_report(spark, sf_dir):
    """All facts, worst coverage first; the order is that of `health.ordered`."""
    docs, lines = table(spark, sf_dir, "docs"), table(spark, sf_dir, "lineitem")
    chunks = table(spark, sf_dir, "manifest").filter("chunk_id % 9 <> 0").join(docs.select(F.col("id").alias("doc_id"), "collection"), "doc_id").select("collection")
    searches = L.search_stats(table(spark, sf_dir, "log").withColumn("collection", F.expr(SEARCHED)), dt.datetime(1970, 1, 1))
    sources = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("source_collection"))
    assigned = lines.join(sources, "l_orderkey").filter("source_collection <> '5-LOW' OR l_suppkey % 4 = 3").select("source_collection", F.expr(OWN).alias("topic_collection"), (F.col("l_suppkey") % 40).alias("topic_id"))
    out = H.report(docs, table(spark, sf_dir, "links"), chunks, searches, assigned, docs.filter("id % 2 = 0").select("collection"), CUT)
    shown = out.withColumns({"last_indexed": F.col("last_indexed").cast("date").cast("string"), "cross_projection_rank": F.col("cross_projection_rank").cast("double")}).withColumns({c: F.round(c, 6) for c in ("zero_hit_rate", "median_query_distance", "stale_ratio", "hub_domination", "hash_coverage")})
    return H.ordered(shown, ["hash_coverage", "last_indexed"])


@query("visible_chunks", """SELECT p.id FROM {parts} p WHERE p.id NOT IN (SELECT chunk_id FROM {manifest} m JOIN {docs} d ON d.id = m.doc_id GROUP BY 1 HAVING NOT bool_or(d.deleted_at IS NULL))""")
def visible_chunks(spark, sf_dir):
    return C.visible_chunks(table(spark, sf_dir, "parts"), table(spark, sf_dir, "manifest"), table(spark, sf_dir, "docs")).select("id")


@query("purge_trash", """WITH o AS (SELECT m.chunk_id, bool_and(coalesce(d.deleted_at <= TIMESTAMP '1998-01-01', false)) AS aged FROM {manifest} m JOIN {docs} d ON d.id = m.doc_id GROUP BY 1) SELECT id, text FROM {parts} WHERE id IN (SELECT chunk_id FROM o WHERE aged)""")
def purge_trash(spark, sf_dir):
    return C.purgeable(table(spark, sf_dir, "parts"), table(spark, sf_dir, "manifest"), table(spark, sf_dir, "docs"), CUT).select("id", "text")


@query("manifest_gaps", """SELECT d.id, d.chunk_count AS expected, coalesce(m.n, 0) AS have, d.chunk_count = 0 AS ghost FROM (SELECT *, CASE WHEN id % 4 = 0 THEN 'h' || CAST(id AS STRING) ELSE '' END AS content_hash FROM {docs}) d
LEFT JOIN (SELECT doc_id, count(*) AS n FROM {manifest} GROUP BY 1) m ON m.doc_id = d.id WHERE coalesce(m.n, 0) < d.chunk_count OR (d.chunk_count = 0 AND m.n IS NULL AND d.content_hash <> '' AND d.collection <> '')""")
def manifest_gaps(spark, sf_dir):
    hashed = F.when(F.col("id") % 4 == 0, F.concat(F.lit("h"), F.col("id").cast("string"))).otherwise("")
    return C.gaps(table(spark, sf_dir, "docs").withColumn("content_hash", hashed), table(spark, sf_dir, "manifest"))


@query("append_to_manifest", """SELECT f.doc_id, CAST(coalesce(l.last, -1) + row_number() OVER (PARTITION BY f.doc_id ORDER BY f.chunk_id) AS BIGINT) AS position, f.chunk_id
FROM (SELECT DISTINCT doc_id, chunk_id FROM {manifest} WHERE position > 4) f LEFT JOIN (SELECT doc_id, max(position) AS last FROM {manifest} WHERE position <= 4 GROUP BY 1) l USING (doc_id)""")
def append_to_manifest(spark, sf_dir):
    manifest = table(spark, sf_dir, "manifest")
    found = manifest.filter("position > 4").select("doc_id", "chunk_id", F.col("chunk_id").alias("chunk_index")).distinct()
    return C.append_to_manifest(manifest.filter("position <= 4"), found)


@query("document_text", f"SELECT m.doc_id, string_agg(p.text, chr(10) ORDER BY m.position, p.text) AS text FROM {{manifest}} m JOIN {{parts}} p ON p.id = m.chunk_id WHERE m.doc_id IN (SELECT id FROM {LIVE}) GROUP BY 1")
def document_text(spark, sf_dir):
    return C.document_text(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "parts"), table(spark, sf_dir, "docs"))


@query("chash_coverage", """SELECT d.collection, CASE WHEN count(*) > 0 THEN round(least(1.0, CAST(count(m.doc_id) AS DOUBLE) / count(*)), 6) END AS coverage FROM {docs} d LEFT JOIN (SELECT DISTINCT doc_id FROM {manifest}) m ON m.doc_id = d.id GROUP BY 1""")
def chash_coverage(spark, sf_dir):
    have = table(spark, sf_dir, "manifest").select(F.col("doc_id").alias("id")).distinct().withColumn("have", F.lit(1))
    out = table(spark, sf_dir, "docs").join(have, "id", "left").groupBy("collection").agg(F.count("have").alias("indexed"), F.count("*").alias("total"))
    return out.select("collection", F.round(C.coverage_ratio(F.col("indexed"), F.col("total")), 6).alias("coverage"))


@query("missing_ids", "SELECT DISTINCT doc_id AS id FROM {manifest} WHERE doc_id NOT IN (SELECT id FROM {docs} WHERE id % 2 = 0)")
def missing_ids(spark, sf_dir):
    return T.missing(table(spark, sf_dir, "manifest").select(F.col("doc_id").alias("id")), table(spark, sf_dir, "docs").filter("id % 2 = 0"), "id")


@query("next_numbers", """SELECT n.n_nationkey, n.n_regionkey, CAST(coalesce(l.last, 0) + row_number() OVER (PARTITION BY n.n_regionkey ORDER BY n.n_nationkey) AS BIGINT) AS number
FROM (SELECT * FROM nation WHERE n_nationkey >= 12) n LEFT JOIN (SELECT n_regionkey, max(n_nationkey) AS last FROM nation WHERE n_nationkey < 12 GROUP BY 1) l USING (n_regionkey)""")
def next_numbers(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    given = nations.filter("n_nationkey < 12").withColumn("number", F.col("n_nationkey"))
    return C.next_numbers(given, "n_regionkey", nations.filter("n_nationkey >= 12").select("n_nationkey", "n_regionkey"), "n_nationkey").select("n_nationkey", "n_regionkey", "number")


def _walks(seed_filter: str, direction: str, depth: int, types: list[str] | None) -> str:
    """Reachable nodes by plain joins of distinct directed steps, hop by hop."""
    only = f" WHERE link_type IN ({', '.join(repr(t) for t in types)})" if types else ""
    both = {"out": f"SELECT from_id AS s, to_id AS d FROM {{links}}{only}", "in": f"SELECT to_id AS s, from_id AS d FROM {{links}}{only}"}
    steps = " UNION ".join(both.values()) if direction == "both" else both[direction]
    parts = [f"e AS ({steps})", f"h0 AS (SELECT id AS node FROM {{docs}} WHERE {seed_filter})"]
    for i in range(1, depth + 1):
        parts.append(f"h{i} AS (SELECT DISTINCT e.d AS node FROM h{i - 1} JOIN e ON e.s = h{i - 1}.node)")
    union = " UNION ALL ".join(f"SELECT node, {i} AS hops FROM h{i}" for i in range(depth + 1))
    return f"WITH {', '.join(parts)} SELECT node, CAST(min(hops) AS INT) AS hops FROM ({union}) GROUP BY 1"


for name, direction, depth, types in (("traverse_out", "out", 3, None), ("traverse_in", "in", 2, None), ("traverse_both", "both", 2, ["cites", "implements"])):

    @query(name, _walks("id % 20 = 0", direction, depth, types))
    def traverse(spark, sf_dir, direction=direction, depth=depth, types=types):
        seeds = table(spark, sf_dir, "docs").filter("id % 20 = 0").select(F.col("id").alias("node"))
        return G.walk(seeds, table(spark, sf_dir, "links"), depth, direction, types)


@query("links_live", f"SELECT from_id, to_id, link_type FROM {{links}} WHERE from_id IN (SELECT id FROM {LIVE}) AND to_id IN (SELECT id FROM {LIVE})")
def links_live(spark, sf_dir):
    return G.live_links(table(spark, sf_dir, "links"), C.live(table(spark, sf_dir, "docs"))).select("from_id", "to_id", "link_type")


@query("link_query", "SELECT from_id, to_id, link_type FROM {links} WHERE created_by = 'F' AND link_type = 'cites' AND created_at < TIMESTAMP '1998-01-01'")
def link_query(spark, sf_dir):
    return table(spark, sf_dir, "links").filter((F.col("created_by") == "F") & (F.col("link_type") == "cites") & (F.col("created_at") < F.lit(CUT))).select("from_id", "to_id", "link_type")


@query("link_merge", """WITH b AS (SELECT to_id % 50 AS from_id, to_id, link_type, created_by, created_at FROM {links}), f AS (SELECT *, row_number() OVER (PARTITION BY from_id, to_id, link_type ORDER BY created_at, created_by) AS n FROM b)
SELECT from_id, to_id, link_type, max(created_by) FILTER (n = 1) AS created_by, CAST(CAST(max(created_at) FILTER (n = 1) AS DATE) AS STRING) AS created_at, coalesce(array_to_string(list_sort(list_distinct(list_filter(list(created_by), lambda x: x <> (max(created_by) FILTER (n = 1))))), ','), '') AS co_discovered_by FROM f GROUP BY 1, 2, 3""".replace("list_filter(list(created_by), lambda x: x <> (max(created_by) FILTER (n = 1)))", "list(created_by) FILTER (created_by <> first_by)").replace("ORDER BY created_at, created_by) AS n FROM b)", "ORDER BY created_at, created_by) AS n, first_value(created_by) OVER (PARTITION BY from_id, to_id, link_type ORDER BY created_at, created_by) AS first_by FROM b)"))
def link_merge(spark, sf_dir):
    links = table(spark, sf_dir, "links").withColumn("from_id", F.col("to_id") % 50)
    merged = G.merge_links(links.filter("created_by = 'F'"), links.filter("created_by <> 'F'"))
    return merged.withColumn("created_at", F.col("created_at").cast("date").cast("string")).withColumn("co_discovered_by", F.array_join("co_discovered_by", ","))


SPANS = "CASE WHEN to_id % 4 = 0 THEN '3-9' WHEN to_id % 4 = 1 THEN 'chash:' || md5(CAST(to_id % 90 AS STRING)) WHEN to_id % 4 = 2 THEN '2:0-50' END"


@query("link_audit", f"""WITH s AS (SELECT to_id % 50 AS from_id, to_id, link_type, created_by, created_at, {SPANS.replace("STRING", "VARCHAR")} AS span FROM {{links}}),
l AS (SELECT id, indexed_at FROM {{docs}} WHERE deleted_at IS NULL), h AS (SELECT 'chash:' || md5(CAST(p_partkey AS VARCHAR)) AS chash FROM part WHERE p_partkey < 60),
g AS (SELECT s.from_id, to_id, link_type, created_by, count(*) AS n, count(*) FILTER (span LIKE '%-%' AND l.indexed_at > created_at) AS old, count(*) FILTER (span LIKE 'chash%' AND span NOT IN (SELECT chash FROM h)) AS gone FROM s LEFT JOIN l ON l.id = s.from_id GROUP BY ALL)
SELECT link_type, created_by, CAST(sum(n) AS BIGINT) AS links, CAST(sum(n - 1) AS BIGINT) AS duplicates,
CAST(sum(CASE WHEN from_id NOT IN (SELECT id FROM l) OR to_id NOT IN (SELECT id FROM l) THEN n ELSE 0 END) AS BIGINT) AS orphaned, CAST(sum(old) AS BIGINT) AS stale_spans, CAST(sum(gone) AS BIGINT) AS stale_hashes FROM g GROUP BY 1, 2""")
def link_audit(spark, sf_dir):
    links = table(spark, sf_dir, "links").withColumn("from_id", F.col("to_id") % 50).withColumn("span", F.expr(SPANS))
    hashes = table(spark, sf_dir, "part").filter("p_partkey < 60").select(F.md5(F.col("p_partkey").cast("string")).alias("chash"))
    return G.link_audit(links, C.live(table(spark, sf_dir, "docs")), hashes)


@query("link_density", """WITH s AS (SELECT id, collection FROM {docs} WHERE id % 20 = 0), e AS (SELECT from_id AS a, to_id AS b FROM {links} UNION SELECT to_id, from_id FROM {links}),
z AS (SELECT s.collection, s.id, count(DISTINCT e.b) FILTER (e.b <> s.id) AS size FROM s LEFT JOIN e ON e.a = s.id GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY size, id) - 1 AS pos, count(*) OVER (PARTITION BY collection) AS n FROM z)
SELECT collection, max(n) AS seeds, median(size) AS p50, max(size) FILTER (pos = floor(0.9 * (n - 1) + 0.5)) AS p90, median(size) < 3 AS low FROM p GROUP BY 1""")
def link_density(spark, sf_dir):
    seeds = table(spark, sf_dir, "docs").filter("id % 20 = 0").select("collection", F.col("id").alias("node"))
    return G.link_density(seeds, table(spark, sf_dir, "links"), "collection")


@query("resolve_alias", """WITH RECURSIVE a AS (SELECT id, id AS target, [id] AS seen, 0 AS n FROM {docs} UNION ALL
SELECT a.id, d.alias_of, list_append(a.seen, d.alias_of), a.n + 1 FROM a JOIN {docs} d ON d.id = a.target WHERE d.alias_of IS NOT NULL AND NOT list_contains(a.seen, d.alias_of))
SELECT id, target FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC) AS r FROM a) WHERE r = 1""")
def resolve_alias(spark, sf_dir):
    return G.resolve_aliases(table(spark, sf_dir, "docs"), "id", "alias_of")


@query("pdf_corpus_links", "WITH d AS (SELECT doc_id, sha256(text) AS h, min(doc_id) OVER (PARTITION BY sha256(text)) AS anchor FROM documents) SELECT doc_id AS from_id, anchor AS to_id, 'same-as' AS link_type FROM d WHERE doc_id <> anchor")
def pdf_corpus_links(spark, sf_dir):
    return G.same_as(table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest")), "doc_id", "digest")


@query("citation_links", """WITH r AS (SELECT DISTINCT o_custkey AS from_id, o_orderkey % 700 AS to_id FROM orders) SELECT from_id, to_id, 'cites' AS link_type FROM r WHERE from_id <> to_id AND to_id IN (SELECT o_custkey FROM orders) AND to_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)""")
def citation_links(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.collect_set(F.col("o_orderkey") % 700).alias("refs"))
    old = table(spark, sf_dir, "customer").filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("to_id"))
    existing = docs.select(F.col("id").alias("from_id"), F.explode("refs").alias("to_id")).join(old, "to_id", "left_semi").select("from_id", "to_id", F.lit("cites").alias("link_type"))
    return G.citation_links(docs, "id", "refs", existing)


@query("filepath_links", r"""WITH n AS (SELECT DISTINCT page_id AS from_id, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS path FROM pages), t AS (SELECT min(page_id) AS to_id, path FROM n2 GROUP BY path)
SELECT DISTINCT from_id, to_id, 'mentions' AS link_type FROM n JOIN t USING (path) WHERE from_id <> to_id""".replace("FROM n2", "FROM (SELECT from_id AS page_id, path FROM n)"))
def filepath_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    pattern = 'href="(/[^"]*)"'
    named = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(pattern), 1)).alias("path"))
    targets = named.groupBy("path").agg(F.min("page_id").alias("id"))
    return G.path_links(pages.withColumnRenamed("page_id", "id"), "id", "html", pattern, targets, "path", "mentions")


TUMBLERS = "SELECT c_custkey, CAST(n_regionkey AS STRING) || '.' || CAST(n_nationkey AS STRING) || '.' || CAST(c_custkey AS STRING) AS tumbler FROM customer JOIN nation ON n_nationkey = c_nationkey"


def addresses(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    return table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.concat_ws(".", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"), F.col("c_custkey").cast("string")).alias("tumbler"))


@query("tumbler_parts", f"SELECT c_custkey, tumbler, CAST(len(string_split(tumbler, '.')) AS INT) AS depth, array_to_string([string_split(tumbler, '.')[1], string_split(tumbler, '.')[1] || '.' || string_split(tumbler, '.')[2], tumbler], '|') AS ancestors FROM ({TUMBLERS})")
def tumbler_parts(spark, sf_dir):
    t = F.col("tumbler")
    return addresses(spark, sf_dir).select("c_custkey", t, A.depth(t).alias("depth"), F.array_join(A.ancestors(t), "|").alias("ancestors"))


@query("tumbler_order", f"SELECT c_custkey, tumbler FROM ({TUMBLERS}) ORDER BY CAST(string_split(tumbler, '.') AS INT[]) LIMIT 50")
def tumbler_order(spark, sf_dir):
    return addresses(spark, sf_dir).orderBy(A.parsed(F.col("tumbler"))).limit(50)


@query("tumbler_subtree", f"SELECT c_custkey, tumbler FROM ({TUMBLERS}) WHERE tumbler = '1.1' OR starts_with(tumbler, '1.1.')")
def tumbler_subtree(spark, sf_dir):
    return addresses(spark, sf_dir).filter(A.is_prefix(F.lit("1.1"), F.col("tumbler")))


@query("spans_overlap", "SELECT a.l_orderkey, a.l_linenumber AS a, b.l_linenumber AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE a.l_quantity <= b.l_quantity + 5 AND b.l_quantity <= a.l_quantity + 5")
def spans_overlap(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("start"), (F.col("l_quantity") + 5).cast("long").alias("end"))
    met = V.overlap_join(lines, lines, ["l_orderkey"])
    return met.filter("a.l_linenumber < b.l_linenumber").select("l_orderkey", F.col("a.l_linenumber").alias("a"), F.col("b.l_linenumber").alias("b"))


#: Spans of days by supplier: a few days, or years for every 97th line.
DAYS = "SELECT l_suppkey, l_orderkey, l_linenumber, l_returnflag, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS start, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + CASE WHEN l_orderkey % 97 = 0 THEN 900 ELSE CAST(l_quantity AS BIGINT) % 10 END AS \"end\" FROM lineitem"


def day_spans(spark, sf_dir):
    start = F.unix_date(F.to_date("l_shipdate")).cast("long")
    long = F.when(F.col("l_orderkey") % 97 == 0, 900).otherwise(F.col("l_quantity").cast("long") % 10)
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", start.alias("start"), (start + long).alias("end"))


@query("interval_overlaps", f"WITH s AS ({DAYS}) SELECT a.l_suppkey, a.l_orderkey AS a, a.l_linenumber AS a_line, b.l_orderkey AS b, b.l_linenumber AS b_line FROM s a JOIN s b ON a.l_suppkey = b.l_suppkey AND a.start <= b.end AND b.start <= a.end WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'A'")
def interval_overlaps(spark, sf_dir):
    """Returned lines and accepted ones of a supplier that were under way on the same day."""
    spans = day_spans(spark, sf_dir)
    met = V.overlap_join(spans.filter("l_returnflag = 'R'"), spans.filter("l_returnflag = 'A'"), ["l_suppkey"])
    return met.select("l_suppkey", F.col("a.l_orderkey").alias("a"), F.col("a.l_linenumber").alias("a_line"), F.col("b.l_orderkey").alias("b"), F.col("b.l_linenumber").alias("b_line"))


@query("interval_runs", f"WITH s AS ({DAYS}), m AS (SELECT *, CASE WHEN start <= max(\"end\") OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY l_suppkey ORDER BY start, \"end\")), r AS (SELECT *, sum(fresh) OVER (PARTITION BY l_suppkey ORDER BY start, \"end\" ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT l_suppkey, min(start) AS start, max(\"end\") AS \"end\", count(*) AS spans FROM r GROUP BY l_suppkey, run")
def interval_runs(spark, sf_dir):
    return V.covered(day_spans(spark, sf_dir), ["l_suppkey"])


SAID = "list_sort(list_distinct(list_filter(regexp_extract_all(lower(coalesce({}, '')), '[\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 4 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in TT.EMPTY) + "], w))))"
SOURCES = "SELECT doc_id AS k, {} AS w FROM documents".format(SAID.format("string_split(text, chr(10))[1]"))
OTHERS = "SELECT page_id AS k, {} AS w FROM pages".format(SAID.format("regexp_extract(html, '<title>([^<]*)</title>', 1)"))


@query("title_matches", f"""WITH a AS (SELECT w, min(k) AS first, count(*) AS n FROM ({SOURCES}) WHERE len(w) > 0 GROUP BY 1), b AS (SELECT w, min(k) AS first, count(*) AS n FROM ({OTHERS}) WHERE len(w) > 0 GROUP BY 1),
p AS (SELECT a.first AS source_id, a.n AS sources, b.first AS other_id, b.n AS others, a.w AS aw, len(list_intersect(a.w, b.w)) AS shared, least(len(a.w), len(b.w)) AS short, greatest(len(a.w), len(b.w)) AS long FROM a, b)
SELECT source_id, sources, other_id, others FROM p WHERE (shared >= 2 AND shared >= 0.5 * short AND (short > 2 OR long <= 2 * short + 1)) OR (shared = 1 AND short = 1 AND NOT (len(aw) = 1 AND list_contains([{", ".join(f"'{w}'" for w in TT.COMMON)}], aw[1])))""")
def title_matches(spark, sf_dir):
    """First lines of documents against titles of pages."""
    sources = table(spark, sf_dir, "documents").select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("title"))
    others = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return TT.matches(sources, others, "doc_id", "title", "page_id", "title")


@query("dedup_concat", "SELECT p_brand, array_to_string(list(p_type ORDER BY first), ',') AS types FROM (SELECT p_brand, p_type, min(p_partkey) AS first FROM part GROUP BY 1, 2) GROUP BY 1")
def dedup_concat(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.array("p_type").alias("types"))
    return T.first_seen_union(parts, "p_brand", "p_partkey", "types").select("p_brand", F.array_join("types", ",").alias("types"))


LOOSE = "(SELECT l_partkey AS chunk_id, CAST(l_linenumber AS BIGINT) AS chunk_index, CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE 'Author ' || CAST(l_suppkey AS STRING) END AS title, 'h' || CAST(l_suppkey AS STRING) AS content_hash, CASE l_partkey % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' ELSE '5-LOW' END AS collection FROM lineitem WHERE l_linenumber > 5)"
APPEND = """SELECT f.doc_id, CAST(coalesce(l.n, 0) + row_number() OVER (PARTITION BY f.doc_id ORDER BY f.chunk_index, f.chunk_id) - 1 AS BIGINT) AS position, f.chunk_id
FROM (SELECT DISTINCT e.id AS doc_id, c.chunk_id, c.chunk_index FROM {loose} c JOIN (SELECT collection, {name}, max(id) AS id FROM {docs_} WHERE {name} <> '' GROUP BY ALL) e ON e.{name} = c.{key} AND e.collection = c.collection) f LEFT JOIN (SELECT doc_id, count(*) AS n FROM {manifest_} GROUP BY 1) l USING (doc_id)"""


def _append_sql(name: str, key: str, docs_: str) -> str:
    return APPEND.replace("{loose}", LOOSE).replace("{name}", name).replace("{key}", key).replace("{docs_}", docs_).replace("{manifest_}", "{manifest}")


def loose_chunks(spark, sf_dir):
    """Chunks without a document: the last lines of orders."""
    lines = table(spark, sf_dir, "lineitem").filter("l_linenumber > 5")
    supplier = F.col("l_suppkey").cast("string")
    title = F.when(F.col("l_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("Author "), supplier))
    collection = F.when(F.col("l_partkey") % 3 == 0, "1-URGENT").when(F.col("l_partkey") % 3 == 1, "2-HIGH").otherwise("5-LOW")
    return lines.select(F.col("l_partkey").alias("chunk_id"), F.col("l_linenumber").cast("long").alias("chunk_index"), title.alias("title"), F.concat(F.lit("h"), supplier).alias("content_hash"), collection.alias("collection"))


@query("link_by_title", _append_sql("title", "title", "(SELECT id, collection, author AS title FROM {docs})"))
def link_by_title(spark, sf_dir):
    docs = table(spark, sf_dir, "docs").withColumnRenamed("author", "title")
    return C.link_loose(table(spark, sf_dir, "manifest"), docs, loose_chunks(spark, sf_dir), "title", "title")


@query("link_by_content_hash", _append_sql("head_hash", "content_hash", "(SELECT id, collection, 'h' || CAST(id % 500 AS STRING) AS head_hash FROM {docs})"))
def link_by_content_hash(spark, sf_dir):
    docs = table(spark, sf_dir, "docs").withColumn("head_hash", F.concat(F.lit("h"), (F.col("id") % 500).cast("string")))
    return C.link_loose(table(spark, sf_dir, "manifest"), docs, loose_chunks(spark, sf_dir), "head_hash", "content_hash")


@query("loose_groups", """WITH l AS (SELECT DISTINCT collection, chunk_id, chunk_index, nullif(title, '') AS title FROM {loose}), g AS (SELECT collection, title, count(*) AS n FROM l GROUP BY ALL),
m AS (SELECT g.*, e.title IS NOT NULL AS linked FROM g LEFT JOIN (SELECT DISTINCT collection, author AS title FROM {docs}) e ON e.title = g.title AND e.collection = g.collection)
SELECT collection, CAST(coalesce(sum(n) FILTER (linked), 0) AS BIGINT) AS linked_chunks, count(*) FILTER (linked) AS linked_docs, CAST(coalesce(sum(n) FILTER (NOT linked), 0) AS BIGINT) AS loose_chunks, count(*) FILTER (NOT linked) AS loose_groups FROM m GROUP BY 1""".replace("{loose}", LOOSE))
def loose_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "docs").withColumnRenamed("author", "title")
    return C.loose_groups(docs, loose_chunks(spark, sf_dir), "title", "title")
