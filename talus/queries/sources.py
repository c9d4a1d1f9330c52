"""Identifiers and addresses of sources, resolution by name, and the smaller link operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import references as I
from ..functions import text as X
from ..functions import tumblers as A
from ..operators import fulltext as T
from ..operators import graph as G
from ..operators import text_index as TI
from .registry import query, table
from .retrieval import notes_index

FOLDED = "regexp_extract_all(strip_accents(lower(coalesce({}, ''))), '[\\p{{L}}\\p{{N}}_]+')"


def _stems(column: str) -> str:
    """The stems of a column's words, in SQL that has no look-around and no back-references."""
    words = FOLDED.format(column)
    ends = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '^(.{2,})(ies|ied)$', '\\1y'), 'sses$', 'ss'), '^(.{2,}[^su])s$', '\\1'), '^(.*[aeiouy].*[^e]|.*[aiouy])(ingly|edly|ing|ed)$', '\\1')"
    single = "CASE WHEN regexp_matches(w, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(w, length(w) - 1) ELSE w END"
    long = f"list_transform(list_transform(list_transform(list_filter({words}, lambda w: regexp_full_match(w, '[a-z]{{4,}}')), lambda w: {ends}), lambda w: {single}), lambda w: regexp_replace(w, '^(.{{3,}})e$', '\\1'))"
    return f"list_concat({long}, list_filter({words}, lambda w: NOT regexp_full_match(w, '[a-z]{{4,}}')))"


def _placed(column: str) -> str:
    """All words of a column in order, with the rules of stems for long ones on every word."""
    ends = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '^(.{2,})(ies|ied)$', '\\1y'), 'sses$', 'ss'), '^(.{2,}[^su])s$', '\\1'), '^(.*[aeiouy].*[^e]|.*[aiouy])(ingly|edly|ing|ed)$', '\\1')"
    return f"list_transform(list_transform({FOLDED.format(column)}, lambda w: {ends}), lambda w: regexp_replace(w, '^(.{{3,}})e$', '\\1'))"


FIELDS = f"SELECT id, {_stems('content')} AS c, {FOLDED.format('project')} AS p, {FOLDED.format('tags')} AS t FROM {{notes}}"


def _text_search(spark, sf_dir, asked):
    notes = table(spark, sf_dir, "notes")
    return T.matches(notes, asked, {"content": "B"}, {"project": "A", "tags": "C"}).select("id", F.round("score", 6).alias("score"))


STEMS_SQL = f"WITH f AS ({FIELDS}) SELECT id, CAST(0.4 AS DOUBLE) AS score FROM f WHERE list_contains(c, 'licens') AND list_contains(c, 'releas')"


@query("text_index_stems", STEMS_SQL)
def text_index_stems(spark, sf_dir):
    return TI.search(spark, notes_index(spark, sf_dir), "Licensing the RELEASES").withColumn("score", F.round("score", 6))


@query("text_search_stems", f"WITH f AS ({FIELDS}) SELECT id, CAST(0.4 AS DOUBLE) AS score FROM f WHERE list_contains(c, 'licens') AND list_contains(c, 'releas')")
def text_search_stems(spark, sf_dir):
    """`Licensing` and `releases` find `license` and `released`; the stopword does not count."""
    return _text_search(spark, sf_dir, "Licensing the RELEASES")


TAGS_SQL = f"""WITH f AS ({FIELDS}), s AS (SELECT id, CASE WHEN list_contains(c, 'en') AND list_contains(c, 'src1') THEN 0.4 ELSE 0.0 END AS a,
  greatest(CASE WHEN list_contains(p, 'en') THEN 1.0 ELSE 0.0 END, CASE WHEN list_contains(t, 'en') THEN 0.2 ELSE 0.0 END) AS x, greatest(CASE WHEN list_contains(p, 'src1') THEN 1.0 ELSE 0.0 END, CASE WHEN list_contains(t, 'src1') THEN 0.2 ELSE 0.0 END) AS y FROM f)
SELECT * FROM (SELECT id, CAST(round(greatest(a, CASE WHEN x > 0 AND y > 0 THEN (x + y) / 2 ELSE 0 END), 6) AS DOUBLE) AS score FROM s) WHERE score > 0"""


@query("text_index_tags", TAGS_SQL)
def text_index_tags(spark, sf_dir):
    return TI.search(spark, notes_index(spark, sf_dir), "en SRC1").withColumn("score", F.round("score", 6))


@query("text_index_top", TAGS_SQL + " ORDER BY score DESC, id LIMIT 25")
def text_index_top(spark, sf_dir):
    """The best 25, reading shards by their bounds."""
    return TI.top(spark, notes_index(spark, sf_dir), "en SRC1", 25).withColumn("score", F.round("score", 6))


@query("text_index_phrase", f"SELECT id, times FROM (SELECT id, CAST(len(list_filter(range(1, len(c)), lambda i: c[i] = 'releas' AND c[i + 1] = 'under')) AS BIGINT) AS times FROM (SELECT id, {_placed('content')} AS c FROM {{notes}})) WHERE times > 0")
def text_index_phrase(spark, sf_dir):
    """Stems that follow each other, from the stored positions."""
    return TI.phrase(spark, notes_index(spark, sf_dir), "Released under")


@query("text_search_tags", TAGS_SQL)
def text_search_tags(spark, sf_dir):
    """Words of identifiers, whose heaviest field counts."""
    return _text_search(spark, sf_dir, "en SRC1")


@query("text_search_marks", f"WITH f AS ({FIELDS}) SELECT id, CAST(0.4 AS DOUBLE) AS score FROM f WHERE list_contains(c, 'etr') AND list_contains(c, 're')")
def text_search_marks(spark, sf_dir):
    """Letters with marks and without are the same, in the query and in the texts."""
    return _text_search(spark, sf_dir, "Etrè re\u0301")


CITED = "CASE p_partkey % 4 WHEN 0 THEN p_name || ' see 10.1000/x' || CAST(p_size AS STRING) || ', DOI: 10.1145/' || CAST(p_partkey AS STRING) || '.7).' WHEN 1 THEN 'see (10.5555/' || p_type || ').' WHEN 2 THEN 'papers/' || p_type || '-2503.0' || CAST(1000 + p_partkey % 9000 AS STRING) || 'v2.pdf' ELSE 'arXiv: 2101.' || CAST(10000 + p_partkey % 9000 AS STRING) || ' and ' || p_name END"
CITED_BACK = "regexp_replace(coalesce(nullif(regexp_extract(t, '(?i)(?:doi[:\\s]+|https?://(?:dx\\.)?doi\\.org/)(10\\.\\d{4,9}/[-._;()/:a-zA-Z0-9]+)', 1), ''), nullif(regexp_extract(t, '\\b(10\\.\\d{4,9}/[-._;()/:a-zA-Z0-9]+)', 1), '')), '[.,;:)\\]]+$', '')".replace("\\\\", "\\")


@query("identifiers", f"SELECT id, {CITED_BACK} AS doi, CASE WHEN id % 4 = 2 THEN '2503.0' || CAST(1000 + id % 9000 AS STRING) WHEN id % 4 = 3 THEN '2101.' || CAST(10000 + id % 9000 AS STRING) END AS arxiv FROM (SELECT p_partkey AS id, {CITED} AS t FROM part)")
def identifiers(spark, sf_dir):
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", f"{CITED} AS t")
    return rows.select("id", I.doi(F.col("t")).alias("doi"), I.arxiv(F.col("t")).alias("arxiv"))


@query("source_uris", """SELECT page_id, uri, CASE WHEN uri = '' THEN NULL WHEN NOT regexp_matches(uri, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN 'no scheme' WHEN lower(regexp_extract(uri, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) NOT IN ('file', 'https') THEN 'unknown scheme' END AS fault
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'file:///' || regexp_extract(url, '//([^/]*)', 1) WHEN 2 THEN 'file:///root/' || regexp_extract(url, '//([^/]*)', 1) ELSE '' END AS uri FROM pages)""")
def source_uris(spark, sf_dir):
    """Given URIs, absolute and relative paths, and neither."""
    host = F.regexp_extract("url", "//([^/]*)", 1)
    kind = F.col("page_id") % 4
    uri = I.source_uri(F.when(kind == 0, F.col("url")), F.when(kind == 1, F.concat(F.lit("/"), host)).when(kind == 2, host), F.lit("/root/"))
    return table(spark, sf_dir, "pages").select("page_id", uri.alias("uri"), I.uri_fault(uri).alias("fault"))


@query("file_kinds", "SELECT page_id, regexp_matches(lower(url), '[.](min[.]js|min[.]mjs|min[.]cjs|min[.]css|bundle[.]js|bundle[.]mjs)$') AS minified, starts_with(html, '#!') AS script FROM (SELECT page_id, html, url || CASE WHEN page_id % 3 = 0 THEN '.MIN.js' WHEN page_id % 3 = 1 THEN '.js' ELSE '.bundle.mjs' END AS url FROM pages)")
def file_kinds(spark, sf_dir):
    ending = F.when(F.col("page_id") % 3 == 0, ".MIN.js").when(F.col("page_id") % 3 == 1, ".js").otherwise(".bundle.mjs")
    return table(spark, sf_dir, "pages").select("page_id", I.is_minified(F.concat("url", ending)).alias("minified"), I.has_shebang(F.col("html")).alias("script"))


@query("scope_tags", "SELECT o_orderkey AS id, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'docs__' || o_orderstatus END, 'code__x' || CAST(o_custkey % 3 AS STRING), CASE WHEN o_orderkey % 5 = 0 THEN 'rdr__' END], lambda x: x IS NOT NULL))), ',') AS tags FROM orders")
def scope_tags(spark, sf_dir):
    given = F.concat_ws(",", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" docs__"), "o_orderstatus", F.lit("-0123abCD "))), F.lit("all"), F.concat(F.lit("code__x"), (F.col("o_custkey") % 3).cast("string"), F.lit("-*")), F.when(F.col("o_orderkey") % 5 == 0, F.lit("rdr__*")), F.lit(""))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), I.scope_tags(given).alias("tags"))


@query("newest_first", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts) DESC, event_id) AS place FROM events")
def newest_first(spark, sf_dir):
    """The key orders as the dates do, the other way round."""
    from pyspark.sql.window import Window

    key = I.newest_first(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(key, "event_id")).cast("long").alias("place"))


SEEDS = ("released under the license", "le chat et la maison")
SENTENCES = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+([A-Z(\[`*_])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: substring(trim(s, ' '), 1, 600)), lambda s: s <> '')"
SHARES = "greatest(" + ", ".join(f"CAST(len(list_intersect({[*dict.fromkeys(q.split())]}, list_distinct(regexp_extract_all(lower(s), '[a-z0-9_]+')))) AS DOUBLE) / {len(set(q.split()))}" for q in SEEDS) + ")"


@query("salient_sentences", f"""WITH s AS (SELECT doc_id, unnest({SENTENCES}) AS s, generate_subscripts({SENTENCES}, 1) AS i FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round({SHARES}, 9) DESC, i) AS n FROM s)
SELECT d.doc_id, sha256(coalesce(string_agg(s, chr(10) ORDER BY i) FILTER (n <= 3), '')) AS digest FROM documents d LEFT JOIN r USING (doc_id) GROUP BY 1""")
def salient_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.array_join(X.salient(F.col("text"), list(SEEDS)), "\n"), 256).alias("digest"))


@query("span_text", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN sha256(text) ELSE sha256(substring(text, CAST(doc_id % 50 + 1 AS INT), CAST(doc_id % 40 AS INT))) END AS digest FROM documents")
def span_text(spark, sf_dir):
    start = F.col("doc_id") % 50
    span = F.concat(F.lit("chash:"), F.sha2("text", 256), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit(":"), start.cast("string"), F.lit("-"), (start + F.col("doc_id") % 40).cast("string"))))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(A.span_text(span, F.col("text")), 256).alias("digest"))


@query("unlink", "SELECT from_id, to_id, link_type FROM {links} WHERE NOT (link_type = 'cites' AND (from_id, to_id) IN (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 200000))")
def unlink(spark, sf_dir):
    dear = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_orderkey").alias("from_id"), F.col("o_custkey").alias("to_id"))
    return G.unlink(table(spark, sf_dir, "links"), dear, "cites").select("from_id", "to_id", "link_type")


@query("bulk_unlink", "SELECT link_type, count(*) AS n FROM {links} WHERE NOT (created_by = 'F' AND created_at < TIMESTAMP '1997-01-01') GROUP BY 1")
def bulk_unlink(spark, sf_dir):
    left = G.bulk_unlink(table(spark, sf_dir, "links"), (F.col("created_by") == "F") & (F.col("created_at") < F.lit("1997-01-01").cast("timestamp")), confirmed=True)
    return left.groupBy("link_type").agg(F.count("*").alias("n"))


@query("auto_links", """WITH c AS (SELECT o_orderkey + 1 AS from_id, CASE WHEN o_orderkey % 10 = 0 THEN 'abc' ELSE '1.' || CAST(o_custkey AS STRING) || '.' || CAST(CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_orderkey END AS STRING) END AS target, CASE WHEN o_orderkey % 2 = 0 THEN 'cites' ELSE 'relates' END AS link_type FROM orders)
SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN NOT regexp_matches(target, '^[0-9]+([.][0-9]+)*$') THEN 'invalid' WHEN t.id IS NULL OR f.id IS NULL THEN 'missing' WHEN EXISTS (SELECT 1 FROM {links} l WHERE l.from_id = c.from_id AND l.to_id = t.id AND l.link_type = c.link_type) THEN 'exists' ELSE 'created' END AS outcome FROM c LEFT JOIN {docs} t ON t.tumbler = c.target LEFT JOIN {docs} f ON f.id = c.from_id) GROUP BY 1""")
def auto_links(spark, sf_dir):
    last = F.when(F.col("o_orderkey") % 7 == 0, -1).otherwise(F.col("o_orderkey")).cast("string")
    target = F.when(F.col("o_orderkey") % 10 == 0, "abc").otherwise(F.concat_ws(".", F.lit("1"), F.col("o_custkey").cast("string"), last))
    contexts = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("from_id"), target.alias("target"), F.when(F.col("o_orderkey") % 2 == 0, "cites").alias("link_type"))
    return G.auto_links(contexts, table(spark, sf_dir, "docs"), table(spark, sf_dir, "links")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("links_for_file", "WITH m AS (SELECT id FROM {docs} WHERE author = 'Author 7' AND deleted_at IS NULL) SELECT from_id, to_id, link_type, 'out' AS direction FROM {links} WHERE from_id IN (SELECT id FROM m) UNION ALL SELECT from_id, to_id, link_type, 'in' FROM {links} WHERE to_id IN (SELECT id FROM m)")
def links_for_file(spark, sf_dir):
    return G.links_for_file(table(spark, sf_dir, "links"), table(spark, sf_dir, "docs"), "Author 7", "author")


@query("traverse_chunks", """WITH d AS (SELECT * FROM {docs} WHERE deleted_at IS NULL), e AS (SELECT from_id, to_id FROM {links} WHERE link_type = 'cites'), s AS (SELECT id FROM d WHERE id % 20 = 0),
r AS (SELECT id FROM s UNION SELECT e.to_id FROM s JOIN e ON e.from_id = s.id) SELECT DISTINCT d.tumbler, m.chunk_id AS id, d.collection FROM r JOIN d USING (id) LEFT JOIN {manifest} m ON m.doc_id = d.id""")
def traverse_chunks(spark, sf_dir):
    seeds = table(spark, sf_dir, "docs").filter("id % 20 = 0").select(F.col("id").alias("node")).union(spark.range(1).select(F.lit(-5).cast("long")))
    return G.reached(seeds, table(spark, sf_dir, "links"), table(spark, sf_dir, "docs"), table(spark, sf_dir, "manifest"), link_types=["cites"])


NAMED = "(SELECT id, tumbler, 'files/' || CAST(id % 5000 AS STRING) AS path, author AS title, deleted_at FROM {docs})"


@query("resolve_names", f"""WITH d AS (SELECT * FROM {NAMED} WHERE deleted_at IS NULL), n AS (SELECT tumbler AS asked, 0 AS r, id, 'tumbler' AS how FROM d UNION ALL SELECT path, 1, id, 'path' FROM d UNION ALL SELECT title, 2, id, 'title' FROM d),
a AS (SELECT CASE c_custkey % 4 WHEN 0 THEN 'Author ' || CAST(c_custkey AS STRING) WHEN 1 THEN 'files/' || CAST(c_custkey AS STRING) WHEN 2 THEN '1.' || CAST(c_custkey AS STRING) || '.' || CAST(c_custkey * 3 AS STRING) ELSE 'none' END AS asked FROM customer)
SELECT a.asked, b.id, b.how AS "by" FROM a LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY r, id) AS k FROM n) WHERE k = 1) b USING (asked)""")
def resolve_names(spark, sf_dir):
    docs = table(spark, sf_dir, "docs").selectExpr("id", "tumbler", "'files/' || CAST(id % 5000 AS STRING) AS path", "author AS title", "deleted_at")
    asked = table(spark, sf_dir, "customer").selectExpr("CASE c_custkey % 4 WHEN 0 THEN 'Author ' || CAST(c_custkey AS STRING) WHEN 1 THEN 'files/' || CAST(c_custkey AS STRING) WHEN 2 THEN '1.' || CAST(c_custkey AS STRING) || '.' || CAST(c_custkey * 3 AS STRING) ELSE 'none' END AS asked")
    return G.resolve(asked, docs)
