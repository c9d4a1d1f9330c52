"""Where queries register themselves, and the derived tables they share.

A derived table is a list of expressions that Spark and the oracle read alike, over one of the given tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DERIVED = {
    "chunks": ("embeddings", ("vec_id AS id", "embedding", "label AS topic", "'c' || CAST(label % 4 AS STRING) AS collection", "CASE label % 4 WHEN 0 THEN 'code' WHEN 1 THEN 'knowledge' WHEN 2 THEN 'docs' ELSE 'rdr' END AS kind")),
    "notes": ("documents", ("doc_id AS id", "source AS project", "text AS content", "lang || ', ' || source || ',' || lang AS tags", "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 1 + doc_id % 40 END AS ttl_days", "doc_id % 9 AS access_count")),
    "docs": ("orders", ("o_orderkey AS id", "o_orderpriority AS collection", "o_orderstatus AS content_type", "CASE WHEN o_orderkey % 11 = 0 THEN CAST(NULL AS TIMESTAMP) ELSE o_orderdate END AS indexed_at", "CASE WHEN o_orderkey % 13 = 0 THEN o_orderdate ELSE CAST(NULL AS TIMESTAMP) END AS deleted_at", "CASE WHEN o_orderkey % 7 = 0 THEN o_custkey ELSE CAST(NULL AS BIGINT) END AS alias_of", "o_orderkey % 6 AS chunk_count", "'Author ' || CAST(o_custkey AS STRING) AS author", "year(o_orderdate) AS year", "'1.' || CAST(o_custkey AS STRING) || '.' || CAST(o_orderkey AS STRING) AS tumbler")),
    "manifest": ("lineitem", ("l_orderkey AS doc_id", "CAST(l_linenumber AS BIGINT) AS position", "l_partkey AS chunk_id")),
    "parts": ("part", ("p_partkey AS id", "p_name AS text", "p_brand AS collection")),
    "links": ("orders", ("o_orderkey AS from_id", "o_custkey AS to_id", "CASE o_orderkey % 3 WHEN 0 THEN 'cites' WHEN 1 THEN 'relates' ELSE 'implements' END AS link_type", "o_orderstatus AS created_by", "o_orderdate AS created_at")),
    "log": ("events", ("event_id AS id", "ts", "event_type AS collection", "user_id", "CAST(floor(value) AS BIGINT) % 3 AS kept_count", "value / 100 AS top_distance", "props")),
    "steps": ("lineitem", ("l_orderkey AS run_id", "l_returnflag AS operator", "l_linestatus AS source", "CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_quantity END AS cost_usd")),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in DERIVED:
        base, expressions = DERIVED[name]
        return spark.read.parquet(f"{sf_dir}/{base}.parquet").selectExpr(*expressions)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register a query; names in braces in its SQL stand for derived tables."""

    def take(f):
        QUERIES[name] = f
        if sql is not None:
            out = sql
            for derived, (base, expressions) in DERIVED.items():
                out = out.replace("{" + derived + "}", f"(SELECT {', '.join(expressions)} FROM {base})")
            ORACLES[name] = out
        return f

    return take
