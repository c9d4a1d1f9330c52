"""The typed link graph: walks of a few hops, aliases, link tables and link generators.

Edges are (from_id, to_id, link_type) and may carry creators and dates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tumblers
from . import lineage

MOST_HOPS = 3
#: Links that a bulk deletion takes without being confirmed.
MOST_UNCONFIRMED = 10
#: Nodes of a frontier, with all that was reached, that are broadcast: a few MB.
FEW_NODES = 100_000
# What a named purpose walks along.
PURPOSES = {
    "find-implementations": ("implements", "implements-heuristic"),
    "decision-evolution": ("supersedes", "cites"),
    "reference-chain": ("cites", "quotes"),
    "documentation-for": ("implements", "implements-heuristic", "cites"),
    "soft-relations": ("relates", "comments"),
    "all-implementations": ("implements",),
    "factual-evidence": ("cites", "implements", "relates"),
}


def directed(edges: DataFrame, direction: str) -> DataFrame:
    """(src, dst) along, against or both ways."""
    out = edges.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    back = edges.select(F.col("to_id").alias("src"), F.col("from_id").alias("dst"))
    if direction not in ("out", "in", "both"):
        raise ValueError(f"no direction: {direction!r}")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def walk(seeds: DataFrame, edges: DataFrame, depth: int = 1, direction: str = "out", link_types: list[str] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, node, hops) for all that can be reached from the seeds (keys, node) in `depth` (3 at most) hops, seeds included with 0.

    Each hop joins the frontier once, drops repeats before the next and what was visited before, so that cycles end.
    """
    inside = edges.filter(F.col("link_type").isin(link_types)) if link_types is not None else edges
    steps = directed(inside, direction)
    reached = lineage.cut(seeds.select(*keys, "node").distinct().withColumn("hops", F.lit(0)))
    frontier, total = reached, reached.count()
    for hop in range(1, min(max(depth, 0), MOST_HOPS) + 1):
        # Few nodes go to where the links are; many meet them in a shuffle.
        few = F.broadcast if total <= FEW_NODES else lambda df: df
        found = steps.join(few(frontier), frontier["node"] == steps["src"]).select(*keys, F.col("dst").alias("node")).distinct()
        frontier = lineage.cut(found.join(few(reached.select(*keys, "node")), [*keys, "node"], "left_anti").withColumn("hops", F.lit(hop)))
        total += frontier.count()
        reached = reached.unionByName(frontier)
    return reached


def traverse(seeds: DataFrame, edges: DataFrame, link_types: list[str] | None = None, purpose: str | None = None, depth: int = 1, direction: str = "out") -> DataFrame:
    """A walk along link types or along those of a purpose, one of the two."""
    if (link_types is None) == (purpose is None):
        raise ValueError("link_types or purpose")
    if purpose is not None and purpose not in PURPOSES:
        raise ValueError(f"no purpose {purpose!r}")
    return walk(seeds, edges, depth, direction, list(link_types or PURPOSES[purpose]))


def suggest_links(codes: DataFrame, designs: DataFrame, edges: DataFrame, longer_than: int = 3) -> DataFrame:
    """(from_id, to_id): a code document whose stem stands in a design document's title, where no link joins the two in either direction.

    codes: (id, stem), designs: (id, title). Lower case counts, without `_` in stems and without `-`, `_` and blanks in
    titles. Distinct titles are cut into all pieces of the lengths that stems have, and pieces meet stems as equal strings.
    """
    stems = codes.select(F.col("id").alias("from_id"), F.replace(F.lower("stem"), F.lit("_"), F.lit("")).alias("word")).filter(F.length("word") > longer_than)
    titles = designs.select(F.col("id").alias("to_id"), F.regexp_replace(F.lower("title"), "[-_ ]", "").alias("title"))
    words = stems.select("word").distinct()
    sizes = F.array(*(F.lit(r[0]) for r in words.select(F.length("word")).distinct().collect())).cast("array<int>")  # lengths of file names
    n = F.length("title")
    pieces = F.flatten(F.transform(F.filter(sizes, lambda k: k <= n), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substr("title", i, k))))
    holds = titles.select("title").distinct().select("title", F.explode(F.array_distinct(pieces)).alias("word")).join(words, "word")
    met = titles.join(holds, "title").join(stems, "word").filter("from_id <> to_id").select("from_id", "to_id").distinct()
    known = edges.select("from_id", "to_id").union(edges.select(F.col("to_id"), F.col("from_id"))).distinct()
    return met.join(known, ["from_id", "to_id"], "left_anti")


def live_links(edges: DataFrame, live: DataFrame) -> DataFrame:
    """Links whose two ends are live documents. live: (id)."""
    return edges.join(live.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(live.select(F.col("id").alias("to_id")), "to_id", "left_semi")


def merge_links(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each (from_id, to_id, link_type): the first creator and date stay, other creators are listed in co_discovered_by."""
    both = old.select("from_id", "to_id", "link_type", "created_by", "created_at").unionByName(new.select("from_id", "to_id", "link_type", "created_by", "created_at"))
    merged = both.groupBy("from_id", "to_id", "link_type").agg(F.min(F.struct("created_at", "created_by")).alias("first"), F.collect_set("created_by").alias("by"))
    return merged.select("from_id", "to_id", "link_type", F.col("first.created_by").alias("created_by"), F.col("first.created_at").alias("created_at"), F.array_sort(F.array_remove("by", F.col("first.created_by"))).alias("co_discovered_by"))


def _ends(links: DataFrame) -> tuple[DataFrame, bool]:
    """(at, to) with the end of each chain of links (at, to), and whether some chain has none.

    Pointers are doubled until none moves: a chain of n links takes about log2(n) joins. With more steps behind each
    pointer than there are links, what still moves goes round a cycle and points into it.
    """
    jumps, steps = lineage.cut(links), 1
    n = jumps.count()
    while n:
        ahead = jumps.select(F.col("at").alias("to"), F.col("to").alias("next"))
        moved = lineage.cut(jumps.join(ahead, "to", "left").select("at", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
        jumps, steps = moved.select("at", "to"), 2 * steps
        if moved.filter("moved").isEmpty():
            return jumps, False
        if steps > n:
            return jumps, True
    return jumps, False


def resolve_aliases(docs: DataFrame, key: str, alias_of: str) -> DataFrame:
    """(key, target): the end of each chain of aliases, of any length; a chain that runs into a cycle ends before the document that it would meet again."""
    links = lineage.cut(docs.select(F.col(key).alias("at"), F.col(alias_of).alias("to")).filter("at IS NOT NULL AND to IS NOT NULL"))
    ends, cyclic = _ends(links)
    if cyclic:
        # Every document of a cycle is pointed to by another of it; without the cycles' links, chains end where they enter one.
        inside = lineage.cut(ends.select(F.col("to").alias("at")).join(links, "at", "left_semi").distinct())
        before = links.join(inside, "at", "left_semi").select("to", F.col("at").alias("last"))
        entries = _ends(links.join(inside, "at", "left_anti"))[0].unionByName(inside.withColumn("to", F.col("at")))
        ends = entries.join(before, "to", "left").select("at", F.coalesce("last", "to").alias("to"))
    return docs.select(key).join(ends, F.col(key) == F.col("at"), "left").select(key, F.coalesce("to", key).alias("target"))


def same_as(docs: DataFrame, key: str, digest: str) -> DataFrame:
    """Links `same-as` from each document to the smallest key among those of equal non-empty digest."""
    full = docs.filter(F.col(digest).isNotNull() & (F.col(digest) != ""))
    anchors = full.groupBy(digest).agg(F.min(key).alias("to_id"))
    return full.join(anchors, digest).filter(F.col(key) != F.col("to_id")).select(F.col(key).alias("from_id"), "to_id", F.lit("same-as").alias("link_type"))


def citation_links(docs: DataFrame, key: str, references: str, existing: DataFrame) -> DataFrame:
    """Links `cites` for references that name a known document, without those that exist."""
    named = docs.select(F.col(key).alias("from_id"), F.explode(references).alias("to_id")).distinct()
    known = named.join(docs.select(F.col(key).alias("to_id")), "to_id", "left_semi").filter("from_id <> to_id")
    return known.withColumn("link_type", F.lit("cites")).join(existing, ["from_id", "to_id", "link_type"], "left_anti").select("from_id", "to_id", "link_type")


def path_links(docs: DataFrame, key: str, text: str, pattern: str, targets: DataFrame, path: str, link_type: str) -> DataFrame:
    """Links from documents to those whose path their text names. pattern: a regular expression with one group."""
    named = docs.select(F.col(key).alias("from_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), 1))).alias(path))
    return named.join(targets.select(F.col("id").alias("to_id"), path), path).filter("from_id <> to_id").select("from_id", "to_id", F.lit(link_type).alias("link_type")).distinct()


def link_audit(edges: DataFrame, live: DataFrame, hashes: DataFrame | None = None) -> DataFrame:
    """(link_type, created_by, links, duplicates, orphaned, stale_spans, stale_hashes).

    Orphaned links have an end that is no live document. Where edges have a `span`: one by places is stale if its document (from_id) was
    indexed after the link was made (live: id, indexed_at; edges: created_at), one by hash if no chunk has the hash (hashes: chash).
    """
    ends = live.select("id", F.lit(True).alias("ok"))
    from_end = live.select(F.col("id").alias("from_id"), F.lit(True).alias("from_ok"), *([F.col("indexed_at").alias("__indexed")] if "indexed_at" in live.columns else []))
    marked = edges.join(from_end, "from_id", "left").join(ends.withColumnsRenamed({"id": "to_id", "ok": "to_ok"}), "to_id", "left")
    old, gone = F.lit(False), F.lit(False)
    if "span" in edges.columns:
        marked = marked.withColumn("__span", tumblers.span_parts(F.col("span")))
        kind = F.col("__span.kind")
        old = F.coalesce(kind.isin("lines", "chunk") & (F.col("__indexed") > F.col("created_at")), F.lit(False))
        if hashes is not None:
            known = hashes.select(F.col("chash").alias("__hash")).distinct().withColumn("__there", F.lit(True))
            marked = marked.withColumn("__hash", F.when(kind == "hash", F.regexp_extract("span", "([0-9a-f]{64}|[0-9a-f]{32})", 1))).join(known, "__hash", "left")
            gone = F.col("__hash").isNotNull() & F.col("__there").isNull()
    lost = F.col("from_ok").isNull() | F.col("to_ok").isNull()
    single = marked.groupBy("from_id", "to_id", "link_type", "created_by").agg(F.count("*").alias("n"), F.count_if(lost).alias("lost"), F.count_if(old).alias("old"), F.count_if(gone).alias("gone"))
    return single.groupBy("link_type", "created_by").agg(F.sum("n").alias("links"), F.sum(F.col("n") - 1).alias("duplicates"), F.sum("lost").alias("orphaned"), F.sum("old").alias("stale_spans"), F.sum("gone").alias("stale_hashes"))


def link_density(seeds: DataFrame, edges: DataFrame, group: str, depth: int = 1, low: float = 3) -> DataFrame:
    """(group, seeds, p50, p90, low): sizes of what a seed reaches, itself left out. p90 is the value at place int(.9 (n-1) + .5)."""
    sizes = walk(seeds.select(group, F.col("node").alias("seed"), "node"), edges, depth, "both", keys=(group, "seed")).groupBy(group, "seed").agg((F.count("*") - 1).alias("size"))
    # How many seeds have each size: a few rows for each group.
    counted = sizes.groupBy(group, "size").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(group).orderBy("size"))
    placed = counted.withColumn("upto", upto).withColumn("all", F.sum("n").over(Window.partitionBy(group)))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("size")))
    out = placed.groupBy(group).agg(F.max("all").alias("seeds"), ((at(F.floor((F.col("all") - 1) / 2)) + at(F.floor(F.col("all") / 2))) / 2).alias("p50"), at(F.floor(0.9 * (F.col("all") - 1) + 0.5)).alias("p90"))
    return out.withColumn("low", F.col("p50") < low)


def unlink(edges: DataFrame, pairs: DataFrame, link_type: str | None = None) -> DataFrame:
    """Links without those of the pairs (from_id, to_id), of one type or of all."""
    gone = pairs.select("from_id", "to_id").distinct()
    if link_type is None:
        return edges.join(gone, ["from_id", "to_id"], "left_anti")
    return edges.filter(F.col("link_type") != link_type).unionByName(edges.filter(F.col("link_type") == link_type).join(gone, ["from_id", "to_id"], "left_anti"))


def bulk_unlink(edges: DataFrame, condition: Column, confirmed: bool = False) -> DataFrame:
    """Links without those that meet a condition; more than MOST_UNCONFIRMED of them go only if that is confirmed."""
    meets = F.coalesce(condition, F.lit(False))
    if not confirmed and edges.filter(meets).limit(MOST_UNCONFIRMED + 1).count() > MOST_UNCONFIRMED:
        raise ValueError(f"more than {MOST_UNCONFIRMED} links would go")
    return edges.filter(~meets)


def auto_links(contexts: DataFrame, docs: DataFrame, edges: DataFrame, default: str = "relates") -> DataFrame:
    """(from_id, to_id, link_type, outcome) for asked links (from_id, target, link_type): `created`, `exists`, `invalid` where the target is no address,
    `missing` where an end is no document. docs: (id, tumbler)."""
    known = docs.select(F.col("id").alias("to_id"), F.col("tumbler").alias("target"))
    ends = docs.select(F.col("id").alias("from_id"), F.lit(True).alias("__from"))
    wanted = contexts.select("from_id", "target", F.coalesce("link_type", F.lit(default)).alias("link_type")).distinct()
    met = wanted.join(known, "target", "left").join(ends, "from_id", "left")
    there = edges.select("from_id", "to_id", "link_type").distinct().withColumn("__there", F.lit(True))
    met = met.join(there, ["from_id", "to_id", "link_type"], "left")
    outcome = F.when(tumblers.parsed(F.col("target")).isNull(), "invalid").when(F.col("to_id").isNull() | F.col("__from").isNull(), "missing").when(F.col("__there"), "exists").otherwise("created")
    return met.select("from_id", "target", "to_id", "link_type", outcome.alias("outcome"))


def links_for_file(edges: DataFrame, docs: DataFrame, path: str, name: str = "path") -> DataFrame:
    """(from_id, to_id, link_type, direction) of the live documents with a file path: links that leave and that reach them."""
    mine = docs.filter((F.col(name) == path) & F.col("deleted_at").isNull()).select("id")
    side = lambda c, direction: edges.join(mine.select(F.col("id").alias(c)), c, "left_semi").select("from_id", "to_id", "link_type", F.lit(direction).alias("direction"))
    return side("from_id", "out").unionByName(side("to_id", "in"))


def reached(seeds: DataFrame, edges: DataFrame, docs: DataFrame, manifest: DataFrame, **how) -> DataFrame:
    """(tumbler, id, collection): the live documents that a walk reaches and the chunks of their manifests, once each; null
    ids for documents without chunks. Seeds that are no documents are dropped. docs: (id, tumbler, collection, deleted_at)."""
    alive = docs.filter(F.col("deleted_at").isNull()).select(F.col("id").alias("node"), "tumbler", "collection")
    found = traverse(seeds.join(alive.select("node"), "node", "left_semi"), edges, **how)
    chunks = manifest.select(F.col("doc_id").alias("node"), F.col("chunk_id").alias("id"))
    return alive.join(found.select("node"), "node").join(chunks, "node", "left").select("tumbler", "id", "collection").distinct()


def resolve(asked: DataFrame, docs: DataFrame) -> DataFrame:
    """(asked, id, by) of asked addresses, paths or titles (asked): the live document with that address, else with that path, else
    with that title (the smallest id of several); null where there is none. docs: (id, tumbler, path, title, deleted_at)."""
    alive = docs.filter(F.col("deleted_at").isNull())
    names = F.array(*(F.struct(F.lit(i).alias("rank"), F.lit(c).alias("by"), F.col(c).alias("asked")) for i, c in enumerate(("tumbler", "path", "title"))))
    named = alive.select("id", F.explode(names).alias("n")).select("n.asked", F.struct("n.rank", "id", "n.by").alias("n")).filter("asked IS NOT NULL")
    best = asked.select("asked").distinct().join(named, "asked").groupBy("asked").agg(F.min("n").alias("n"))
    return asked.join(best, "asked", "left").select("asked", "n.id", "n.by")
