"""Topics: assignment to centroids, projection between collections, specificity, labels, audits and clustering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import vectors as V
from . import density, lineage, search

#: Terms whose weights are sent to every task, some 30 MB; more are joined.
FEW_TERMS = 500_000
#: Rows of a collection up to which topics are found by density.
DENSE = 5000


def assign_nearest(chunks: DataFrame, centroids: DataFrame) -> DataFrame:
    """(id, topic_id, similarity): the nearest centroid of each chunk, the smaller topic_id of equal ones. centroids: (topic_id, embedding)."""
    near = search.closest_query(centroids, chunks, query_key="topic_id")
    return near.select("id", F.col("query_id").alias("topic_id"), (1 - F.col("distance")).alias("similarity"))


def assign_own(chunks: DataFrame, centroids: DataFrame, collection: str = "collection", key: str = "id", vector: str = "embedding") -> DataFrame:
    """(key, topic_id, collection): the nearest centroid of each chunk's own collection, however far; the smaller topic_id of equal ones.

    Blocks of a collection's chunks meet its centroids. Chunks of collections without centroids, and those without a vector, get none.
    """
    points = density.points(chunks, collection, key, vector)
    there = centroids.select(F.col(collection).alias("by"), F.col("topic_id"), F.col(vector).alias("c"))
    cells = points.select(*(F.col(c).alias(c) for c in ("by", "block"))).distinct()
    sent = density.join_safe(cells, there, "by")
    topic = centroids.schema["topic_id"].dataType

    def nearest(rows: pa.Table, own: pa.Table) -> pa.Table:
        if not rows.num_rows or not own.num_rows:
            return pa.table([rows["by"].slice(0, 0), rows["id"].slice(0, 0), own["topic_id"].slice(0, 0)], ["by", "id", "topic_id"])
        own = own.sort_by("topic_id")
        far = np.round(density.squares(density.matrix_of(rows["v"]), density.matrix_of(own["c"])), 12)
        return pa.table([rows["by"], rows["id"], own["topic_id"].take(pa.array(far.argmin(axis=1)))], ["by", "id", "topic_id"])

    schema = T.StructType([points.schema["by"], points.schema["id"], T.StructField("topic_id", topic)])
    met = points.groupBy("by", "block").cogroup(sent.groupBy("by", "block")).applyInArrow(nearest, schema)
    return met.select(F.col("id").alias(key), "topic_id", F.col("by").alias(collection))


def assign_passes(chunks: DataFrame, centroids: DataFrame, existing: DataFrame, least: float, cross: bool = True) -> DataFrame:
    """(id, topic_id, similarity, assigned_by, source_collection): existing rows, then what two passes add; a pair that is there stays as it is.

    The own pass gives each chunk the nearest topic of its collection, without a similarity (`centroid`), unless it has one of that collection's topics;
    the cross pass every topic of other collections that is at least `least` alike (`projection`). chunks: (id, collection, embedding), centroids: (topic_id, collection, embedding).
    """
    topics = centroids.select("topic_id", F.col("collection").alias("__topic_of"))
    taken = existing.select("id", "topic_id").join(topics, "topic_id").select("id", F.col("__topic_of").alias("collection")).distinct()
    own = assign_own(chunks, centroids).join(taken, ["id", "collection"], "left_anti")
    new = own.select("id", "topic_id", F.lit(None).cast("double").alias("similarity"), F.lit("centroid").alias("assigned_by"), F.col("collection").alias("source_collection"))
    if cross:
        near = project(chunks, centroids.select("topic_id", "embedding"), least).join(topics, "topic_id").join(chunks.select("id", F.col("collection").alias("source_collection")), "id")
        foreign = near.filter(F.col("source_collection") != F.col("__topic_of"))
        new = new.unionByName(foreign.select("id", "topic_id", "similarity", F.lit("projection").alias("assigned_by"), "source_collection"))
    return existing.unionByName(new.join(existing.select("id", "topic_id"), ["id", "topic_id"], "left_anti").select(*existing.columns))


def project(chunks: DataFrame, centroids: DataFrame, least: float, weights: DataFrame | None = None) -> DataFrame:
    """(id, topic_id, similarity) with similarity (times the topic's weight, if given) of `least` or more; the raw value is kept.

    The limit of each topic goes to where chunks are scored, so that only what reaches it is a row. weights: (topic_id, icf).
    """
    limited = centroids.withColumn("most", F.lit(1 - least))
    if weights is not None:
        icf_of = F.coalesce("icf", F.lit(1.0))
        limited = centroids.join(weights.select("topic_id", "icf"), "topic_id", "left").withColumn("most", F.when(icf_of > 0, 1 - least / icf_of).otherwise(F.lit(-1.0)))
    near = search.distances(limited, chunks, None, query_key="topic_id", most="most")
    return near.select("id", F.col("query_id").alias("topic_id"), (1 - F.col("distance")).alias("similarity"))


def keep_higher(old: DataFrame, new: DataFrame) -> DataFrame:
    """Assignments by (id, topic_id), the larger similarity of two."""
    return old.unionByName(new).groupBy("id", "topic_id").agg(F.max("similarity").alias("similarity"))


def icf(assignments: DataFrame) -> DataFrame:
    """(topic_id, df, icf): log2 of all source collections by those a topic is found in. No rows for fewer than two collections."""
    known = assignments.filter(F.col("source_collection").isNotNull())
    by_topic = known.groupBy("topic_id").agg(F.countDistinct("source_collection").alias("df"))
    counted = by_topic.withColumn("n", known.agg(F.countDistinct("source_collection")).scalar()).filter("n >= 2")
    return counted.select("topic_id", "df", F.log2(F.col("n") / F.col("df")).alias("icf"))


# Parts of labels that say that a topic is about form.
GENERIC = ("assert", "junit", "builder", "class", "import", "exception", "getter", "setter", "variable", "declaration", "operator")


def generic_words(label: Column) -> Column:
    """The words of GENERIC that a label holds anywhere, whatever the case."""
    return F.filter(F.array(*map(F.lit, GENERIC)), lambda w: F.contains(F.lower(F.coalesce(label, F.lit(""))), w))


def hubs(assignments: DataFrame, least_collections: int = 2, most_icf: float | None = None, topics: DataFrame | None = None) -> DataFrame:
    """(topic_id, df, icf, chunks, score) of topics that many collections share, with `generic` words of their labels if topics (topic_id, label) are given.

    The score is chunks * (1 - icf); the worst hub has the largest (`ordered_hubs`).
    """
    chunks = assignments.groupBy("topic_id").agg(F.count("*").alias("chunks"))
    out = icf(assignments).filter(F.col("df") >= least_collections)
    out = out.filter(F.col("icf") <= most_icf) if most_icf is not None else out
    out = out.join(chunks, "topic_id").withColumn("score", F.col("chunks") * (1 - F.col("icf")))
    return out if topics is None else out.join(topics.select("topic_id", "label"), "topic_id", "left").withColumn("generic", generic_words(F.col("label")))


def ordered_hubs(found: DataFrame) -> DataFrame:
    return found.orderBy(F.desc("score"), "topic_id")


def least_similarity(collection: Column, limits: dict[str, float], otherwise: float) -> Column:
    """The limit of the longest of the given beginnings that a collection's name has."""
    out = F.lit(otherwise)
    for begin in sorted(limits, key=len):
        out = F.when(F.startswith(collection, F.lit(begin)), F.lit(limits[begin])).otherwise(out)
    return out


def audit(assignments: DataFrame, group: str, least: float | Column) -> DataFrame:
    """(group, rows, p10, p50, p90, below): nearest-rank quantiles of similarity, and rows strictly below a limit, a number or an expression over the rows."""
    limit = F.lit(least) if isinstance(least, int | float) else least
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY similarity)").alias(f"p{round(p * 100)}")
    return assignments.groupBy(group).agg(F.count("*").alias("rows"), rank(0.1), rank(0.5), rank(0.9), F.count_if(F.col("similarity") < limit).alias("below"))


def top_topics(assignments: DataFrame, group: str, topics: DataFrame, first: int = 5) -> DataFrame:
    """(group, topic_id, chunks, rank, generic): the topics that most of a group's rows are assigned to, and the generic words of their labels."""
    counts = assignments.groupBy(group, "topic_id").agg(F.count("*").alias("chunks"))
    order = Window.partitionBy(group).orderBy(F.desc("chunks"), "topic_id")
    ranked = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    return ranked.join(topics.select("topic_id", "label"), "topic_id", "left").withColumn("generic", generic_words(F.col("label"))).drop("label")


def topic_terms(docs: DataFrame, key: str, topic: str, text: str, most: int = 10) -> DataFrame:
    """(topic, term, score, rank): the mean over a topic's documents of a term's share in them.

    Terms are words of two or more letters, digits or `_`, without stopwords; a document's counts times
    ln((1 + documents) / (1 + documents with the term)) + 1 are brought to length one. Ties of rounded scores go by term.
    """
    n = docs.count()
    terms = F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]{2,})"), 1), lambda t: ~t.isin(list(X.STOPWORDS)))
    # Documents are shuffled once, by key; their words are counted, weighed and brought to length where they stand.
    counted = docs.select(key, topic, text).repartition(key).select(key, topic, F.explode(terms).alias("term")).groupBy(key, topic, "term").agg(F.count("*").alias("tf"))
    df = lineage.cut(counted.groupBy("term").agg((F.log((1.0 + n) / (1.0 + F.count("*"))) + 1).alias("idf")))
    few = df.limit(FEW_TERMS + 1).count() <= FEW_TERMS
    weighed = counted.join(F.broadcast(df) if few else df, "term").withColumn("w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))  # the words of one document
    sizes = docs.groupBy(topic).agg(F.count("*").alias("docs"))
    means = weighed.withColumn("share", F.col("w") / length).groupBy(topic, "term").agg(F.sum("share").alias("s"))
    scored = means.join(F.broadcast(sizes), means[topic].eqNullSafe(sizes[topic])).select(means[topic], "term", F.round(F.col("s") / F.col("docs"), 8).alias("score"))  # a row for each topic
    order = Window.partitionBy(topic).orderBy(F.desc("score"), "term")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most)


def labels(terms: DataFrame, topic: str, first: int = 3) -> DataFrame:
    """(topic, label): the first terms of a topic."""
    return terms.filter(F.col("rank") <= first).groupBy(topic).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda s: s["term"]), " ").alias("label"))


def cluster_count(n: int | Column) -> Column:
    """Topics for n documents: none below 5, else max(10, sqrt(n) / 3), n at most."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n < 5, 0).otherwise(F.least(n, F.greatest(F.lit(10), F.floor(F.sqrt(n) / 3)))).cast("int")


def nearest_means(chunks: DataFrame, by: str, k: Column, key: str = "id", vector: str = "embedding", rounds: int = 10) -> DataFrame:
    """(by, id, topic_id) by k-means in each collection; `k` is an expression over a collection's number of rows `n`, none for 0.

    It begins with the k rows of the smallest hashes. Rows meet their collection's means in blocks, and a block sends each mean's sum and
    count. Sums are whole numbers of 2**-32, so that they are the same in any order and partitioning. A mean without rows stays.
    """
    points = density.points(chunks, by, key, vector)
    sizes = points.groupBy("by").agg(F.count("*").alias("n")).select("by", k.alias("k")).filter("k > 0")
    points = lineage.cut(density.join_safe(points, sizes, "by"))
    first = points.withColumn("topic", F.row_number().over(Window.partitionBy("by").orderBy(F.xxhash64("id"), "id")) - 1).filter(F.col("topic") < F.col("k"))
    unit = F.transform("v", lambda x: x.cast("double") / F.when(V.norm("v") > 0, V.norm("v")).otherwise(1.0))
    means = lineage.cut(first.select("by", "topic", unit.alias("m")))
    blocks = points.select("by", "block").distinct()
    sums = T.StructType([points.schema["by"], T.StructField("topic", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("s", T.ArrayType(T.LongType()))])
    owned = T.StructType([points.schema["by"], points.schema["id"], T.StructField("topic", T.IntegerType())])

    def nearest(rows: pa.Table, there: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        there = there.sort_by("topic")
        vectors = density.matrix_of(rows["v"])
        centers = there["m"].combine_chunks().flatten().to_numpy().reshape(there.num_rows, -1)
        return vectors, there["topic"].to_numpy()[np.round(density.squares(vectors, centers), 9).argmin(axis=1)]

    def summed(rows: pa.Table, there: pa.Table) -> pa.Table:
        vectors, own = nearest(rows, there)
        names = np.unique(own)
        whole = np.rint(vectors * 2**32).astype(np.int64)
        parts = [whole[own == t].sum(axis=0) for t in names]
        return pa.table([pa.array([rows["by"][0].as_py()] * len(names), rows["by"].type), pa.array(names, pa.int32()), pa.array(np.bincount(own)[names], pa.int64()), pa.array([p.tolist() for p in parts], pa.list_(pa.int64()))], ["by", "topic", "n", "s"])

    def assigned(rows: pa.Table, there: pa.Table) -> pa.Table:
        return pa.table([rows["by"], rows["id"], pa.array(nearest(rows, there)[1], pa.int32())], ["by", "id", "topic"])

    def meet(f, schema: T.StructType) -> DataFrame:
        spread = density.join_safe(blocks, means, "by")
        return points.select(*(F.col(c).alias(c) for c in ("by", "id", "v", "block"))).groupBy("by", "block").cogroup(spread.groupBy("by", "block")).applyInArrow(f, schema)

    for _ in range(rounds):
        placed = meet(summed, sums).select("by", "topic", "n", F.posexplode("s").alias("at", "x")).groupBy("by", "topic", "at").agg((F.sum("x") / F.lit(2.0**32) / F.sum("n")).alias("x"))
        moved = placed.groupBy("by", "topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("new"))
        means = lineage.cut(density.join_safe(means, moved, "by", "topic", how="left").select("by", "topic", F.coalesce("new", "m").alias("m")))
    return meet(assigned, owned).select(F.col("by").alias(by), F.col("id").alias(key), F.col("topic").alias("topic_id"))


def discover(chunks: DataFrame, by: str, key: str = "id", vector: str = "embedding", dense: int = DENSE) -> DataFrame:
    """(by, id, topic_id): topics of each collection, by density up to `dense` rows (density.topics; -1 is noise), by k-means beyond; fewer than 5 rows are noise."""
    sizes = chunks.filter(F.col(vector).isNotNull()).groupBy(F.col(by).alias("__by")).agg(F.count("*").alias("__n"))
    sized = chunks.filter(F.col(vector).isNotNull()).join(sizes, F.col(by).eqNullSafe(F.col("__by")))
    small = density.topics(sized.filter((F.col("__n") <= dense) | (F.col("__n") < 5)), by, key, vector)
    large = sized.filter((F.col("__n") > dense) & (F.col("__n") >= 5))
    return small if large.isEmpty() else small.unionByName(nearest_means(large, by, cluster_count(F.col("n")), key, vector))


def match_topics(old: DataFrame, new: DataFrame, least: float = 0.8) -> DataFrame:
    """(old_id, new_id, similarity): one-to-one, mutual best first. (topic_id, embedding) tables of topics.

    Each round keeps the pairs that are the best of both their topics, which is what a greedy pass by falling similarity
    does, and goes on with the rest; pairs of equal similarity go by the smaller ids.
    """
    near = search.distances(old, new, None, query_key="topic_id", key="topic_id", most=1 - least)
    left = lineage.cut(near.select(F.col("query_id").alias("old_id"), F.col("id").alias("new_id"), F.round(1 - F.col("distance"), 12).alias("similarity")))
    order = F.struct((-F.col("similarity")).alias("s"), "old_id", "new_id")
    out = left.limit(0)
    while not left.isEmpty():
        best = left.groupBy("old_id").agg(F.min(order).alias("o")).select("o.old_id", "o.new_id").join(left.groupBy("new_id").agg(F.min(order).alias("o")).select("o.old_id", "o.new_id"), ["old_id", "new_id"])
        best = lineage.cut(left.join(best, ["old_id", "new_id"]).select("old_id", "new_id", "similarity"))
        out = out.unionByName(best)
        left = lineage.cut(left.join(best.select("old_id"), "old_id", "left_anti").join(best.select("new_id"), "new_id", "left_anti"))
    return out


def merge_labels(old: DataFrame, new: DataFrame, least: float = 0.8) -> DataFrame:
    """(topic_id, label, review_status, old_id) for each new topic: label and status of the old topic that it matches, nulls and
    `pending` where it matches none. old: (topic_id, label, review_status, embedding), new: (topic_id, embedding)."""
    matched = match_topics(old, new, least).select(F.col("new_id").alias("topic_id"), "old_id")
    facts = old.select(F.col("topic_id").alias("old_id"), "label", "review_status")
    out = new.select("topic_id").join(matched.join(facts, "old_id"), "topic_id", "left")
    return out.select("topic_id", "label", F.coalesce("review_status", F.lit("pending")).alias("review_status"), "old_id")


def split_topic(assigned: DataFrame, topic_id: int, k: int) -> DataFrame:
    """(id, topic_id, child) of the chunks of one topic, in k parts by k-means. assigned: (id, topic_id, embedding)."""
    inside = assigned.filter(F.col("topic_id") == topic_id).select("id", "embedding", F.lit(topic_id).alias("__parent"))
    parts = nearest_means(inside, "__parent", F.least(F.lit(k), F.col("n")).cast("int"))
    return parts.select("id", F.lit(topic_id).alias("topic_id"), F.col("topic_id").alias("child"))


def child_labels(split: DataFrame, texts: DataFrame) -> DataFrame:
    """(child, docs, label) of the parts that split_topic gives, by the terms of their texts (id, text)."""
    docs = split.select("id", "child").join(texts.select("id", "text"), "id")
    sizes = docs.groupBy("child").agg(F.count("*").alias("docs"))
    return sizes.join(labels(topic_terms(docs, "id", "child", "text"), "child"), "child", "left")


def carry_over(manual: DataFrame, old: DataFrame, new: DataFrame, chunks: DataFrame, least: float = 0.8, near: float = 0.5) -> DataFrame:
    """(id, topic_id, route) of hand-made assignments (id, topic_id) to old topics.

    They go to the new topic that the old one matches (`matched`); else the chunk itself goes to its nearest new topic if
    that is more than `near` alike (`nearest`); the others are lost.
    """
    matched = match_topics(old, new, least).select(F.col("old_id").alias("topic_id"), "new_id")
    placed = lineage.cut(manual.join(matched, "topic_id", "left").select("id", "new_id"))
    open_ = chunks.join(placed.filter("new_id IS NULL").select("id"), "id", "left_semi")
    close = assign_nearest(open_, new).filter(F.col("similarity") > near).select("id", "topic_id", F.lit("nearest").alias("route"))
    return placed.filter("new_id IS NOT NULL").select("id", F.col("new_id").alias("topic_id"), F.lit("matched").alias("route")).unionByName(close)
