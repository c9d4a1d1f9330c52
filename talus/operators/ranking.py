"""The ranking steps after retrieval, each from a table of hits to a table of hits.

Hits may be all chunks of a corpus. Ranges and counts of a query or a collection are aggregates, combined in the map tasks;
what ranks keeps each group's first n before anything is shuffled.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..functions import vectors as V

# Distance limits, over-fetch factors and link weights by kind.
LIMITS = {"code": 0.45, "knowledge": 0.65, "docs": 0.65, "rdr": 0.65}
DEFAULT_LIMIT = 0.55
CONTRADICTION = 0.3
FETCH = {"knowledge": 4, "docs": 4, "rdr": 4}
LINK_WEIGHTS = {"implements": 1.0, "relates": 0.5, "cites": 0.5, "supersedes": 0.0}


def by_kind(kind: Column, values: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for name, value in values.items():
        out = F.when(kind == name, F.lit(value)).otherwise(out)
    return out


def overfetch(hits: DataFrame, n: int, collection: str = "collection", kind: str = "kind", distance: str = "distance", tie: str = "id") -> DataFrame:
    """The nearest max(5, n * factor) of every collection."""
    most = F.greatest(F.lit(5), n * by_kind(F.col(kind), FETCH, 2).cast("int"))
    order = Window.partitionBy(collection).orderBy(distance, tie)
    # The fixed limit lets each task drop what no kind fetches before the shuffle.
    first = hits.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= max(5, n * max(2, *FETCH.values())))
    return first.filter(F.col("__n") <= most).drop("__n")


def within_limit(kind: Column, distance: Column, override: float | None = None) -> Column:
    return distance <= (F.lit(override) if override is not None else by_kind(kind, LIMITS, DEFAULT_LIMIT))


def limit_report(hits: DataFrame, collection: str = "collection", kind: str = "kind", distance: str = "distance") -> DataFrame:
    """collection, raw, dropped, kept, limit_used, top_distance."""
    ok = within_limit(F.col(kind), F.col(distance))
    return hits.groupBy(collection).agg(F.count("*").alias("raw"), F.count_if(~ok).alias("dropped"), F.count_if(ok).alias("kept"), F.max(by_kind(F.col(kind), LIMITS, DEFAULT_LIMIT)).alias("limit_used"), F.min(distance).alias("top_distance"))


def normalized(value: Column, keys: list[str]) -> Column:
    """(v - min) / (max - min + 1e-9) over the hits of a query; 1 for a lone hit. A window: for result sets that are bounded."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(F.count(value).over(w) == 1, F.lit(1.0)).otherwise((value - low) / (high - low + 1e-9))


def with_normalized(hits: DataFrame, values: dict[str, Column], keys: list[str]) -> DataFrame:
    """`hits` with a column for each of `values` as normalized() has it, by aggregates, for any number of hits. Few keys: their ranges go to every task."""
    rows = hits.withColumns({f"__v_{out}": v for out, v in values.items()})
    sums = [f(f"__v_{out}").alias(f"__{name}_{out}") for out in values for name, f in (("low", F.min), ("high", F.max), ("n", F.count))]
    ranges = rows.groupBy(*(F.col(k).alias(f"__k_{k}") for k in keys)).agg(*sums)
    both = rows.join(F.broadcast(ranges), reduce(and_, (F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys)))
    out = {o: F.when(F.col(f"__n_{o}") == 1, F.lit(1.0)).otherwise((F.col(f"__v_{o}") - F.col(f"__low_{o}")) / (F.col(f"__high_{o}") - F.col(f"__low_{o}") + 1e-9)) for o in values}
    return both.withColumns(out).select(*dict.fromkeys([*hits.columns, *values]))


def hybrid_score(hits: DataFrame, keys: list[str], kind: str = "kind", distance: str = "distance", frecency: str = "frecency", cached: str = "cached", vector_weight: float = 0.7) -> DataFrame:
    """0.7 * nearness + 0.3 * frecency for code, nearness for the rest; hits from the line cache get 0.5 and stay out of the window."""
    both = with_normalized(hits, {"__far": F.when(~F.col(cached), F.col(distance)), "__used": F.when(~F.col(cached), F.col(frecency))}, keys)
    near = 1 - F.col("__far")
    score = F.when(F.col(cached), F.lit(0.5)).when(F.col(kind) == "code", vector_weight * near + (1 - vector_weight) * F.col("__used")).otherwise(near)
    return both.withColumn("score", score).drop("__far", "__used")


def link_boost(hits: DataFrame, links: DataFrame, key: str, weight: float = 0.15) -> DataFrame:
    """Adds min(1, sum of link weights) * 0.15 to the score. links: (key, link_type)."""
    sums = links.groupBy(key).agg(F.sum(by_kind(F.col("link_type"), LINK_WEIGHTS, 0.0)).alias("__w"))
    return hits.join(sums, key, "left").withColumn("score", F.col("score") + weight * F.least(F.lit(1.0), F.coalesce("__w", F.lit(0.0)))).drop("__w")


def topic_boost(hits: DataFrame, keys: list[str], topic: str, topic_links: DataFrame, distance: str = "distance") -> DataFrame:
    """Distance less 0.1 if another hit has the same topic, less 0.05 if some hit's topic is linked; not below 0. topic_links: (a, b)."""
    counts = hits.filter(F.col(topic).isNotNull()).groupBy(*keys, topic).agg(F.count("*").alias("__same"))
    both = topic_links.select("a", "b").union(topic_links.select("b", "a")).filter("a <> b").distinct()
    linked = counts.join(both, counts[topic] == both["a"]).select(*keys, F.col("b").alias(topic)).join(counts, [*keys, topic], "left_semi").distinct().withColumn("__linked", F.lit(True))
    out = hits.join(counts, [*keys, topic], "left").join(linked, [*keys, topic], "left")
    less = F.when(F.coalesce("__same", F.lit(0)) > 1, 0.1).otherwise(0.0) + F.when(F.coalesce("__linked", F.lit(False)), 0.05).otherwise(0.0)
    return out.withColumn(distance, F.greatest(F.lit(0.0), F.col(distance) - less)).drop("__same", "__linked")


def salience_boost(query: Column, salient: Column, weight: float = 0.025) -> Column:
    return weight * X.overlap_share(F.array_distinct(query), F.array_distinct(salient))


def contradictions(hits: DataFrame, query: str = "query_id", key: str = "id", collection: str = "collection", agent: str = "agent", vector: str = "embedding", least: float = CONTRADICTION) -> DataFrame:
    """`hits` with contradicted = true for both of two hits of one search, in the same collection, that different named agents
    wrote and whose distance is below `least`. Hits of a search are few; those of a collection meet each other."""
    side = lambda name: hits.filter(F.coalesce(agent, F.lit("")) != "").select(query, collection, F.col(key).alias(f"k{name}"), F.col(agent).alias(f"w{name}"), F.col(vector).alias(f"v{name}"))
    pairs = side("a").join(side("b"), [query, collection]).filter((F.col("ka") < F.col("kb")) & (F.col("wa") != F.col("wb")))
    near = pairs.filter(V.cosine_distance("va", "vb") < least)
    flagged = near.select(query, F.explode(F.array("ka", "kb")).alias(key)).distinct().withColumn("contradicted", F.lit(True))
    return hits.join(flagged, [query, key], "left").withColumn("contradicted", F.coalesce("contradicted", F.lit(False)))


def exact_boost(hits: DataFrame, exact: DataFrame, key: str, boost: float = 0.15) -> DataFrame:
    """Hits whose file a literal search found too gain 0.15, up to 1; files found only that way come once with 0.5 * 0.8."""
    found = exact.select(key).distinct().withColumn("__exact", F.lit(True))
    boosted = hits.join(found, key, "left").withColumn("score", F.when(F.col("__exact"), F.least(F.lit(1.0), F.col("score") + boost)).otherwise(F.col("score"))).drop("__exact")
    only = found.join(hits, key, "left_anti").select(key, F.lit(0.5 * 0.8).alias("score"))
    return boosted.select(key, "score").unionByName(only)


def rerank(hits: DataFrame, order: str, score: str, n: int) -> DataFrame:
    """Rows with a score by falling score, then the others in the order they had."""
    return hits.orderBy(F.col(score).isNull(), F.desc(score), order).limit(n)


def interleave(hits: DataFrame, group: str, order: list, first: str, n: int | None = None) -> DataFrame:
    """One hit of each group in turn; groups in the order in which they are first seen (`first`). With `n`, the first n of all."""
    ranked = hits.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    if n is not None:  # no group gives more than n of the first n
        ranked = ranked.filter(F.col("turn") <= n)
    seen = hits.groupBy(group).agg(F.min(first).alias("__seen"))
    out = ranked.join(seen, group).orderBy("turn", "__seen", group).drop("__seen")
    return out if n is None else out.limit(n)


def ndcg(graded: DataFrame, keys: list[str], rank: str, grade: str, k: int) -> DataFrame:
    """keys, ndcg: sum of (2^grade - 1) / log2(rank + 1) over the first k ranks, against the best order of the same grades."""
    gain = F.pow(F.lit(2.0), F.col(grade)) - 1
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(grade), rank))
    parts = graded.select(*keys, F.when(F.col(rank) <= k, gain / F.log2(F.col(rank) + 1)).otherwise(0.0).alias("have"), F.when(best <= k, gain / F.log2(best + 1)).otherwise(0.0).alias("want"))
    sums = parts.groupBy(*keys).agg(F.sum("have").alias("have"), F.sum("want").alias("want"))
    return sums.select(*keys, F.when(F.col("want") > 0, F.col("have") / F.col("want")).otherwise(0.0).alias("ndcg"))
