"""The plan library as tables: matching stored plans to a question, pricing, choosing, promoting and retiring them.

A plan row is (id, query, description, embedding, tags, scope, verb, uses, successes, failures, created_at, last_used,
ttl_days, disabled_at). Plans are data here; running one is composing the operators of this library in PySpark.
"""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..operators import lineage, search

FLOOR, GROWN_FLOOR = 0.40, 0.55
SCOPE_BONUS = 0.15
BAND = 0.05
# Verbs that mean the same, and scopes that stand for none.
VERBS = (("query", "research", "lookup"), ("analyze", "review", "compare"))
NO_SCOPE = ("all",)
PROSE = "knowledge,docs,rdr,paper"
LEAST_USES, LEAST_SUCCESS, LEAST_WORDS = 3, 0.80, 20
#: So many failures without one success mean that a plan always fails.
MOST_FAILURES = 3


def always_fails() -> Column:
    return (F.coalesce("failures", F.lit(0)) >= MOST_FAILURES) & (F.coalesce("successes", F.lit(0)) == 0)


def usable(plans: DataFrame, now: dt.datetime) -> DataFrame:
    """Not disabled, not always failing, and within a time to live that counts from the last use (no time to live: for good)."""
    since = F.timestamp_diff("SECOND", F.greatest("created_at", "last_used"), F.lit(now)) / 86400
    in_time = F.col("ttl_days").isNull() | (since <= F.col("ttl_days"))
    return plans.filter(F.col("disabled_at").isNull() & ~always_fails() & in_time)


def verb_class(verb: Column) -> Column:
    """The same value for verbs that mean the same; other verbs are their own class."""
    out = verb
    for verbs in VERBS:
        out = F.when(verb.isin(*verbs), F.lit(verbs[0])).otherwise(out)
    return out


def scope_fit(tags: Column, scope: str | None) -> Column:
    """1: a tag begins the asked scope, or the asked scope is a family (it ends in `__`) and begins a tag; 0: no scope asked or no tags; null: none fits. Case doesn't count."""
    if not scope:
        return F.lit(0.0)
    low = scope.lower()
    fits = F.exists(tags, lambda t: F.startswith(F.lit(low), F.lower(t)) | (F.startswith(F.lower(t), F.lit(low)) if low.endswith("__") else F.lit(False)))
    return F.when(F.size(tags) == 0, F.lit(0.0)).when(fits, F.lit(1.0))


def candidates(plans: DataFrame, dimensions: dict[str, str] | None, scope: str | None) -> DataFrame:
    """Plans that may be offered, with `fit`: not always failing, with all asked dimensions (map `dimensions`; the verb by its
    class), in the asked scope; a grown plan without scope tags and project is offered to callers without a scope only."""
    out = plans.filter(~always_fails()).withColumn("fit", scope_fit(X.tag_list(F.col("scope_tags")), scope)).filter("fit IS NOT NULL")
    for name, value in (dimensions or {}).items():
        have = F.col("dimensions")[name]
        out = out.filter(verb_class(have) == verb_class(F.lit(value)) if name == "verb" else have == F.lit(value))
    if scope and scope.lower() not in NO_SCOPE:
        out = out.filter(~(F.col("grown") & (F.size(X.tag_list(F.col("scope_tags"))) == 0) & (F.coalesce("project", F.lit("")) == "")))
    return out


def match(asked: DataFrame, plans: DataFrame, scope: str | None = None, k: int = 5, dimensions: dict[str, str] | None = None, floor: float = FLOOR) -> DataFrame:
    """(query_id, id, confidence, score, rank) of plans for each asked question (query_id, text, embedding).

    Confidence is max(0, 1 - distance), or 1 for the same question word for word; plans that use made must reach the
    higher floor. The score adds 15 % for a plan of the asked scope and decides the order; ties go to plans with fewer scope
    tags, then to the smaller id. Only pairs within the floor leave the vector search; equal questions are joined.
    """
    usable_ = candidates(plans, dimensions, scope).select("id", "embedding", X.squeezed(F.col("query")).alias("q"), F.size(X.tag_list(F.col("scope_tags"))).alias("tags"), "fit", "grown")
    near = search.distances(asked, usable_, None, query_key="query_id", most=1 - floor).select("query_id", "id", F.greatest(F.lit(0.0), 1 - F.round("distance", 12)).alias("confidence"))
    same = asked.select("query_id", X.squeezed(F.col("text")).alias("q")).join(usable_.select("id", "q"), "q").select("query_id", "id", F.lit(1.0).alias("confidence"))
    best = near.unionByName(same).groupBy("query_id", "id").agg(F.max("confidence").alias("confidence"))
    kept = best.join(usable_.select("id", "tags", "fit", "grown"), "id").filter(F.col("confidence") >= F.when(F.col("grown"), max(floor, GROWN_FLOOR)).otherwise(floor))
    kept = kept.withColumn("score", F.col("confidence") * (1 + SCOPE_BONUS * F.col("fit")))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "tags", "id")
    return kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("query_id", "id", "confidence", "score", "rank")


def match_text(asked: DataFrame, plans: DataFrame, scope: str | None = None, k: int = 5, dimensions: dict[str, str] | None = None) -> DataFrame:
    """The same columns, confidence and score null, for questions that no vector matched: plans whose question, description
    or tags hold all content words of the asked one; more of the plan's words asked for first, then the smaller id."""
    body = F.concat_ws(" ", "query", "description", "tags")
    words = candidates(plans, dimensions, scope).select("id", X.content_words(body, 1).alias("have"))
    wanted = asked.select("query_id", F.array_sort(X.content_words(F.col("text"), 1)).alias("want")).filter(F.size("want") > 0)
    # Questions of the same words, and plans of the same words, are one class each. A class of plans needs its k smallest ids only.
    classes = lineage.cut(words.select("id", F.array_sort("have").alias("have")).withColumn("nth", F.row_number().over(Window.partitionBy("have").orderBy("id"))).filter(F.col("nth") <= k).drop("nth"))
    sets = classes.groupBy("have").agg(F.min("id").alias("set"))
    each = sets.select("set", F.size("have").alias("size"), F.explode("have").alias("w"))
    counts = each.groupBy("w").agg(F.count("*").alias("df"))
    wants = lineage.cut(wanted.select("want").distinct())
    # A fitting plan has the rarest of the words too, so a common word brings nothing together but where all words are common.
    asks = wants.select("want", F.explode("want").alias("w")).join(counts, "w", "left")
    rare = asks.groupBy("want").agg(F.min_by("w", F.struct(F.coalesce("df", F.lit(0)).alias("df"), "w")).alias("w"))
    full = rare.join(each, "w").join(sets.select("set", "have"), "set").filter(F.size(F.array_except("want", "have")) == 0).select("want", "set", "size")
    best = full.join(classes.join(sets, "have").select("set", "id"), "set")
    order = Window.partitionBy("want").orderBy("size", "id")
    first = best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("want", "id", "rank")
    nothing = F.lit(None).cast("double")
    return wanted.join(first, "want").select("query_id", "id", nothing.alias("confidence"), nothing.alias("score"), "rank")


def match_or_text(asked: DataFrame, plans: DataFrame, scope: str | None = None, k: int = 5, dimensions: dict[str, str] | None = None) -> DataFrame:
    """`match`, and `match_text` for the questions that it finds nothing for."""
    near = lineage.cut(match(asked, plans, scope, k, dimensions))
    rest = asked.join(near.select("query_id").distinct(), "query_id", "left_anti")
    return near.unionByName(match_text(rest, plans, scope, k, dimensions))


def choose(matches: DataFrame, costs: DataFrame, band: float = BAND) -> DataFrame:
    """(query_id, id): the cheapest priced plan among the first matches whose confidence stays within `band` of the best match's, above or below.

    The first match outside ends the run for good, whatever follows. Plans without a price come last, ties go by rank, and a
    match without confidence stands alone. matches: (query_id, id, confidence, rank), costs: (id, cost).
    """
    order = Window.partitionBy("query_id").orderBy("rank")  # k rows
    away = F.coalesce(F.abs(F.first("confidence").over(order) - F.col("confidence")) > band + 1e-12, F.col("rank") > 1)
    inside = matches.withColumn("away", F.max(away).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).filter(~F.col("away"))
    return inside.join(costs, "id", "left").groupBy("query_id").agg(F.min_by("id", F.struct(F.col("cost").isNull(), F.coalesce("cost", F.lit(0.0)), "rank")).alias("id"))


def prices(history: DataFrame, fixed: DataFrame, least: int = 3) -> DataFrame:
    """(id, cost): the median of known run costs if there are enough, else the fixed price, else null."""
    known = history.filter(F.col("cost_usd").isNotNull()).groupBy("id").agg(F.count("*").alias("n"), F.expr("percentile(cost_usd, 0.5)").alias("median"))
    return fixed.join(known, "id", "left").select("id", F.when(F.col("n") >= least, F.col("median")).otherwise(F.col("price")).alias("cost"))


def obstacles(uses: Column, successes: Column, description: Column) -> Column:
    """All reasons why a plan may not be promoted; none: it may."""
    rate = F.when(uses > 0, successes / uses).otherwise(0.0)
    return F.array_compact(F.array(F.when(uses < LEAST_USES, F.lit("too few uses")), F.when(rate < LEAST_SUCCESS, F.lit("too few successes")), F.when(F.length(F.trim(F.coalesce(description, F.lit("")))) < LEAST_WORDS, F.lit("description too short"))))


def identity(dimensions: dict[str, str]) -> str:
    """What makes two plans the same: sorted, lower-cased dimensions."""
    return json.dumps({k.lower(): str(v).lower() for k, v in sorted(dimensions.items())}, sort_keys=True)


def check_template(template: dict) -> None:
    """Raise ValueError for a template without description, verb, scope or steps, or with a walk that names its links in no or two ways."""
    dimensions = template.get("dimensions") or {}
    steps = (template.get("plan_json") or {}).get("steps") or []
    if not template.get("description") or not dimensions.get("verb") or not dimensions.get("scope") or not steps:
        raise ValueError("a template needs description, dimensions verb and scope, and steps")
    for step in steps:
        if not step.get("tool"):
            raise ValueError("a step needs a tool")
        if step["tool"] == "traverse" and len({"link_types", "purpose"} & set(step.get("args") or {})) != 1:
            raise ValueError("traverse takes link_types or purpose")


#: Dimensions that a template may have by default.
DIMENSIONS = ("verb", "scope", "domain", "strategy", "object", "topic")
STEP = "array<struct<tool:string,args:map<string,string>>>"


def dimension_key(dimensions: Column) -> Column:
    """`identity` of a map column: its entries lower-cased, in the order of their keys."""
    pairs = F.transform(F.map_entries(dimensions), lambda e: F.struct(F.lower(e["key"]).alias("k"), F.lower(e["value"]).alias("v")))
    return F.to_json(F.map_from_entries(F.array_sort(pairs)))


def template_faults(templates: DataFrame, known: tuple[str, ...] = DIMENSIONS, strict: bool = False) -> DataFrame:
    """Templates (id, description, dimensions map, steps STEP) with `faults`, sorted, and `warnings`: dimensions that aren't known, which `strict` makes faults.

    A template needs a description, the dimensions verb and scope, and steps, each with a tool; a walk (`traverse`) names its links in
    exactly one way, `link_types` or `purpose`. Of templates with the same dimensions, whatever their case, all but the one with the smallest id are `duplicate`.
    """
    dimensions = F.coalesce("dimensions", F.create_map().cast("map<string,string>"))
    lower = F.transform_keys(dimensions, lambda k, v: F.lower(k))
    steps = F.coalesce("steps", F.array().cast(STEP))
    ways = lambda s: F.size(F.array_intersect(F.map_keys(F.coalesce(s["args"], F.create_map().cast("map<string,string>"))), F.array(F.lit("link_types"), F.lit("purpose"))))
    lacks = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    unknown = F.array_sort(F.transform(F.filter(F.map_keys(lower), lambda k: ~k.isin(*known)), lambda k: F.concat(F.lit("unknown dimension "), k)))
    first = F.min("id").over(Window.partitionBy(dimension_key(dimensions)))
    faults = F.array(
        F.when(lacks(F.col("description")), "no description"), F.when(lacks(lower["verb"]), "no verb"), F.when(lacks(lower["scope"]), "no scope"), F.when(F.size(steps) == 0, "no steps"),
        F.when(F.exists(steps, lambda s: lacks(s["tool"])), "step without tool"), F.when(F.exists(steps, lambda s: (s["tool"] == "traverse") & (ways(s) != 1)), "traverse takes link_types or purpose"),
        F.when(F.col("id") != first, "duplicate"),
    )
    found = F.array_compact(faults)
    return templates.withColumn("faults", F.array_sort(F.concat(found, unknown) if strict else found)).withColumn("warnings", unknown)


def save(plans: DataFrame, templates: DataFrame, known: tuple[str, ...] = DIMENSIONS, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """The plans with the templates that may be saved, and the others with their faults; dimensions that a plan has already are a `duplicate`.

    Saved templates have the plans' columns that they lack as nulls.
    """
    judged = template_faults(templates, known, strict)
    taken = plans.select(dimension_key(F.col("dimensions")).alias("__key"), F.lit(True).alias("__taken")).distinct()
    met = judged.withColumn("__key", dimension_key(F.coalesce("dimensions", F.create_map().cast("map<string,string>")))).join(taken, "__key", "left")
    faults = F.when(F.col("__taken"), F.array_sort(F.array_union("faults", F.array(F.lit("duplicate"))))).otherwise(F.col("faults"))
    met = met.withColumn("faults", faults).drop("__key", "__taken")
    good = met.filter(F.size("faults") == 0).drop("faults", "warnings")
    return plans.unionByName(good, allowMissingColumns=True), met.filter(F.size("faults") > 0)


def routed(steps: DataFrame) -> DataFrame:
    """Steps (tool, domain, topic, mode, corpus, collection, threshold) with the corpus, topic and threshold that their scope and mode ask for.

    A domain gives the corpus unless a corpus or collection is pinned; `broad` gives the threshold 2.0 unless one is set.
    Steps that walk links take neither.
    """
    walks = F.col("tool") == "traverse"
    domain = F.when(F.col("domain") == "prose", PROSE).when(F.col("domain") == "code", "code")
    corpus = F.when(~walks & F.col("corpus").isNull() & F.col("collection").isNull(), domain).otherwise(F.col("corpus"))
    threshold = F.when(~walks & F.col("threshold").isNull() & (F.col("mode") == "broad"), F.lit(2.0)).otherwise(F.col("threshold"))
    return steps.withColumn("corpus", corpus).withColumn("threshold", threshold).withColumn("topic", F.when(~walks, F.col("topic")))
