"""Deterministic forms of the analysis steps: extract, rank, compare, summarise, generate, check and verify, without a language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def extract(items: DataFrame, body: str, fields: dict[str, str]) -> DataFrame:
    """items with a column for each field: the first group of its pattern in the text, null where there is none."""
    found = {name: F.regexp_extract(F.coalesce(body, F.lit("")), pattern, 1) for name, pattern in fields.items()}
    return items.withColumns({name: F.when(c != "", c) for name, c in found.items()})


def rank(items: DataFrame, body: str, criterion: str, key: str) -> DataFrame:
    """items with a score, the share of the criterion's words they have, best first; ties by key."""
    wanted = F.array(*map(F.lit, dict.fromkeys(w for w in criterion.lower().split() if w not in X.STOPWORDS))) if criterion.split() else F.array().cast("array<string>")
    return items.withColumn("score", X.overlap_share(wanted, X.tokens(F.col(body)))).orderBy(F.desc("score"), key)


def compare(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, side): what stands in one table alone, or in both with another value."""
    x, y = a.select(key, F.col(value).alias("va"), F.lit(True).alias("ia")), b.select(key, F.col(value).alias("vb"), F.lit(True).alias("ib"))
    side = F.when(F.col("ib").isNull(), "a").when(F.col("ia").isNull(), "b").otherwise("changed")
    return x.join(y, key, "full").filter(F.col("ia").isNull() | F.col("ib").isNull() | ~F.col("va").eqNullSafe(F.col("vb"))).select(key, side.alias("side"))


def summary(body: Column, first: int = 3) -> Column:
    return F.array_join(F.slice(X.sentences(body), 1, first), " ")


def filled(template: str, **columns: Column) -> Column:
    """The template with each {name} replaced by its column; nulls are empty."""
    out = F.lit(template)
    for name, column in columns.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(column.cast("string"), F.lit("")))
    return out


def agree(items: DataFrame, group: str, value: str) -> DataFrame:
    """(group, ok, evidence): whether all items of a group have one value, and the values found."""
    found = items.groupBy(group, value).agg(F.count("*").alias("n"))
    return found.groupBy(group).agg((F.count("*") <= 1).alias("ok"), F.array_sort(F.collect_list(F.col(value).cast("string"))).alias("evidence"))


def verified(claim: Column, evidence: Column, least: float = 0.8) -> Column:
    """Whether the evidence has most of the claim's content words."""
    words = X.content_words(claim)
    return (F.size(words) > 0) & (X.overlap_share(words, X.tokens(evidence)) >= least)
