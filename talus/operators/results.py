"""Grouping the hits of a search for display: clusters of near vectors, or topics where enough hits have one."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hits of one search that are clustered together; more is an error, since one task holds them.
MOST_HITS = 1000


def ward(vectors: np.ndarray, k: int) -> np.ndarray:
    """Labels from 0 of k clusters: the two clusters whose union adds least to the squared error merge, again and again."""
    n = len(vectors)
    labels, size = np.arange(n), np.ones(n)
    cost = ((vectors[:, None, :] - vectors[None, :, :]) ** 2).sum(axis=2) / 2
    np.fill_diagonal(cost, np.inf)
    for _ in range(n - k):
        a, b = sorted(divmod(int(cost.argmin()), n))
        total = size[a] + size[b] + size
        merged = ((size[a] + size) * cost[a] + (size[b] + size) * cost[b] - size * cost[a, b]) / total
        live = np.isfinite(cost[a]) | np.isfinite(cost[b])
        cost[a] = cost[:, a] = np.where(live, merged, np.inf)
        cost[b] = cost[:, b] = np.inf
        cost[a, a] = np.inf
        size[a] += size[b]
        labels[labels == b] = a
    return np.unique(labels, return_inverse=True)[1]


def cluster_results(hits: DataFrame, query: str = "query_id", key: str = "id", vector: str = "embedding", distance: str = "distance") -> DataFrame:
    """(query, id, distance, cluster, label): max(2, ceil(n / 5)) clusters of each search's hits, numbered by their nearest hit, whose
    key is the label; two hits or fewer stand alone. Ties go by key."""

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        n = len(rows)
        if n > MOST_HITS:
            raise ValueError(f"more than {MOST_HITS} hits in one search")
        rows = rows.sort_values([distance, key], kind="stable").reset_index(drop=True)
        labels = np.arange(n) if n <= 2 else ward(np.array(rows[vector].tolist(), np.float64), max(2, math.ceil(n / 5)))
        first = {}
        for label in labels:
            first.setdefault(label, len(first))
        rows["cluster"] = [first[x] for x in labels]
        rows["label"] = rows.groupby("cluster")[key].transform("first").astype(str)
        return rows[[query, key, distance, "cluster", "label"]]

    kind = lambda c: hits.schema[c].dataType.simpleString()
    return hits.select(query, key, vector, distance).groupBy(query).applyInPandas(group, f"{query} {kind(query)}, {key} {kind(key)}, {distance} double, cluster int, label string")


def topic_or_cluster(hits: DataFrame, query: str, topic: str, least: float = 0.5) -> DataFrame:
    """hits with by_topic: whether at least half of a search's hits have a topic, so that topics group them."""
    w = Window.partitionBy(query)
    return hits.withColumn("by_topic", F.count(topic).over(w) >= least * F.count(F.lit(1)).over(w))
