"""Vector expressions over ARRAY<FLOAT> or ARRAY<DOUBLE> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_column(a), _column(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(_column(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine, kept within 0 and 2; a zero vector is at distance 1 from everything."""
    length = norm(a) * norm(b)
    return F.when(length == 0, F.lit(1.0)).otherwise(F.least(F.lit(2.0), F.greatest(F.lit(0.0), 1 - dot(a, b) / length)))


def mean_vector(df, keys: list[str], vector: str, out: str = "centroid"):
    """The mean of `vector` by `keys`, added up place by place so that partial sums stay small."""
    placed = df.select(*keys, F.posexplode(vector).alias("at", "x"))
    means = placed.groupBy(*keys, "at").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias(out))
