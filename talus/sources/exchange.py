"""Exporting and importing collections as Parquet, with path filters and path remapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X


def chosen(path: Column, include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Column:
    """Some include glob (if there are any) and no exclude glob matches; rows without a path pass."""
    inside, outside = F.lit(not include), F.lit(False)
    for g in include:
        inside = inside | path.rlike(X.glob_pattern(g))
    for g in exclude:
        outside = outside | path.rlike(X.glob_pattern(g))
    return path.isNull() | (inside & ~outside)


def remapped(path: Column, prefixes: tuple[tuple[str, str], ...]) -> Column:
    """The first prefix that fits is replaced."""
    out = path
    for old, new in reversed(prefixes):
        out = F.when(F.startswith(path, F.lit(old)), F.concat(F.lit(new), F.substr(path, F.lit(len(old) + 1)))).otherwise(out)
    return out


def export_collection(rows: DataFrame, path: str, model: str, dimensions: int) -> None:
    """Rows with their embedding model and dimension, in the files' own columns."""
    rows.withColumn("__model", F.lit(model)).withColumn("__dimensions", F.lit(dimensions)).write.mode("errorifexists").parquet(path)


def import_collection(spark: SparkSession, path: str, model: str, dimensions: int) -> DataFrame:
    """The rows; a different model or dimension is an error."""
    rows = spark.read.parquet(path)
    found = rows.select("__model", "__dimensions").distinct().limit(2).collect()
    if any((r[0], r[1]) != (model, dimensions) for r in found):
        raise ValueError(f"the export holds {[tuple(r) for r in found]}, not {(model, dimensions)}")
    return rows.drop("__model", "__dimensions")
