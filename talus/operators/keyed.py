"""Keyed tables as folders of key buckets: merges that rewrite only the buckets they touch, and do no harm when they are repeated.

A row is in the bucket of its keys' hash, and has a mark that says whether its key is gone, so that no bucket is ever empty. A merge reads the
buckets of its keys, keeps for each key the row with the largest order, and puts those folders in place of the old ones (dynamic partition
overwrite). The number of buckets stands beside the table. A merge may have a number; a number that was merged already is passed over.
One merge at a time may write to a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lineage

BUCKET, GONE = "bucket", "gone"


def _bucketed(rows: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


def _last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, GONE)).alias("__l")).select(*keys, "__l.*")


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def create(rows: DataFrame, path: str, keys: list[str], order: str, buckets: int = 64) -> None:
    """Write a table of the last row of each key; without a column `gone`, every key is there."""
    marked = rows if GONE in rows.columns else rows.withColumn(GONE, F.lit(False))
    _bucketed(_last(marked, keys, order), keys, buckets).repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(path)
    at, files = _file(rows.sparkSession, f"{path}/_buckets-{buckets}")
    files.create(at, True).close()


def _buckets(spark: SparkSession, path: str) -> int:
    at, files = _file(spark, path)
    (found,) = [s.getPath().getName() for s in files.listStatus(at) if s.getPath().getName().startswith("_buckets-")]
    return int(found.rpartition("-")[2])


def merge(changes: DataFrame, path: str, keys: list[str], order: str, number: int | None = None) -> list[int]:
    """Fold rows into the table; a row with `gone` true takes its key away. Gives the buckets that were rewritten.

    Of a key's rows in the table and among the changes, the one with the largest order counts (of equal ones a row that is gone), so rows that
    come late or twice change nothing. Columns that the changes lack are null.
    """
    spark = changes.sparkSession
    done, files = _file(spark, f"{path}/_merged/{number}")
    if number is not None and files.exists(done):
        return []
    marked = changes if GONE in changes.columns else changes.withColumn(GONE, F.lit(False))
    new = lineage.cut(_bucketed(_last(marked.withColumn(GONE, F.coalesce(GONE, F.lit(False))), keys, order), keys, _buckets(spark, path)))
    touched = sorted(r[0] for r in new.select(BUCKET).distinct().collect())  # no more than there are buckets
    if touched:
        old = spark.read.parquet(path).filter(F.col(BUCKET).isin(touched))
        both = _last(old.unionByName(new, allowMissingColumns=True), [*keys, BUCKET], order)
        kept = lineage.cut(both.select(*old.columns))  # the folders that it is read from are about to go
        kept.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    if number is not None:
        files.create(done, True).close()
    return touched


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows whose keys are there."""
    return spark.read.parquet(path).filter(~F.col(GONE)).drop(BUCKET, GONE)
