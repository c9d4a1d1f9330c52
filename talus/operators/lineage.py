"""Cutting lineage in the folder that all executors share, and spreading small tables."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a single machine without one takes a temporary folder, a cluster gets an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, name: str, source: str, build: Callable[[str], object]) -> str:
    """The folder of something derived from the files at `source`, which `build(folder)` writes the first time and whenever the files have changed.

    Files are told apart by their path, size, number and time. A folder counts once it is complete.
    """
    def at(path: str):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(spark._jsc.hadoopConfiguration())

    place, files = at(source)
    held, status = files.getContentSummary(place), files.getFileStatus(place)
    facts = f"{status.getPath()} {held.getLength()} {held.getFileCount()} {status.getModificationTime()}"
    folder = f"{shared_folder(spark)}/../{name}-{hashlib.sha256(facts.encode()).hexdigest()[:32]}"
    done, there = at(f"{folder}/_complete")
    if not there.exists(done):
        build(folder)
        there.create(done, True).close()
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from there, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a table that is dealt out if it lies in few files.
SMALL = 1_000_000


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small table out over all cores if it lies in fewer files than there are cores: a file of one row group is one task's work.

    Larger tables, and those in many files, stay as they are.
    """
    cores, files = df.sparkSession.sparkContext.defaultParallelism, len(df.inputFiles())
    return df.repartition(cores) if 0 < files < cores and df.count() <= SMALL else df
