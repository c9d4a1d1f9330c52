"""A corpus pipeline: language ID, exact dedup, near dedup, source mixing, SentencePiece encoding and decoding.

Stages work on tables of documents (doc_id, text, lang, source and any other columns) and return the same columns; the last
one returns digests. Defined results, for all stages: nulls in any column, empty and very long texts, repeated rows and
extra columns of any name are rows and columns like any other, as each operator's docstring states; an empty table gives an
empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from talus.llm import exact_dedup, language_id, mixing, sentencepiece_bpe, simhash
from talus.llm.common import documents, ensure_checkpoint_dir
from talus.llm.queries import PIECES, digests

#: Rows in an Arrow batch, in all stages: what a task and its Python worker hold of whole texts at once.
BATCH_ROWS = 1000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """A stage's result is lazy, so the setting stays; `run` gives the session its own back."""
    spark.conf.set(BATCH, BATCH_ROWS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language stay, with all their columns.

    A document goes if its text is null or has no letter, or if its score is below half of the smallest one that a rightly
    predicted training text of its length has. Ties of scores go to the language that sorts first; rows that repeat stay or
    go together. Where no training row has a language, only letterless texts go.
    """
    _small_batches(spark)
    known = language_id.training_rows(docs)
    prototypes = language_id.learn(known)
    return language_id.accepted(docs, prototypes, language_id.least_scores(known, prototypes) if prototypes else None)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null: empty), the row with the largest doc_id stays; of rows that repeat both, one. A null doc_id ranks last."""
    _small_batches(spark)
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id stays; rows that repeat it go together. Null doc_ids rank last."""
    _small_batches(spark)
    return simhash.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's budget takes it; the row on the cut comes whole; texts without words go. A null source is one of its own."""
    _small_batches(spark)
    return mixing.mixture(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each row's ids and of the text they decode to, a row for each row; a null text is empty."""
    _small_batches(spark)
    return digests(sentencepiece_bpe.encode_and_decode(docs, public_tokenizers.path(PIECES)))


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: SQL can express neither the language profiles nor the merges of a byte-pair model; tests hold the stages against brute force.
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written to the shared folder and read again, and goes when the next one is written."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before, batch = documents(spark, sf_dir), None, spark.conf.get(BATCH)
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if before is not None:
                _remove(spark, before)
            before = f"{folder}/{name}"
    finally:
        spark.conf.set(BATCH, batch)
    return docs
