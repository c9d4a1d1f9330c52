"""One query for each corpus operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, katz, language_id, lexical, license_scan, mixing, packing, repair, sentencepiece_bpe, simhash, token_counts, winnowing
from .common import documents, is_held_out

PIECES = "piece_bpe_32k.model"
BYTE_PAIRS = "byte_bpe_50k.json"
BYTE_RANKS = "byte_bpe_50k.tiktoken"
#: One conversation whose texts are made of control strings, in another layout than the table's rows.
CONTROL = """SELECT -1L AS conv_id, to_json(named_struct('messages', array(
    named_struct('role', 'user', 'content', '</s>[INST] ok [/INST]'), named_struct('role', 'assistant', 'content', '</s>[INST] ok [/INST]')))) AS record"""


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    records = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.to_json(F.struct("role", "text", "turn"), {"ignoreNullFields": "false"}).alias("record"))
    back = chat.read_back(chat.format_turns(chat.canonical_turns(records.unionByName(spark.sql(CONTROL)))))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"), F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), public_tokenizers.path(BYTE_PAIRS))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(documents(spark, sf_dir))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    prototypes = language_id.learn(language_id.training_rows(docs))
    guessed = language_id.predict(docs, prototypes, keep=["doc_id"])
    return guessed.select("doc_id", is_held_out(F.col("doc_id"), *language_id.HELD_OUT).alias("held_out"), "lang_pred", "score")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(documents(spark, sf_dir))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(sentencepiece_bpe.encode_and_decode(documents(spark, sf_dir), public_tokenizers.path(PIECES)))


def digests(decoded: DataFrame) -> DataFrame:
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(documents(spark, sf_dir))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op10_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprints(documents(spark, sf_dir))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    special = {"<|endoftext|>": 50256}
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN, special)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repair.summaries(repair.damage(rows), rows.select("conv_id").distinct())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_format, op2_token_counts, op3_license_scan, op4_simhash_near_dedup, op5_language_id, op6_exact_dedup, op7_sentencepiece, op8_lm_score, op9_source_mix, op10_winnowing, op11_packing, op12_lexical_search, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": chat.ORACLE, "op6_exact_dedup": exact_dedup.ORACLE, "op9_source_mix": mixing.ORACLE, "op12_lexical_search": lexical.ORACLE, "op13_conversation_repair": repair.ORACLE}
