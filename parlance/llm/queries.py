"""The registered queries: each operator on its whole table, in production settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import (
    chat,
    embedding_dedup,
    lexical_search,
    minhash,
    mixing,
    packing,
    quality,
    repair,
    sentencepiece_codec,
    suffix_dedup,
    token_counts,
    warc,
    windows,
)
from parlance.llm.oracle import ORACLE  # noqa: F401
from parlance.llm.store import temporary_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.dedup_suffixes(_table(spark, sf_dir, "documents")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op3_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_texts(_table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op5_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_tool_calls(*chat.calls_of_turns(_table(spark, sf_dir, "conversations")))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = temporary_path(spark, "warc")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.resolved(warc.read_archives(spark, path))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.digest(windows.dedup_windows(_table(spark, sf_dir, "documents")))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(repair.damage(_table(spark, sf_dir, "conversations")), copies_col="copies")


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack_documents(_table(spark, sf_dir, "documents"), carry=False))


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_sentencepiece_dropout": op3_sentencepiece_dropout,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_tool_call_linking": op5_tool_call_linking,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_warc_revisits": op8_warc_revisits,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_mix_sources": op10_mix_sources,
    "op11_lexical_search": op11_lexical_search,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_packing": op13_packing,
}

