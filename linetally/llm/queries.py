"""One query for each operator, with production parameters, over the whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from linetally.llm import bpe, chat, collocations, divergence, filter_audit, licences, line_index, quality, set_join, substring_dedup, token_files, toxicity, wu_manber

VOCABULARY = "word_bpe_49k.json"
END_OF_DOCUMENT = 49407
#: A conversation that spells out what templates write.
PROBE_CONVERSATION, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)).withColumnRenamed("id", "doc_id")


def op2_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return divergence.judge(docs, divergence.references(docs)).withColumnRenamed("id", "doc_id")


def op3_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.components(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op4_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wu_manber.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens`` of every document, counted in flat files made of the documents."""
    return token_files.document_token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), END_OF_DOCUMENT).withColumnRenamed("id", "doc_id")


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return licences.scan(docs, licences.rarity(docs)).withColumnRenamed("id", "doc_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op9_line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_index.line_digests(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(PROBE_CONVERSATION, i, role, PROBE_TEXT) for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").selectExpr("cast(conv_id as long) as conv_id", "cast(turn as long) as turn", "role", "text").unionByName(probe)
    return chat.read_back(chat.format_conversations(turns))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digests(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe,
        op2_divergence,
        op3_set_join,
        op4_wu_manber,
        op5_token_counts,
        op6_licences,
        op7_toxicity,
        op8_quality,
        op9_line_index,
        op10_chat,
        op11_substring_dedup,
        op12_collocations,
        op13_filter_audit,
    )
}
