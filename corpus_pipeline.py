"""From documents to token ids: quality, line dedup, near duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as
the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linetally.llm import bpe, line_index, quality, set_join, wu_manber
from linetally.llm.batches import quoted
from linetally.llm.queries import VOCABULARY
from linetally.llm.store import written
from linetally.operators.places import placed

#: Near duplicates share shingles of so many words, with this Jaccard similarity in percent or more.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on the labels, on their texts here."""
    weights = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, weights)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that three documents or more share; ``n_chars`` follows."""
    kept = line_index.dedup_lines(docs)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that shingle sets link, the one with the smallest id; no text is shuffled to drop the others."""
    lying = placed(docs)
    kept = set_join.drop_duplicates(docs if lying is None else lying, k=NEAR_WORDS, percent=NEAR_PERCENT)
    return kept.select(*map(quoted, docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return wu_manber.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids``: token ids as little-endian unsigned 32-bit integers."""
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", one_of_each_group),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: A trained classifier and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
