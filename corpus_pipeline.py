"""From documents to packed training sequences: quality rules, exact dedup, near duplicates, packing.

Each stage takes what its predecessor kept, written as Parquet and read again. All but the last return the columns of
documents. What a stage writes for itself is dropped when its result is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanwise.llm import exact_dedup, ngram_join, packing, quality
from gleanwise.llm.common import fresh_path, table, tokenizer_path
from gleanwise.sources.shared import scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule or are likelier junk than good go."""
    return quality.keep_good(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at 0.8 or more the smallest doc_id stays."""
    return ngram_join.one_of_each(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of what is left, in windows of 4096."""
    return packing.packed(docs, tokenizer_path())


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", drop_exact_copies),
    ("near duplicates", drop_near_copies),
    ("packing", pack_sequences),
]

#: Tokenization and MinHash are not SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
