"""A pipeline over the ``documents`` table: quality rules, exact dedup, near-duplicate join, source mixing, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame.  ``run`` writes each stage's result as Parquet in the
shared checkpoint folder and reads it again as the next one's documents.  All
stages but the last return the columns of ``documents``.

Mixing repeats sources up to two passes (the largest source passes once), so a
document may come out of it twice; packing then places both copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ascribe.llm import exact, mixing, ngram_join, packing, quality
from ascribe.session import materialize

# operator 9 as dealt: 3-word shingles, similarity 0.9; near duplicates of the pipeline take five words and 0.8
NEAR_WORDS = 5
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality and base limits pass."""
    return quality.keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact.keep_largest(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document with the smallest id."""
    return ngram_join.keep_one(docs, k=NEAR_WORDS, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks, each at least once."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 4096 tokens."""
    return packing.pack(docs)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("ngram_jaccard_join", near_dedup),
          ("source_mixing", mix_sources), ("packing", pack)]

# expectation-maximisation and tokenizing have no SQL; tests/llm holds run() against a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
