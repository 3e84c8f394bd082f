"""From raw documents to packed sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents, extra columns included.
Null texts are kept by the filters of stages as empty texts are, and are packed as empty; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import common, linededup, packing, pii, quality, simhash


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade is under ``quality.KEEP`` go."""
    model = quality.train(docs, quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return quality.selected(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on many sources are taken out of the texts."""
    return linededup.without_boilerplate(docs, count=None)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with shingles of five words alike by 0.8 or more, the one with the smallest id stays."""
    return simhash.one_of_each(docs, words=5, similarity=0.8)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to the name of its kind."""
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 1024 tokens."""
    return packing.packed(docs)


STAGES = [("quality_classifier", quality_filter), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup), ("pii", redact), ("packing", pack)]
#: SQL cannot express the classifier, the fingerprints or the tokens; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
