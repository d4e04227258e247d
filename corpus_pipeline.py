"""The corpus pipeline: documents in, packed sequences out.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents;
the last returns the packed pieces. Scratch tables of a stage go once its result is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from bagforge.llm.common import drop_scratch, read, shared_dir
from bagforge.llm.decontaminate import without_leaks
from bagforge.llm.packing import pack, vocabulary_path
from bagforge.llm.pii import redact
from bagforge.llm.simhash import without_near_duplicates
from bagforge.llm.toxicity import without_toxic
from bagforge.shared import delete

#: Tag of the stages' scratch tables.
TAG = "pipeline"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    drop_scratch(spark, TAG)
    return without_toxic(docs, read(spark, sf_dir, "labels"), tag=TAG)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group one row stays: that of the smallest doc_id, rows without one last."""
    drop_scratch(spark, TAG)
    return without_near_duplicates(docs, tag=TAG)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    drop_scratch(spark, TAG)
    return without_leaks(docs, read(spark, sf_dir, "benchmark"), tag=TAG)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in text gives way to its kind's name."""
    drop_scratch(spark, TAG)
    return redact(docs, tag=TAG)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048."""
    drop_scratch(spark, TAG)
    return pack(docs, vocabulary_path(), tag=TAG)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("benchmark_leaks", benchmark_leaks),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Scoring, hashing and packing are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; each result is written as Parquet in the shared folder and read again.

    A stage's folder goes once the next stage's is written; the last is the result's.
    """
    docs = read(spark, sf_dir, "documents")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete(spark, f"{folder}/{before}")
        before = name
    drop_scratch(spark, TAG)
    return docs
