"""A training-corpus pipeline of five stages over `documents`.

Each stage is (spark, docs, sf_dir) -> DataFrame. All but the last return the
columns of documents; every one works on what its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language_id, mixing
from tidemark.llm.near_dedup import one_of_each
from tidemark.llm.secret_scan import redact_secrets
from tidemark.runtime import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with text in some learned language; null, letterless and alien texts go."""
    return language_id.in_known_language(docs, language_id.fit(docs))


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near-duplicates, by sequences of five words."""
    return one_of_each(docs, width=5)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item."""
    return decontaminate.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with secrets replaced in the text and `n_chars` counted anew."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sampled rows: id, margins, tokens, probability and text."""
    return mixing.sample_mix(docs).select(
        "doc_id", "source", "lang", "topic", "n_tokens", "probability", F.col("row.text").alias("text"))


STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near duplicates", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("secrets", remove_secrets),
    ("mixing", mix),
]

# Language scores and decoded layers have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
