"""The registered queries of the corpus operators, with the SQL that checks them.

Each applies its operator, with production parameters, to its whole table.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, language_id, line_quality, mixing, oracle, token_count, warc_audit
from tidemark.llm.html_text import extract_text
from tidemark.llm.license_scan import scan_licenses
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.secret_scan import scan_secrets
from tidemark.llm.spelling import spelling_variants
from tidemark.llm.token_alignment import Files, align_corpus

# Folder of the public tokenizers' files.
TOKENIZERS = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL check."""

    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


@query()
def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return line_quality.judge_lines(docs, line_quality.fit(docs, _table(spark, sf_dir, "labels")))


@query()
def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = token_count.read_vocabulary(f"{TOKENIZERS}/piece_bpe_32k.model")
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), *vocabulary, split=False)


@query()
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


@query(oracle.CONTAINMENT)
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query(oracle.FIXITY)
def op6_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    page = [F.col(c) for c in ("page_id", "url", "html")]
    replicas = {"a": warc_audit.warc_record(*page[1:]), "b": warc_audit.damaged(*page)}
    found = warc_audit.audit(warc_audit.manifest(pages, replicas, "page_id", "url"), "a", "b")
    # Places depend on how the table's files are dealt to tasks, so they are not compared.
    return found.select("page_id", "url", "kind", "size_a", "size_b", "sha256_a", "sha256_b")


@query(oracle.mixing())
def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


@query(oracle.NEAR_DUPLICATES)
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query()
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


@query()
def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


@query()
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = Files.read(f"{TOKENIZERS}/byte_bpe_50k.json", f"{TOKENIZERS}/piece_bpe_32k.model")
    return align_corpus(_table(spark, sf_dir, "documents"), files)


@query(oracle.LINES)
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query(oracle.SPELLING)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(_table(spark, sf_dir, "documents"))
