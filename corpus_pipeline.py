"""The corpus pipeline: documents through five operators of ``tallyfold.llm``, each stage written and read again.

quality rules -> line dedup by site -> SimHash near-dedup -> benchmark decontamination -> SentencePiece ids

All stages but the last return the columns of documents (n_chars follows a text that was cut). Every stage works on all
rows that the one before kept: null and empty texts fail the quality rules, so they end there; repeated rows are near
duplicates of each other; an empty table stays empty; further columns are carried along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyfold.llm import decontaminate, near_copies, pieces, quality_rules, site_lines
from tallyfold.llm.common import read, staged


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's risk-controlled cutoffs."""
    return quality_rules.kept(docs, read(spark, sf_dir, "labels"))


SOURCE_RATIO, LEAST_WORDS = 0.02, 4  # a source is far larger than a host: see README, "Line dedup in the pipeline"


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of four words or more that stand on over 2 % of their source's documents (and on 5)."""
    return site_lines.without_boilerplate(docs, F.col("source"), ratio=SOURCE_RATIO, least_words=LEAST_WORDS).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, found by Golay keys of SimHash: 0.8 or more of their five-word shingles are the same."""
    return near_copies.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage; the others go as a whole."""
    return decontaminate.without_spans(docs, read(spark, sf_dir, "benchmark"), most_hit=0.0)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what is left."""
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("sentencepiece", encoding),
]

ORACLE_SQL = None  # thresholds, fingerprints and pieces are beyond SQL; tests/llm compares with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
