"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyfold.llm import block_max, decontaminate, histogram_sort, personal_data, pieces, prefix_trie, pu_quality, quality_rules, rans, revisits, simhash, site_lines, weighted_samples
from tallyfold.llm.common import read, staged

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


@query("op1_simhash_near_dedup")
def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query("op2_rans_token_store")
def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rans.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return docs.select("doc_id", "start", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query("op6_sentencepiece_backtracking")
def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op5_benchmark_decontamination")
def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op7_risk_controlled_rules")
def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op8_site_line_dedup", site_lines.SQL)
def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = site_lines.page_lines(read(spark, sf_dir, "pages"))
    kept = site_lines.without_boilerplate(pages, F.regexp_extract("url", site_lines.PAGE_HOST, 1), counts=True)
    return kept.select("page_id", "host", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("op9_histogram_sort_shards")
def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    size = (F.octet_length(raw) + 8).cast("long").alias("size")
    out = staged(histogram_sort.sharded(read(spark, sf_dir, "documents").select("*", size), 24), "shards", "zstd")  # whole documents; what follows reads what came out
    return out.select("doc_id", size, F.crc32(raw).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op4_pu_quality_classifier")
def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op10_weak_supervision_pii")
def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.summary(read(spark, sf_dir, "documents"))


@query("op3_warc_revisit_resolution", revisits.SQL)
def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.resolved(revisits.captures_of(read(spark, sf_dir, "pages"))).withColumn("headers", revisits.header_text(F.col("headers")))


@query("op11_block_max_maxscore", block_max.SQL)
def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_max.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op12_conversation_prefix_trie", prefix_trie.SQL)
def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(read(spark, sf_dir, "conversations"))


@query("op13_consistent_weighted_sampling")
def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_samples.neighbours(read(spark, sf_dir, "documents"))
