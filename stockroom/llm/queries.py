"""Queries of the training-data operators: ``name -> (spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stockroom.llm import (chat, decontam, html, jaccard, lines, mixing, periodic, quality, records, sharding,
                           spelling, tokens, toxicity)
from stockroom.llm.common import load

Query = Callable[[SparkSession, str], DataFrame]


def op1_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op1_documents(load(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op2_conversations(load(spark, sf_dir, "conversations"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op4_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op5_documents(load(spark, sf_dir, "documents"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op6_documents(load(spark, sf_dir, "documents"))


def op7_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.op7_documents(load(spark, sf_dir, "documents"))


def op8_visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.op8_pages(load(spark, sf_dir, "pages"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op9_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.op10_documents(load(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.op11_documents(load(spark, sf_dir, "documents"))


def op12_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.op12_documents(load(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.op13_documents(load(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_feistel_shards, op2_chat_format, op3_quality_rules, op4_toxic_segments, op5_ngram_jaccard,
    op6_mix_sources, op7_fuzzy_lines, op8_visible_text, op9_decontaminate, op10_token_counts,
    op11_spelling_variants, op12_token_records, op13_periodic_runs)}

ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": chat.SQL,
    "op3_quality_rules": quality.SQL,
    "op5_ngram_jaccard": jaccard.SQL,
    "op6_mix_sources": mixing.SQL,
    "op9_decontaminate": decontam.SQL,
}
