"""Queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, license_scan, mixing, ngram_join, quality, suffix_dedup, token_files, toxicity
from .common import prepare, read
from .oracles import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontam.report(decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return token_files.encode_documents(spark, read(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    d = mixing.mix_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return d.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return suffix_dedup.passages(read(spark, sf_dir, "documents")).select("doc_id", "n_dup_words", "longest")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.quality(read(spark, sf_dir, "documents"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.conflict_rows(spark))
    return chat.digest(chat.format_conversations(rows))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ngram_join.near_links(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return langid.language_of(read(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return license_scan.scan(read(spark, sf_dir, "documents"), license_scan.templates(spark))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_decontamination, op2_token_files, op3_mixing, op4_suffix_dedup, op5_quality_rules, op6_chat_format, op7_ngram_join, op8_language_id, op9_license_scan, op10_toxicity)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
