"""Queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, minhash, packing, pii, quality, rules, substring, suffix_dedup, toxicity
from ._state import ready


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(_read(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(_read(spark, sf_dir, "documents"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.report(spark, _read(spark, sf_dir, "conversations"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_read(spark, sf_dir, "documents"))


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.report(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash": op1_minhash,
    "op2_toxicity": op2_toxicity,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_pii": op4_pii,
    "op5_decontamination": op5_decontamination,
    "op6_packing": op6_packing,
    "op7_quality": op7_quality,
    "op8_quality_rules": op8_quality_rules,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_chat": op10_chat,
}
ORACLE_SQL: dict[str, str] = {"op5_decontamination": decontam.ORACLE_SQL, "op9_substring_dedup": substring.ORACLE_SQL, "op10_chat": chat.ORACLE_SQL}
