"""The queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (
    byte_bpe, decontamination, exact_dedup, filter_audit, maxent_lm, quality_gam, quality_rules, sharding, simhash, spelling, substring_dedup, suffix_dedup, token_files,
)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(_docs(spark, sf_dir))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gam.classified(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assigned(_docs(spark, sf_dir))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_docs(spark, sf_dir))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.removed_spans(_docs(spark, sf_dir)))


def op7_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.removed_words(_docs(spark, sf_dir)))


def op9_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.scores(_docs(spark, sf_dir))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(_docs(spark, sf_dir))


def op12_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audited(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_spelling_variant_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.grouped(_docs(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_sharding": op4_sharding,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_byte_level_bpe": op7_byte_level_bpe,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_id_output": op9_token_id_output,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_filter_interaction_audit": op12_filter_interaction_audit,
    "op13_spelling_variant_grouping": op13_spelling_variant_grouping,
}

SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.ORACLE_SQL,
    "op11_exact_dedup": exact_dedup.ORACLE_SQL,
    "op12_filter_interaction_audit": filter_audit.ORACLE_SQL,
}
