"""The registered queries of this package: thin digests of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tempoweave.llm import mixing, statements, url_filter
from tempoweave.llm.automaton_dedup import remove_repeated_words
from tempoweave.llm.decontaminate import decontaminate
from tempoweave.llm.jaccard_join import similar_documents
from tempoweave.llm.language import identify_language
from tempoweave.llm.pii import personal_data
from tempoweave.llm.quality import quality_rules
from tempoweave.llm.secrets import secret_scan
from tempoweave.llm.suffix_dedup import remove_repeated_bytes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_words(table(spark, sf_dir, "documents"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (op1_personal_data, op2_suffix_array_dedup, op3_language_id, op4_quality_rules, op5_decontaminate, op6_url_filter, op7_jaccard_join, op8_secret_scan, op9_substring_dedup, op10_source_mix)
    return {f.__name__: f for f in all_}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_suffix_array_dedup": statements.REPEATED_BYTES, "op5_decontaminate": statements.CONTAMINATED, "op6_url_filter": url_filter.ORACLE,
        "op7_jaccard_join": statements.SIMILAR, "op9_substring_dedup": statements.REPEATED_WORDS, "op10_source_mix": mixing.ORACLE,
    }
