"""The registered queries of this folder: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crashgrade.llm.common import table
from crashgrade.llm.conversations import repair_conversations
from crashgrade.llm.exact_dedup import exact_groups
from crashgrade.llm.language import identify_languages
from crashgrade.llm.mixing import mix_sources
from crashgrade.llm.packing import pack
from crashgrade.llm.passages import near_passages
from crashgrade.llm.quality import classify_quality
from crashgrade.llm.quality_rules import judge_quality
from crashgrade.llm.secrets import find_secrets
from crashgrade.llm.shingle_join import link_documents
from crashgrade.llm.spelling import spelling_groups
from crashgrade.llm.suffix_dedup import remove_repeats
from crashgrade.llm.topk import exact_top_k


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_passages(table(spark, sf_dir, "documents"))


def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_top_k,
        op2_quality_classifier,
        op3_secret_scan,
        op4_source_mixing,
        op5_exact_dedup,
        op6_best_fit_packing,
        op7_compact_windows,
        op8_shingle_join,
        op9_suffix_dedup,
        op10_language_id,
        op11_quality_rules,
        op12_conversation_repair,
        op13_spelling_variants,
    )
}
