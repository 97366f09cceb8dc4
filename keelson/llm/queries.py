"""The registered queries of this subpackage; each reads whole tables of ``sf_dir``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keelson.llm import (
    chat,
    decontamination,
    filter_audit,
    html_text,
    language_id,
    near_duplicates,
    packing,
    quality,
    token_counts,
    toxicity,
    turn_repair,
    url_filter,
    vector_search,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.held_out_languages(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digest(packing.pack_documents(_table(spark, sf_dir, "documents")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_toxicity(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted_digests(_table(spark, sf_dir, "conversations"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_text(pages).select("page_id", "url", "text", "n_chars")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminations(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.redacted_counts(_table(spark, sf_dir, "documents"))


def op8_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return vector_search.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.held_out_quality(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repaired_conversations(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_chat_format": op4_chat_format,
    "op5_html_text": op5_html_text,
    "op6_decontamination": op6_decontamination,
    "op7_token_counts": op7_token_counts,
    "op8_vector_search": op8_vector_search,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_quality": op10_quality,
    "op11_url_filter": op11_url_filter,
    "op12_filter_audit": op12_filter_audit,
    "op13_turn_repair": op13_turn_repair,
}
