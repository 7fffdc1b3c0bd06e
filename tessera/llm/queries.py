"""The queries of this subpackage, as the driver's entry point registers them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import alignment, chat_format, html_extract, jaccard, media, mixing, packing, quality_model, quality_rules, suffix_dedup, token_counts, toxicity, whitening
from tessera.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.quality(docs, quality_model.fit_quality(docs, table(spark, sf_dir, "labels")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op11_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.chat_digests(chat_format.format_chats(chat_format.with_trap(table(spark, sf_dir, "conversations"))))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return whitening.whitened(vectors, whitening.fit_whitening(vectors))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_suffix_array_dedup, op2_html_extraction, op3_token_counts, op4_source_mixing, op5_media_columns, op6_ngram_jaccard_join, op7_best_fit_packing, op8_quality_classifier, op9_quality_rules, op10_toxicity, op11_chat_formatting, op12_cross_tokenizer_alignment, op13_embedding_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op11_chat_formatting": chat_format.SQL}
