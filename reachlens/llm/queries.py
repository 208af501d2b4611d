"""The registered queries of the training-data operators, with their production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from reachlens.llm import conversation, extraction, lm, media, mixing, negatives, packing, quality, simhash, suffix_dedup, token_counts, toxicity, urls
from reachlens.runtime import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(table(spark, sf_dir, "documents")))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.quality_rules(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.url_filter(pages, urls.crawled_twice(pages), urls.RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extraction.main_text(pages, extraction.fit(pages))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = negatives.quantized(table(spark, sf_dir, "embeddings"))
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", shifted), "vec_id % 100 = 0")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return conversation.digest(conversation.repair(conversation.damaged(rows), "there"))


def queries() -> dict:
    return {"pipeline": corpus_pipeline.run} | {f.__name__: f for f in (op1_lm_scoring, op2_mixing, op3_suffix_dedup, op4_media_columns, op5_toxicity, op6_packing, op7_token_counts, op8_simhash, op9_quality_rules, op10_url_filter, op11_html_extraction, op12_hard_negatives, op13_conversation_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.sql(), "op10_url_filter": urls.SQL, "op12_hard_negatives": negatives.SQL}
