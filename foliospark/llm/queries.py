"""The operators' queries: name -> (spark, sf_dir) -> DataFrame, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import chat, covertree, decontaminate, html_main, licenses, maxent, merkle, mixing, quality, resample, simhash, tokencount, toxicity


@lru_cache
def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents"), columns=["doc_id", "lang", "source"])


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_documents(spark, _table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokencount.count_tokens(spark, _table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_odd_one(spark, _table(spark, sf_dir, "conversations"))
    return chat.digests(chat.format_conversations(rows, tokenizer_file("byte_bpe_50k.json"))).drop("n_tokens", "n_loss_tokens")


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(_table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digests(licenses.scan(spark, _table(spark, sf_dir, "documents")))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_check(_table(spark, sf_dir, "documents"))


def op13_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), columns=["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mix_sources, op2_embedding_near_dedup, op3_decontaminate, op4_maxent_scores, op5_token_counts, op6_simhash_near_dedup, op7_quality_classifier, op8_chat_format, op9_html_main_text, op10_toxicity, op11_license_scan, op12_merkle_manifest, op13_importance_resample)
}

SQL: dict[str, str] = {"op1_mix_sources": mixing.oracle_sql(), "op2_embedding_near_dedup": covertree.SQL, "op3_decontaminate": decontaminate.SQL, "op8_chat_format": chat.SQL, "op11_license_scan": licenses.oracle_sql(), "op12_merkle_manifest": merkle.oracle_sql(), "op13_importance_resample": resample.oracle_sql()}
