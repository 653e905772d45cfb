"""One query for each operator, over the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skysieve.llm import (
    bfd_pack, bm25, maxscore, mixing, nb_svm, oracles, packing, pii, quality, secret_scan, simhash, token_rollup, url_filter, whitening,
)
from skysieve.llm.text import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.digest(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.digest(table(spark, sf_dir, "documents"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op9_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bfd_pack.pack(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb_svm.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_secret_scan, op2_url_filter, op3_source_mixing, op4_pii, op5_packing, op6_token_counts, op7_top_k_search,
    op8_simhash_dedup, op9_token_matrices, op10_quality_rules, op11_quality_classifier, op12_embedding_whitening, op13_ranked_search)}


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": oracles.secrets(), "op4_pii": oracles.personal_data(), "op7_top_k_search": oracles.search(),
            "op13_ranked_search": oracles.ranked()}
