"""The operators over their whole tables, with the parameters of production."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import hnsw, html, mixing, packing, quality, secrets, sharding, simhash, store, topk
from .common import tables


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(tables(spark, sf_dir, "embeddings"))


def op2_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(tables(spark, sf_dir, "documents"))


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(tables(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


def op5_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(tables(spark, sf_dir, "documents"))


def op6_content_addressed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.round_trip(tables(spark, sf_dir, "documents"))


def op7_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(tables(spark, sf_dir, "embeddings"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(tables(spark, sf_dir, "pages"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(tables(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(tables(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_rendezvous_sharding": op2_rendezvous_sharding,
    "op3_sum_of_squares_packing": op3_sum_of_squares_packing,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_simhash_near_duplicates": op5_simhash_near_duplicates,
    "op6_content_addressed_store": op6_content_addressed_store,
    "op7_hnsw_neighbours": op7_hnsw_neighbours,
    "op8_html_extraction": op8_html_extraction,
    "op9_source_mixing": op9_source_mixing,
    "op10_secret_scan": op10_secret_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_top_k": topk.ORACLE,
    "op9_source_mixing": mixing.ORACLE,
}
