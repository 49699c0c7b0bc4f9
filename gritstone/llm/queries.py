"""The corpus operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .oracle import OP4, OP5

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"), shingle_words=3, radius=2)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination_report

    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


def op6_ann_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann_tree import search

    return search(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import token_report

    return token_report(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_strings

    return repeated_strings(table(spark, sf_dir, "documents"), size=200)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(table(spark, sf_dir, "documents")).drop("found")


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_license": op2_license,
    "op3_simhash": op3_simhash,
    "op4_url_filter": op4_url_filter,
    "op5_decontaminate": op5_decontaminate,
    "op6_ann_tree": op6_ann_tree,
    "op7_token_store": op7_token_store,
    "op8_packing": op8_packing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_pii": op10_pii,
}

#: The others rest on hashes, models, tokenizers or positions that SQL lacks; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op4_url_filter": OP4, "op5_decontaminate": OP5}
