"""The operators of this subpackage as queries over the tables of a folder, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import bpe, line_dedup, mixing, quality, secrets, simhash, suffix_dedup, token_counts, token_files, topk

Query = Callable[[SparkSession, str], DataFrame]


def over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


QUERIES: dict[str, Query] = {
    "op1_quality_rules": over("documents", quality.quality_table),
    "op2_secret_scan": over("documents", secrets.secret_table),
    "op3_bpe_round_trip": over("documents", bpe.round_trip_table),
    "op4_suffix_dedup": over("documents", suffix_dedup.suffix_table),
    "op5_token_files": over("documents", token_files.token_file_table),
    "op6_token_counts": over("documents", token_counts.token_count_table),
    "op7_simhash_near_dedup": over("documents", simhash.near_duplicates),
    "op8_source_mixing": over("documents", mixing.mixture_table),
    "op9_exact_top_k": over("embeddings", topk.top_k),
    "op10_line_dedup": over("documents", line_dedup.line_table),
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": quality.ORACLE,
    "op8_source_mixing": mixing.ORACLE,
    "op9_exact_top_k": topk.ORACLE,
}
