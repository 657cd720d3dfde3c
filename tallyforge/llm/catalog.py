"""The registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import decontaminate, hilbert, language_id, license_scan, merkle, mixing, quality_rules, secret_scan, simhash, suffix_dedup, token_counts, token_store, vector_codes
from tallyforge.llm.shared import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_ids(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shards(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return secret_scan.digests(secret_scan.secret_scan(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.fifth_of_ids())


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to callable."""
    return {
        f.__name__: f
        for f in (
            op1_token_store, op2_license_scan, op3_token_counts, op4_quality_rules, op5_language_id,
            op6_mixing, op7_decontaminate, op8_hilbert_shards, op9_suffix_dedup, op10_simhash,
            op11_secret_scan, op12_merkle_manifest, op13_vector_codes,
        )
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of those that SQL can express; the others have brute-force tests in tests/llm."""
    return {
        "op2_license_scan": license_scan.oracle_sql(), "op6_mixing": mixing.oracle_sql(),
        "op12_merkle_manifest": merkle.oracle_sql(), "op13_vector_codes": vector_codes.oracle_sql(),
    }
