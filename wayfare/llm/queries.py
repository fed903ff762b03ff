"""The thin queries over the operators of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, jaccard, lines, mixing, quality, secrets, sharding, substring, suffix, tokens
from ._tables import read_documents


def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_contamination(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_block_anchor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(read_documents(spark, sf_dir))


def op3_unigram_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(read_documents(spark, sf_dir), tokens.read_vocabulary())


def op4_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_documents(spark, sf_dir))


def op5_template_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.drop_templates(read_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op6_minhash_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read_documents(spark, sf_dir))


def op7_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(read_documents(spark, sf_dir))


def op8_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_documents(spark, sf_dir))


def op9_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(read_documents(spark, sf_dir))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeated_bytes(read_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from .oracle import ORACLES

    return dict(ORACLES)
