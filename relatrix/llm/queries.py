"""The registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare
from . import katz, media, mixing, neardup, packing, quality_model, quality_rules, sharding, token_counts, toxicity


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.training_order(mixing.mix(documents(spark, sf_dir), carry=True))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = quality_rules.clean_lines(documents(spark, sf_dir))
    return d.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = toxicity.toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return d.select("doc_id", "held_out", "score", "predicted", F.size("passages").alias("n_passages"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir)).drop("key_range")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.payload_digest(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir))


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(documents(spark, sf_dir))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_mixing": op3_mixing,
    "op4_quality_rules": op4_quality_rules,
    "op5_quality_model": op5_quality_model,
    "op6_toxicity": op6_toxicity,
    "op7_sharding": op7_sharding,
    "op8_media": op8_media,
    "op9_token_counts": op9_token_counts,
    "op10_katz": op10_katz,
}

ORACLES = {
    "op3_mixing": mixing.oracle_sql(),
    "op4_quality_rules": quality_rules.oracle_sql(),
}
