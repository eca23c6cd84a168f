"""Driver queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_repeats

    return suffix_repeats(_table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import near_embeddings

    return near_embeddings(_table(spark, sf_dir, "embeddings"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The accepted documents with their languages."""
    from .language_id import identify, train

    docs = _table(spark, sf_dir, "documents")
    return identify(docs, train(docs)).filter("accepted").drop("accepted")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_repeats

    return substring_repeats(_table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hidden_markov import score

    return score(_table(spark, sf_dir, "documents"))


#: Shards of the production layout: two machine classes, the larger with twice the weight.
SHARDS = {i: 2.0 if i >= 12 else 1.0 for i in range(16)}


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rendezvous import assign_shards

    return assign_shards(_table(spark, sf_dir, "documents"), SHARDS)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .importance import resample

    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_module("corpus_pipeline").run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_decontamination": op2_decontamination,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_embedding_dedup": op4_embedding_dedup,
        "op5_simhash_dedup": op5_simhash_dedup,
        "op6_language_id": op6_language_id,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_lm_scoring": op8_lm_scoring,
        "op9_sharding": op9_sharding,
        "op10_quality": op10_quality,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    from .rendezvous import assign_shards_sql

    return {"op9_sharding": assign_shards_sql("documents", SHARDS)}
