"""From raw documents to packed training windows: five stages, each over all that the one before has kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexsieve.llm.common import checkpoint_folder, delete, keep_columns
from lexsieve.llm.decontaminate import leaks
from lexsieve.llm.language_id import identify, keep_accepted, train
from lexsieve.llm.packing import pack
from lexsieve.llm.simhash_dedup import drop_near_duplicates, near_duplicates
from lexsieve.llm.suffix_dedup import remove_repeats, suffix_repeats

#: The stages classify, group, cut and walk; none has an SQL equivalent. tests/llm/test_pipeline.py holds them against brute force.
ORACLE_SQL = None


# Every stage takes and returns the columns of documents, whatever else is among them; an empty table stays empty. What each does with nulls, empty and very long texts,
# ties and repeated rows is told at the operator it calls.


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows; the others go, and rows without an id or text."""
    return keep_accepted(docs, identify(docs, train(docs)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the lowest id, and one row for each id; rows without an id or a word are in no group and stay."""
    return drop_near_duplicates(docs, near_duplicates(docs))


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that an earlier document (or the document itself, earlier) has; the first occurrence stays.

    A document of which nothing is left goes; rows without an id or text stay as they are.
    """
    return remove_repeats(docs, suffix_repeats(docs))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows without an id or text hold none and stay."""
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return keep_columns(docs, found.select("doc_id").distinct(), "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of related documents; rows without an id or a word are in none."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("SimHash near-dedup", near_copies),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", benchmark),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written as Parquet to the shared checkpoint folder and read again.

    What a stage wrote is deleted once the next has been written, so that only the last one's rows, which the result reads, stay. Nulls, repeated rows, empty tables and further columns
    are as the stages have them.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for n, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        if n:
            delete(spark, f"{folder}/{n - 1}")
    return docs
