"""Structured output and its idempotent growth."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_structured(documents: DataFrame, path: str, mode: str = "append") -> None:
    """JSON, one folder a source."""
    documents.write.mode(mode).partitionBy("source").json(path)


def read_structured(spark: SparkSession, path: str, schema: StructType, source: str | None = None, doc_id: str | None = None) -> DataFrame:
    """All, of a source (only its folder is read) or one document; lines that aren't JSON are dropped."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    df = df.filter(F.col("source") == source) if source else df
    return df.filter(F.col("doc_id") == doc_id) if doc_id else df


def append_pairs(pairs: DataFrame, path: str) -> None:
    """Training pairs as JSON lines."""
    pairs.write.mode("append").json(path)


def stored_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id of what the store holds; nothing if there is no store yet."""
    try:
        return spark.read.schema("doc_id string").json(path).filter("doc_id is not null").distinct()
    except AnalysisException:
        return spark.createDataFrame([], "doc_id string")


def split_new(documents: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Documents that the store lacks, and those that it has; a document counts once."""
    spark, once = documents.sparkSession, documents.dropDuplicates(["doc_id"])
    have = stored_ids(spark, path)
    return once.join(have, "doc_id", "left_anti"), once.join(have, "doc_id", "left_semi")


def parse_selection(text: str, total: int) -> list[int]:
    """S15: "1,3,5-7" to sorted numbers; ends of ranges are held within 1 and total, single numbers are not; what isn't a number is skipped."""
    out: set[int] = set()
    for part in re.split(r"\s*,\s*", text.strip()):
        if m := re.fullmatch(r"(\d+)\s*-\s*(\d+)", part):
            out.update(range(max(1, int(m[1])), min(total, int(m[2])) + 1))
        elif part.isdigit():
            out.add(int(part))
    return sorted(out)
