"""Driver queries of the order-dependent operators, which SQL can't express: rows only, tested against their definitions."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import StringType, StructField, StructType

from .. import flow
from ..functions import rules as R
from ..functions.dialect import SPARK
from ..plans.queries import run
from . import candidates, repairs, similar, units, validation

ROOT = str(Path(__file__).resolve().parents[2])


def ready(spark: SparkSession) -> SparkSession:
    """Python workers can import this package."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))
    return spark


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run(ready(spark), sf_dir, "section_rows")


def unit_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of each section with action phrase and quality."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, s, n, u, a := units.action(u), *units.quality(a, u)) for d, s, t in zip(b.doc_id, b.section, b.section_text) for n, u in enumerate(units.units(t), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "section", "unit", "text", "action", "quality", "reason"])

    return _sections(spark, sf_dir).mapInPandas(split, "doc_id bigint, section bigint, unit int, text string, action string, quality double, reason string")


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sentences of each section for the sentence profile, and their tidied actions."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, s, n, x, units.tidied(x, t)) for d, s, t in zip(b.doc_id, b.section, b.section_text) for n, x in enumerate(units.sentences(t), 1)]
            yield pd.DataFrame(rows, columns=["doc_id", "section", "nth", "sentence", "action"])

    return _sections(spark, sf_dir).mapInPandas(split, "doc_id bigint, section bigint, nth int, sentence string, action string")


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of the driver's documents, numbered."""
    docs = ready(spark).read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, t in zip(b.doc_id, b.text):
                kept = [c.strip() for c in units.chunks(t or "") if len(c.strip()) >= 100]
                rows += [(f"{d}-chunk-{n:04d}", d, n, len(kept), c) for n, c in enumerate(kept)]
            yield pd.DataFrame(rows, columns=["chunk_id", "doc_id", "chunk_index", "total_chunks", "text"])

    return docs.mapInPandas(split, "chunk_id string, doc_id bigint, chunk_index int, total_chunks int, text string")


def _actions(df: DataFrame) -> DataFrame:
    """df(…, clause_text) with the clause's action phrase."""
    schema = StructType([*df.schema.fields, StructField("action", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("action", pa.array(list(map(units.action, b.column("clause_text").to_pylist())), pa.string()))

    return df.mapInArrow(run, schema)


def _obligations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Obligations of the clauses in the shape that similar.py works on; ten neighbouring clauses are a section."""
    found = _actions(run(ready(spark), sf_dir, "candidate_clauses"))
    section = F.floor(F.col("section_id") / 10).cast("string")
    return found.select(
        "doc_id", "source", F.col("section_id").alias("ord"), F.concat(section, F.lit("-"), F.col("section_id").cast("string")).alias("id"), section.alias("section_id"), section.alias("clause_number"), "actor", "action",
        "obligation_type", "domain", "severity", "confidence", F.split("departments", ", ").alias("departments"), "deadline", "duration", "urgency", "deadline_date", F.lit(None).cast("string").alias("notes"), F.when(F.col("n_references") > 0, F.expr(R.cross_references(SPARK, "clause_text"))).otherwise(F.expr(SPARK.strings([]))).alias("cross_references"),
        F.expr(R.evidence(SPARK, "low", "domain")).alias("evidence"), "penalty", F.lit(None).cast("string").alias("trigger"), "clause_text",
    )


def _dedup(work: Callable, keys: list[str]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: similar.grouped(_obligations(spark, sf_dir).drop("clause_text", "trigger", "duration", "urgency", "deadline_date"), keys, work, "ord")


def _documents(work: Callable[[similar.Rows], list[dict]], schema: str) -> Callable[[SparkSession, str], DataFrame]:
    """work() over the obligations of each document."""
    return lambda spark, sf_dir: similar.by_group(_obligations(spark, sf_dir), ["doc_id"], work, "ord", schema)


def _text(rows: similar.Rows) -> str:
    """The document as numbered lines: what validation reads."""
    return "\n".join(f"{r['clause_number']}. {r['clause_text']}" for r in rows)


def _validated(rows: similar.Rows) -> list[dict]:
    got = validation.validate(_text(rows), rows[: -(-len(rows) // 2)])
    doc = rows[0]["doc_id"]
    return [{"doc_id": doc, "kind": "missed", "obligation_id": m["clause_number"], "field": "clause", "correct_value": "", "reason": m["reason_missed"]} for m in got["missed"]] + [{"doc_id": doc, "kind": "incorrect"} | f for f in got["incorrect"]]


def _repaired(rows: similar.Rows) -> list[dict]:
    """C16 of the first half of a document's obligations by what validation finds against its whole text."""
    half = rows[: -(-len(rows) // 2)]
    got = repairs.repair(half, validation.validate(_text(rows), half), text=_text(rows))
    left = len(got["validation"]["incorrect"])
    return [{"doc_id": rows[0]["doc_id"], "left": left} | {k: r.get(k) for k in ("id", "clause_number", "actor", "action", "obligation_type", "domain", "severity", "confidence", "deadline", "notes")} | {"departments": list(r["departments"])} for r in got["obligations"]]


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The circulars of the clause corpus as pages of files, the first 1500 characters of a circular being its first page."""
    docs = run(ready(spark), sf_dir, "circular_texts").select(F.concat(F.lit("/in/"), F.lower("source"), F.lit("-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"), "full_text")
    page = F.posexplode(F.array(F.substring("full_text", 1, 1500), F.expr("substr(full_text, 1501)"))).alias("n", "text")
    return docs.select("path", page).filter("text <> ''").select("path", (F.col("n") + 1).alias("page_number"), "text", F.length("text").alias("char_count"))


def _flow(what: str) -> Callable[[SparkSession, str], DataFrame]:
    """C20: one of the tables of a whole run over the circulars."""
    return lambda spark, sf_dir: getattr(flow.run(spark, _pages(spark, sf_dir)), what)


def candidate_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Obligations by candidate voting."""
    return candidates.extract(run(ready(spark), sf_dir, "candidate_clauses"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "unit_split": unit_split,
        "sentence_split": sentence_split,
        "chunk_overlap": chunk_documents,
        "dedup_document": _dedup(similar.dedup_document, ["doc_id"]),
        "dedup_section": _dedup(similar.dedup_section, ["source", "section_id"]),
        "dedup_and_merge": _dedup(similar.dedup_and_merge, ["source", "section_id"]),
        "document_validation": _documents(_validated, "doc_id bigint, kind string, obligation_id string, field string, current_value string, correct_value string, reason string"),
        "obligation_repair": _documents(_repaired, "doc_id bigint, id string, clause_number string, actor string, action string, obligation_type string, domain string, severity string, confidence double, deadline string, notes string, departments array<string>, left int"),
        "pipeline_documents": _flow("documents"),
        "pipeline_obligations": _flow("obligations"),
        "pipeline_pairs": _flow("pairs"),
        "candidate_profile": candidate_profile,
    }


def oracle_sql() -> dict[str, str]:
    return {}
