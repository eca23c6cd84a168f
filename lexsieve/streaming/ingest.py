"""Incremental ingestion with Structured Streaming: each document enters the store once, however often it arrives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..sources.store import split_new, write_structured


def ingest(spark: SparkSession, inbox: str, store: str, checkpoint: str, schema: StructType | str, work: Callable[[DataFrame], DataFrame] = lambda df: df, files_per_batch: int = 100) -> StreamingQuery:
    """Run all JSON files of the inbox that the checkpoint doesn't know through work() into the store, then stop.

    work() sees only documents that the store lacks. A batch that is run again after a failure finds its documents stored and adds none.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(inbox)

    def add(batch: DataFrame, _: int) -> None:
        fresh, _cached = split_new(batch, store)
        write_structured(work(fresh), store)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
