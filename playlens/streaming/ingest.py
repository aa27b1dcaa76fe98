"""Incremental ingestion of raw exports into the typed event table.

The reference cleans one static table. When exports keep arriving, its row-local
first steps - id repair and typing (C01-C03) - run as a Structured Streaming
query that appends every row, however late its event time. Copies of an event
may arrive in any file at any time, so their removal (C06) stays a step of the
batch chain over the ingested table, as do the later steps, which need whole
sessions, users and levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from playlens.model import RAW_SCHEMA
from playlens.operators.repair import typed_events


def typed_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Raw files under ``path`` as a stream of typed 14-column rows."""
    reader = spark.readStream.schema(RAW_SCHEMA).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", "true")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return typed_events(reader.load(path))


def ingest_raw_events(spark: SparkSession, source: str, sink: str, checkpoint: str, fmt: str = "parquet",
                      available_now: bool = True) -> StreamingQuery:
    """Start the ingestion query: raw files -> repaired, typed rows appended to
    parquet at ``sink``. ``checkpoint`` is the query's progress folder: the same
    path after a restart goes on where the last run ended."""
    writer = (typed_stream(spark, source, fmt).writeStream.format("parquet").outputMode("append")
              .option("path", sink).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
