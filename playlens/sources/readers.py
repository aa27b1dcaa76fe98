"""Readers and writers for the event table in files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from playlens.model import EVENT_SCHEMA, RAW_COLUMNS, RAW_SCHEMA
from playlens.sources.tableset import Files


def read_raw_events(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Raw 16-column export (ids as text with shadow copies).

    The schema is given, never inferred: a text column such as ``user_id``
    must stay text so that ``2.45533E+16`` can be repaired.
    """
    reader = spark.read.schema(RAW_SCHEMA).options(**options)
    if fmt == "csv":
        reader = reader.option("header", options.get("header", "true"))
    return reader.format(fmt).load(path)


BROKEN = "_broken_line"


def read_raw_csv_checked(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame]:
    """(well-formed rows, broken lines) of a raw CSV export.

    A line is broken if it has too few or too many fields or a field that is not of its
    column's type; read plainly it would pass as a row with NULLs. Broken lines come
    with their file, whole, for a quarantine table and to be counted. Ids are text, so a
    value such as ``2.45533E+16`` breaks no line.
    """
    schema = T.StructType([*RAW_SCHEMA.fields, T.StructField(BROKEN, T.StringType())])
    lines = (spark.read.schema(schema).option("header", "true").options(**options)
             .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BROKEN).csv(path))
    # Spark parses only the fields that a query needs, and a broken one could go unseen: this always holds and needs all.
    parsed = F.length(F.concat_ws("", *[F.col(c).cast("string") for c in RAW_COLUMNS])) >= 0
    broken = lines.where(F.col(BROKEN).isNotNull() & parsed).select(F.input_file_name().alias("file"), F.col(BROKEN).alias("line"))
    return lines.where(F.col(BROKEN).isNull() & parsed).select(*RAW_COLUMNS), broken


def read_typed_events(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A 14-column typed table, e.g. a previously written clean table."""
    return spark.read.schema(EVENT_SCHEMA).options(**options).format(fmt).load(path)


def write_table(df: DataFrame, path: str | None = None, table: str | None = None,
                fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Drop-and-recreate sink (the reference's DROP TABLE + SELECT INTO). A path is
    overwritten by a fresh folder that takes its place once it is whole, so a write that
    fails leaves the old table as it was."""
    if table:
        df.write.mode(mode).format(fmt).saveAsTable(table)
    elif path and mode == "overwrite":
        files = Files(df.sparkSession, path)
        fresh, old = (f"{files.root}.{what}-{uuid.uuid4().hex}" for what in ("new", "old"))
        df.write.format(fmt).save(fresh)
        if replaced := files.fs.exists(files.path(files.root)):
            files.rename(files.root, old)
        files.rename(fresh, files.root)
        if replaced:
            files.delete(old)
    elif path:
        df.write.mode(mode).format(fmt).save(path)
    else:
        raise ValueError("give a path or a table name")
