"""Data-quality reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.model import ALL14


def null_profile(df: DataFrame, cols=ALL14) -> DataFrame:
    """Total rows and NULL count per column, in one pass."""
    return df.agg(F.count("*").alias("total_rows"),
                  *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols])


def missingness_patterns(df: DataFrame) -> DataFrame:
    """Rows by event name and which of duration / outcome is missing."""
    return (df.groupBy("event_name",
                       F.col("time_played").isNull().alias("time_missing"),
                       F.col("is_success").isNull().alias("outcome_missing"))
            .agg(F.count("*").alias("events")))
