"""Repair of corrupted big integers and typing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from playlens.functions.columns import repaired_text, success_flag
from playlens.model import ALL14

# (column, shadow copy) pairs repaired from scientific notation.
REPAIRED = [("user_id", "user_id2"), ("event_timestamp", "event_timestamp2")]


def sci_notation_repair(df: DataFrame, pairs=REPAIRED) -> DataFrame:
    """Where the text holds 'E+', take the shadow column."""
    return df.withColumns({col: repaired_text(col, shadow) for col, shadow in pairs})


def typed_events(df: DataFrame, pairs=REPAIRED) -> DataFrame:
    """Repair, cast both id columns to bigint, drop the shadows.

    ``try_cast`` turns an unparsable text into NULL instead of failing the
    job; ``count_cast_failures`` reports how many rows that affects.
    """
    return _typed(df, pairs).select(*ALL14)


def _typed(df: DataFrame, pairs) -> DataFrame:
    typed = sci_notation_repair(df, pairs).withColumns({col: F.col(col).try_cast("bigint") for col, _ in pairs})
    return typed.withColumn("is_success", success_flag(F.col("is_success")))


def cast_lost(col: str, shadow: str) -> Column:
    """Whether the repaired text of ``col`` does not parse as bigint."""
    text = repaired_text(col, shadow)
    return text.isNotNull() & text.try_cast("bigint").isNull()


def typed_events_with_losses(raw: DataFrame, pairs=REPAIRED) -> DataFrame:
    """:func:`typed_events` with a 0/1 column ``<col>_lost`` for each cast column."""
    marked = raw.withColumns({f"{col}_lost": cast_lost(col, shadow).cast("int") for col, shadow in pairs})
    return _typed(marked, pairs).select(*ALL14, *[f"{col}_lost" for col, _ in pairs])


def count_cast_failures(raw: DataFrame, pairs=REPAIRED) -> DataFrame:
    """Rows whose repaired text did not parse as bigint, per column."""
    return raw.agg(*[F.count_if(cast_lost(col, shadow)).alias(f"{col}_lost") for col, shadow in pairs])
