"""Splitting the timelines of very active keys over many tasks.

A window over a key's rows holds the whole key in one task. That is right for
ordinary keys; a key with more than ``TARGET_ROWS`` rows is instead cut into
ranges of about that many rows by Spark's own range partitioning over the full
sort order (key, then the window's order columns), so bursts, quiet years and rows
without a timestamp are all split by rows. Neighbouring ranges are then joined by
what they have at their edges (see ``timeline`` and ``asof``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.session import stage_table, staging

# Rows one window partition should hold at most, roughly.
TARGET_ROWS = 2_000_000


def split_hot(df: DataFrame, keys: list[str], order: list, out: str = "_b",
              target_rows: int | None = None, rows: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys with their range ``out`` or None).

    Keys must not be NULL. ``out`` ascends with ``order`` within a key and rows
    that are equal in ``order`` share a range. Counting the keys runs a job, and so
    does writing the hot rows where there are any; every key above the target is
    split, however many there are. Where stage tables are off nothing is split, and
    where the caller knows that ``df`` has at most ``rows`` rows, too few for a hot key,
    nothing is counted.
    """
    target_rows = target_rows or TARGET_ROWS
    if not staging() or (rows is not None and rows <= target_rows):
        return df, None
    hot = stage_table(df.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > target_rows), "hot_keys")
    total = hot.agg(F.sum("_rows")).first()[0]
    if not total:
        return df, None
    members = df.join(hot.drop("_rows"), keys, "left_semi")
    ranged = members.repartitionByRange(-(-total // target_rows) + 1, *keys, *order).withColumn(out, F.spark_partition_id())
    # Written once: the ranges come from a sample and must not be drawn again.
    return df.join(hot.drop("_rows"), keys, "left_anti"), stage_table(ranged, "hot_rows")
