"""Dense global rank without a single-partition window.

The distinct keys are range-partitioned, each range is ranked by itself, and
shifted by the number of keys in all lower ranges (one row per range). The ranges
are Spark's own, so the plan does not grow with their number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlens.session import stage_table, staging


#: Keys that one task ranks at most.
RANK_ROWS = 1_000_000


def dense_rank_global(df: DataFrame, key: str, out: str = "rank", ranges: int | None = None,
                      rows: int | None = None) -> DataFrame:
    """Distinct non-null ``key`` values with their dense rank (1 = smallest).

    Writes the distinct keys as a stage table (a job runs while the plan is
    built). Without ``ranges`` the session's shuffle partitions are used, which
    adaptive execution coalesces to its advisory size. Where the caller knows that
    ``df`` has at most ``rows`` rows, few enough for one task, nothing is staged.
    """
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    if rows is not None and rows <= RANK_ROWS:
        return keys.select(key, F.row_number().over(Window.orderBy(key)).cast("long").alias(out))
    if not staging():
        ranges = 1
    dealt = keys.repartitionByRange(ranges, key) if ranges else keys.repartitionByRange(key)
    keys = stage_table(dealt.withColumn("_r", F.spark_partition_id()), "rank_keys")
    sizes = keys.groupBy("_r").agg(F.count("*").alias("_n"))
    below = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_r").alias("_s"), F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_off"))
    local = keys.withColumn("_local", F.row_number().over(Window.partitionBy("_r").orderBy(key)))
    # One row per range: bounded by the number of shuffle partitions.
    ranked = local.join(F.broadcast(offsets), F.col("_r") == F.col("_s"))
    return ranked.select(key, (F.col("_off") + F.col("_local")).cast("long").alias(out))
