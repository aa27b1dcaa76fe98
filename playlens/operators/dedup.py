"""Duplicate handling.

Every operator here aggregates on the duplicate key, so identical copies
collapse map-side (partial aggregation) before anything is shuffled: a
group of copies holding a third of the table costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.model import ALL14, KEY_DEDUP_ORDER
from playlens.session import measured_stage


def distinct_row_count(df: DataFrame, cols=ALL14) -> DataFrame:
    """Number of distinct rows over ``cols`` (NULLs equal)."""
    return df.select(*cols).distinct().agg(F.count("*").alias("distinct_rows"))


#: Copies that one task writes out at a time, and that one partition of the report holds, about.
CHUNK = 10_000
PARTITION_ROWS = 1_000_000


def duplicate_report(df: DataFrame, cols=ALL14, chunk: int = CHUNK, partition_rows: int = PARTITION_ROWS) -> DataFrame:
    """Every row whose copy group has more than one member, with the
    group size, ordered by size desc then timestamp.

    Copies are equal in all columns, so a group is one counted row: the table is
    read once and aggregated map-side, and the copies are written out again from
    the counts, without a join. A group of n copies becomes ceil(n / ``chunk``) rows,
    which are range-partitioned in the report's order and only then expanded in
    place, so a huge group is spread over tasks and no copy is shuffled. The groups
    are staged when the report is built, which tells how many rows it will have.
    """
    copies = F.col("duplicate_count")
    groups = df.groupBy(*cols).agg(F.count("*").alias("duplicate_count")).where(copies > 1)
    groups, seen = measured_stage(groups, "duplicate_groups", {"rows": F.sum("duplicate_count")})
    chunks = groups.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((copies - 1) / chunk))))
    order = [copies.desc(), F.col("event_timestamp").asc_nulls_first(), F.col("_chunk").asc(), F.xxhash64(*cols)]
    # A number of partitions of its own: merging by bytes would count a chunk as one row.
    ranges = [seen["rows"] // partition_rows + 1] if seen else []
    dealt = chunks.repartitionByRange(*ranges, *order).sortWithinPartitions(*order)
    here = F.least(F.lit(chunk).cast("long"), copies - F.col("_chunk") * chunk)
    return (dealt.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), here)))
            .select(*cols, "duplicate_count"))


def exact_dedup(df: DataFrame, cols=ALL14) -> DataFrame:
    """Keep one row per group of identical rows (NULLs equal)."""
    return df.dropDuplicates(cols).select(*df.columns)


def counted_dedup(df: DataFrame, cols=ALL14, sums: tuple = ()) -> DataFrame:
    """C06 with the number of copies of each row (``_copies``) and the sums of ``sums`` over them."""
    return df.groupBy(*cols).agg(F.count("*").alias("_copies"), *[F.sum(c).alias(c) for c in sums])


def row_count(df: DataFrame) -> DataFrame:
    """C07."""
    return df.agg(F.count("*").alias("row_count"))


def key_dedup(df: DataFrame, keys=("user_id", "event_timestamp", "level"),
              order=KEY_DEDUP_ORDER) -> DataFrame:
    """One row per ``keys``; the survivor is the first row by ``order``
    (ascending, NULLs first).

    Written as ``min(struct(order..., rest...))`` per key rather than
    ``row_number() = 1``: the min is a partial aggregate, so a key with a
    third of the rows is reduced map-side instead of sorted in one task.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    order = [c for c in order if c in rest]
    payload = order + [c for c in rest if c not in order]
    best = df.groupBy(*keys).agg(F.min(F.struct(*payload)).alias("_best"))
    return best.select(*keys, *[F.col(f"_best.{c}").alias(c) for c in payload]).select(*df.columns)
