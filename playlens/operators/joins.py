"""Joins to a lookup with one row per key, where one key may have a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that a join leaves in one task, at least.
HOT_ROWS = 100_000
#: Keys that a join spreads, at most: a key is hot from total / HOT_KEYS rows on.
HOT_KEYS = 10_000


def spread_join(rows: DataFrame, lookup: DataFrame, keys: list[str], known_rows: int | None = None,
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join of ``rows`` to ``lookup``, which has one row per ``keys``; hot keys are spread over tasks.

    A key with more than ``hot_rows`` rows and more than one in ``HOT_KEYS`` of all is
    hot: its lookup row is repeated under several salts and its rows, which must
    differ in some column, are dealt to them by a hash of the whole row. At most
    ``HOT_KEYS`` keys can be hot, so their list is broadcast. Runs jobs that count
    the rows and the keys, unless ``known_rows`` says that there are few. Null keys
    find nothing.
    """
    if known_rows is not None and known_rows <= hot_rows:
        return rows.join(lookup, keys, "left")
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_rows"))
    total, most = counts.agg(F.sum("_rows"), F.max("_rows")).first()
    bound = max(hot_rows, -(-(total or 0) // HOT_KEYS))
    if not most or most <= bound:
        return rows.join(lookup, keys, "left")
    hot = counts.where(F.col("_rows") > bound).select(*keys, F.ceil(F.col("_rows") / bound).cast("int").alias("_salts"))
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    dealt = (rows.join(F.broadcast(hot), keys, "left")
             .withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), salts).cast("int")).drop("_salts"))
    copies = (lookup.join(F.broadcast(hot), keys, "left")
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts"))
    return dealt.join(copies, [*keys, "_salt"], "left").drop("_salt").select(*rows.columns, *[c for c in lookup.columns if c not in keys])
