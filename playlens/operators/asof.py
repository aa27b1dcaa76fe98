"""Two-sided nearest-in-time lookup within a key (an as-of join in both
directions), without a self-join.

All rows of a key at one instant are one point: whether targets are there, and the
smallest value of the candidates there, which is the only one that can be picked. Points
come from a partial aggregate, so a burst at one instant is one row before anything
is shuffled. Both directions are running frames from the start of a sorted partition of
points (the later neighbour by a descending sort), so n points cost n steps.
Keys with more points than the target are cut into ranges (see ``buckets``); a range
takes what its own points lack from the nearest earlier and later range of its
key, carried over one summary row per range. Targets are joined to their point, with
the rows of a very common point dealt to several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlens.operators.buckets import split_hot
from playlens.operators.joins import HOT_ROWS, spread_join

BEFORE = Window.unboundedPreceding


def _candidate(ts: str) -> Column:
    """(time, value) of a point with candidates; the order of structs is that of time."""
    return F.when(F.col("_v").isNotNull(), F.struct(F.col(ts).alias("t"), F.col("_v").alias("v")))


def _within(points: DataFrame, part: list[str], ts: str) -> DataFrame:
    """Target points with the nearest candidate at or before (_prv) and at or after (_nxt) in their partition."""
    up = Window.partitionBy(*part).orderBy(F.col(ts).asc()).rowsBetween(BEFORE, Window.currentRow)
    down = Window.partitionBy(*part).orderBy(F.col(ts).desc()).rowsBetween(BEFORE, Window.currentRow)
    here = _candidate(ts)
    return points.select("*", F.max(here).over(up).alias("_prv"), F.min(here).over(down).alias("_nxt")).where("_target")


def _across(points: DataFrame, key: str, ts: str) -> DataFrame:
    """The same over the ranges of hot keys."""
    here = _candidate(ts)
    up = Window.partitionBy(key).orderBy(F.col("_b").asc()).rowsBetween(BEFORE, -1)
    down = Window.partitionBy(key).orderBy(F.col("_b").desc()).rowsBetween(BEFORE, -1)
    carried = (points.groupBy(key, "_b").agg(F.max(here).alias("_last"), F.min(here).alias("_first"))
               .select(key, "_b", F.max("_last").over(up).alias("_cprv"), F.min("_first").over(down).alias("_cnxt")))
    return (_within(points, [key, "_b"], ts).join(carried, [key, "_b"], "left")
            .withColumns({"_prv": F.coalesce("_prv", "_cprv"), "_nxt": F.coalesce("_nxt", "_cnxt")})
            .drop("_b", "_cprv", "_cnxt"))


def nearest_by_time(targets: DataFrame, candidates: DataFrame, key: str, ts: str, value: str,
                    out: str, target_rows: int | None = None, rows: int | None = None,
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """For each target row, ``out`` = the ``value`` of the candidate of the
    same ``key`` nearest in ``ts`` (either direction); on equal distance the
    smallest value. NULL when the key has no candidate.

    ``targets`` and ``candidates`` must have non-null ``key`` and ``ts``;
    candidates must have a non-null ``value``. Runs jobs that count the points of the
    keys and the targets of the points, unless the caller knows that both tables together
    have at most ``rows`` rows and those are few.
    """
    none = F.lit(None).cast(candidates.schema[value].dataType)
    both = (targets.select(key, ts, none.alias("_v"), F.lit(True).alias("_target"))
            .unionByName(candidates.select(key, ts, F.col(value).alias("_v"), F.lit(False).alias("_target"))))
    points = both.groupBy(key, ts).agg(F.min("_v").alias("_v"), F.bool_or("_target").alias("_target"))
    ordinary, hot = split_hot(points, [key], [ts], "_b", target_rows, rows)
    found = _within(ordinary, [key], ts)
    if hot is not None:
        found = found.unionByName(_across(hot, key, ts))
    prv, nxt = F.col("_prv"), F.col("_nxt")
    d_prev, d_next = F.col(ts) - prv["t"], nxt["t"] - F.col(ts)
    pick = (F.when(prv.isNull(), nxt["v"])
            .when(nxt.isNull(), prv["v"])
            .when(d_prev < d_next, prv["v"])
            .when(d_next < d_prev, nxt["v"])
            .otherwise(F.least(prv["v"], nxt["v"])))
    return spread_join(targets, found.select(key, ts, pick.alias(out)), [key, ts], rows, hot_rows)
