"""Drop-off by level (D01-D03) over the clean table.

Each definition is an aggregate per user joined back on keys that include
more than the user (level or timestamp), so a very active user does not
concentrate in one join partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.functions.columns import ratio
from playlens.model import FAIL

U, L = "user_id", "level"


def user_max_level(df: DataFrame) -> DataFrame:
    return df.groupBy(U).agg(F.max(L).alias("max_level"))


def level_dropoff(df: DataFrame) -> DataFrame:
    """Users reaching each level and users whose highest level it
    is. A NULL user counts once among the dropped (it is a group of the
    per-user maximum) and never among the reached (COUNT DISTINCT)."""
    reach = df.groupBy(L).agg(F.countDistinct(U).alias("users_reached"))
    dropped = (user_max_level(df).groupBy("max_level").agg(F.count("*").alias("_dropped")))
    joined = reach.join(dropped, reach[L] == dropped["max_level"], "left")
    d = F.coalesce(F.col("_dropped"), F.lit(0)).cast("long")
    return joined.select(L, "users_reached", d.alias("dropped_users"),
                         ratio(d, F.col("users_reached")).alias("dropoff_rate"))


def dropoff_next_level(df: DataFrame) -> DataFrame:
    """D01."""
    return level_dropoff(df).orderBy(F.col(L).asc_nulls_first())


def dropoff_last_event(df: DataFrame) -> DataFrame:
    """Level of each user's last event(s); ties at the last timestamp
    all count."""
    last = df.groupBy(U).agg(F.max("event_timestamp").alias("_last")).withColumnRenamed(U, "_u")
    hit = df.join(last, (F.col(U) == F.col("_u")) & (F.col("event_timestamp") == F.col("_last")))
    return (hit.groupBy(L).agg(F.count("*").alias("users_dropped"))
            .orderBy(F.col("users_dropped").desc(), F.col(L).asc_nulls_first()))


def fails_by_user_level(df: DataFrame) -> DataFrame:
    """Failed plays per (user, level): what D03 and the churn profile derive from."""
    return df.groupBy(U, L).agg(F.count_if(F.col("is_success") == FAIL).alias("_fails"))


def highest_levels(by_level: DataFrame) -> DataFrame:
    """Per highest level: users whose highest it is, and their failed plays there.
    A NULL user counts among the users, as in D01, but its plays do not count."""
    top = by_level.groupBy(U).agg(F.max(F.struct(F.col(L), F.col("_fails"))).alias("_top"))
    return (top.groupBy(F.col("_top")[L].alias("max_level"))
            .agg(F.count("*").alias("dropped_users"),
                 F.sum(F.when(F.col(U).isNotNull(), F.col("_top")["_fails"])).alias("fail_events")))


def dropoff_fail_at_max_level(df: DataFrame) -> DataFrame:
    """Failed plays at each user's highest level, per level."""
    tops = highest_levels(fails_by_user_level(df))
    return (tops.where("max_level is not null and fail_events > 0").select(F.col("max_level").alias(L), "fail_events")
            .orderBy(F.col("fail_events").desc(), F.col(L).asc_nulls_first()))
