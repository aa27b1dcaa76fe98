"""Datasets behind the dashboard visuals the reference names without SQL
(B01-B09). Each definition is ours; windows here run over per-level
aggregates (one row per level), never over events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlens.functions.columns import ratio, round6
from playlens.model import FAIL, MIN_ATTEMPTS, SUCCESS
from playlens.plans.dropoff import dropoff_last_event, fails_by_user_level, highest_levels
from playlens.plans.marts import user_progression
from playlens.operators.profile import missingness_patterns  # noqa: F401  (B09)
from playlens.session import stage_table

S, T, L, U = "is_success", "time_played", "level", "user_id"


def retention_funnel(clean: DataFrame) -> DataFrame:
    """Per level, players whose highest level is at or beyond it, as a
    share of all players and of the previous level."""
    prog = user_progression(clean).where(F.col(U).isNotNull())
    per_max = prog.where(F.col("max_level").isNotNull()).groupBy("max_level").agg(F.count("*").alias("_n"))
    levels = clean.where(F.col(L).isNotNull()).select(L).distinct()
    counts = levels.join(per_max, levels[L] == per_max["max_level"], "left").select(
        L, F.coalesce(F.col("_n"), F.lit(0)).alias("_n"))
    totals = prog.agg(F.count("*").alias("_total"))
    down = Window.orderBy(F.col(L).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up = Window.orderBy(L)
    reached = counts.select(L, F.sum("_n").over(down).cast("long").alias("users_reached"))
    return reached.select(
        L, "users_reached",
        ratio(F.col("users_reached"), totals.scalar()).alias("share_of_all"),
        ratio(F.col("users_reached"), F.lag("users_reached").over(up)).alias("share_of_previous"))


def churn_profile(clean: DataFrame) -> DataFrame:
    """The three drop-off definitions side by side per level, two of them
    from one (user, level) aggregate."""
    by_level = fails_by_user_level(clean)
    levels = by_level.where(F.col(L).isNotNull()).select(L).distinct()
    tops = highest_levels(by_level).withColumnRenamed("max_level", L)
    last = dropoff_last_event(clean)
    out = levels.join(tops, L, "left").join(last, L, "left")
    return out.select(L, *[F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x)
                           for x in ("dropped_users", "users_dropped", "fail_events")])


def fail_rate_trend(clean: DataFrame) -> DataFrame:
    """Fail rate per level and its change from the previous level."""
    per = (clean.where(F.col(L).isNotNull() & F.col(S).isNotNull()).groupBy(L)
           .agg(ratio(F.count_if(F.col(S) == FAIL), F.count(S)).alias("fail_rate"),
                F.count("*").alias("total_attempts")))
    prev = F.lag("fail_rate").over(Window.orderBy(L))
    return per.select(L, "fail_rate", "total_attempts", prev.alias("prev_fail_rate"),
                      round6(F.col("fail_rate") - prev).alias("fail_rate_change"))


def difficulty_spikes(clean: DataFrame, min_attempts: int = MIN_ATTEMPTS, k: float = 1.0) -> DataFrame:
    """Levels whose fail rate exceeds mean + k * stddev_pop over the
    levels with at least ``min_attempts`` known outcomes."""
    per = (clean.where(F.col(L).isNotNull() & F.col(S).isNotNull()).groupBy(L)
           .agg((F.count_if(F.col(S) == FAIL) / F.count(S)).alias("_fr"), F.count("*").alias("total_attempts"))
           .where(F.col("total_attempts") >= min_attempts))
    everything = Window.partitionBy()
    threshold = F.avg("_fr").over(everything) + k * F.stddev_pop("_fr").over(everything)
    return (per.select(L, "_fr", "total_attempts", threshold.alias("_th"))
            .where(F.col("_fr") > F.col("_th"))
            .select(L, round6(F.col("_fr")).alias("fail_rate"), "total_attempts",
                    round6(F.col("_th")).alias("spike_threshold")))


SEGMENTS = ("device_category", "operating_system", "country")


def segment_metrics(clean: DataFrame) -> DataFrame:
    """Events, players, success rate and playtime per device category,
    operating system and country.

    The events are read once and counted per player and combination of segments, which is
    little more than a row per player, and staged; each segment rolls up from there,
    so no event is multiplied for the three groupings or for the distinct players.
    """
    players = stage_table(clean.groupBy(U, *SEGMENTS).agg(
        F.count("*").alias("_n"), F.count_if(F.col(S) == SUCCESS).alias("_won"), F.count(S).alias("_known"),
        F.sum(T).alias("_time"), F.count(T).alias("_timed")), "player_segments")

    def rolled(segment: str) -> DataFrame:
        sums = ["_n", "_won", "_known", "_time", "_timed"]
        by_player = players.groupBy(segment, U).agg(*[F.sum(c).alias(c) for c in sums])
        total = by_player.groupBy(segment).agg(F.count(U).alias("total_users"), *[F.sum(c).alias(c) for c in sums])
        return total.select(
            F.lit(segment).alias("segment_type"), F.col(segment).alias("segment_value"), F.col("_n").alias("total_events"), "total_users",
            ratio(F.col("_won"), F.col("_known")).alias("success_rate"),
            round6(F.try_divide("_time", "_timed")).alias("avg_playtime"))

    return reduce(DataFrame.unionByName, map(rolled, SEGMENTS))


def progression_overview(clean: DataFrame) -> DataFrame:
    """Players by highest level reached, with their average events and
    sessions."""
    return (user_progression(clean).groupBy("max_level")
            .agg(F.count("*").alias("users"), round6(F.avg("total_events")).alias("avg_events"),
                 round6(F.avg("total_sessions")).alias("avg_sessions")))
