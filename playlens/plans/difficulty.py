"""Level difficulty (F01-F06) over the clean table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlens.functions.columns import ratio, round6
from playlens.model import FAIL, LEVEL_START, SCORE_WEIGHTS
from playlens.plans.dropoff import level_dropoff
from playlens.plans.eda import fail_rate_by_level, playtime_by_level, user_level_attempts

S, T, L, U = "is_success", "time_played", "level", "user_id"


def difficulty_fail_rate(df: DataFrame) -> DataFrame:
    """F01 (same view as E09)."""
    return fail_rate_by_level(df)


def difficulty_avg_retries(df: DataFrame) -> DataFrame:
    """F02."""
    return (user_level_attempts(df).groupBy(L)
            .agg(round6(F.avg("attempts")).alias("avg_attempts"), F.max("attempts").alias("max_attempts"))
            .orderBy(F.col("avg_attempts").desc(), F.col(L).asc_nulls_first()))


def difficulty_avg_playtime(df: DataFrame) -> DataFrame:
    """F03 (same view as E10)."""
    return playtime_by_level(df)


def level_stats(df: DataFrame, with_max_playtime: bool = False) -> DataFrame:
    """Fail rate, average (and max) playtime and average starts per player of
    every level that has an outcome, a duration and a start - the three
    aggregates the reference joins, computed in one pass.

    Average starts per player = starts / players with a start, where rows
    without a player id count as one more player (GROUP BY keeps NULL)."""
    start = F.col("event_name") == LEVEL_START
    aggs = [ratio(F.count_if(F.col(S) == FAIL), F.count(S)).alias("fail_rate"),
            round6(F.avg(T)).alias("avg_playtime")]
    if with_max_playtime:
        aggs.append(F.max(T).alias("max_playtime"))
    aggs += [F.count(S).alias("_ns"), F.count(T).alias("_nt"),
             F.count_if(start).alias("_starts"),
             F.countDistinct(F.when(start, F.col(U))).alias("_players"),
             F.max(F.when(start & F.col(U).isNull(), 1).otherwise(0)).alias("_null_player")]
    g = df.where(F.col(L).isNotNull()).groupBy(L).agg(*aggs)
    g = g.where((F.col("_ns") > 0) & (F.col("_nt") > 0) & (F.col("_starts") > 0))
    avg_attempts = ratio(F.col("_starts"), F.col("_players") + F.col("_null_player"))
    return g.withColumn("avg_attempts", avg_attempts).drop("_ns", "_nt", "_starts", "_players", "_null_player")


def difficulty_combined(df: DataFrame) -> DataFrame:
    """F06."""
    return level_stats(df).orderBy(F.col("fail_rate").desc(), F.col("avg_attempts").desc(),
                                   F.col("avg_playtime").desc(), L)


def _minmax(col: str):
    # Bounds over the per-level table (one row per level): a window over
    # that small aggregate, not another scan of the events.
    everything = Window.partitionBy()
    lo, hi = F.min(col).over(everything), F.max(col).over(everything)
    return F.when(hi > lo, (F.col(col) - lo) / (hi - lo)).otherwise(F.lit(0.0))


def difficulty_score(df: DataFrame) -> DataFrame:
    """0.4 fail_rate + 0.3 normalised retries + 0.2 normalised playtime
    + 0.1 drop-off rate. Normalisation is min-max over the scored levels
    (0 when all are equal); the reference states the formula only."""
    stats = level_stats(df).join(level_dropoff(df).select(L, "dropoff_rate"), L)
    w = SCORE_WEIGHTS
    normed = stats.select(L, "fail_rate", "dropoff_rate",
                          _minmax("avg_attempts").alias("_nr"), _minmax("avg_playtime").alias("_np"))
    score = (w["fail_rate"] * F.col("fail_rate") + w["retries"] * F.col("_nr")
             + w["playtime"] * F.col("_np") + w["dropoff"] * F.col("dropoff_rate"))
    return normed.select(L, "fail_rate", round6(F.col("_nr")).alias("normalized_retries"),
                         round6(F.col("_np")).alias("normalized_playtime"), "dropoff_rate",
                         round6(score).alias("difficulty_score"))
