"""The five output tables (M01-M05) and their writer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlens.functions.columns import ratio, round6
from playlens.model import FAIL, LEVEL_START, SUCCESS, TABLE_KEYS
from playlens.plans.difficulty import level_stats
from playlens.plans.dropoff import level_dropoff as _level_dropoff
from playlens.sources.tableset import TableSet

S, T, L, U = "is_success", "time_played", "level", "user_id"


def game_events_clean(clean: DataFrame) -> DataFrame:
    """M01."""
    return clean


def level_dropoff(clean: DataFrame) -> DataFrame:
    """M02."""
    return _level_dropoff(clean)


def level_difficulty(clean: DataFrame) -> DataFrame:
    """Level, fail_rate, avg_playtime, max_playtime, avg_attempts."""
    return level_stats(clean, with_max_playtime=True).select(
        L, "fail_rate", "avg_playtime", "max_playtime", "avg_attempts")


def user_progression(clean: DataFrame) -> DataFrame:
    """M04."""
    return clean.groupBy(U).agg(F.max(L).alias("max_level"), F.count("*").alias("total_events"),
                                F.countDistinct("session_id").alias("total_sessions"),
                                F.count_if(F.col(S) == FAIL).alias("total_failures"),
                                F.count_if(F.col(S) == SUCCESS).alias("total_successes"))


def level_summary(clean: DataFrame) -> DataFrame:
    """Per level totals plus the drop-off rate of M02 and the fail rate
    and average starts of M03.

    The reference joins the events to M02 and M03 and groups; here one
    aggregate per player and level, rolled up to levels, carries everything M02 and M03
    derive from (players reached = unique players, outcome/duration/start counts: two
    distinct counts without a multiplied row) and one per-player maximum gives the
    drop-offs: two scans instead of four.
    Levels that M03 lacks (no outcome, duration or start; the NULL level)
    get NULL fail rate and average starts, and the NULL level a NULL
    drop-off rate, as the left joins give.
    """
    start = F.col("event_name") == LEVEL_START
    visits = clean.groupBy(L, U).agg(
        F.count("*").alias("_n"), F.sum(T).alias("_time"), F.count(T).alias("_nt"), F.count(S).alias("_ns"),
        F.count_if(F.col(S) == SUCCESS).alias("_won"), F.count_if(F.col(S) == FAIL).alias("_lost"), F.count_if(start).alias("_starts"))
    total = {c: F.sum(c) for c in ("_n", "_time", "_nt", "_ns", "_won", "_lost", "_starts")}
    # A row per player and level: rows count players, and the NULL player is one of those who started.
    per_level = visits.groupBy(L).agg(
        total["_n"].alias("total_attempts"),
        F.count(U).alias("unique_users"),
        round6(F.try_divide(total["_time"], total["_nt"])).alias("avg_playtime"),
        ratio(total["_won"], total["_ns"]).alias("success_rate"),
        ratio(total["_lost"], total["_ns"]).alias("_fail_rate"),
        total["_ns"].alias("_ns"), total["_nt"].alias("_nt"), total["_starts"].alias("_starts"),
        F.count_if(F.col("_starts") > 0).alias("_players"))
    dropped = (clean.groupBy(U).agg(F.max(L).alias("_ml")).groupBy("_ml")
               .agg(F.count("*").alias("_dropped")))
    j = per_level.join(dropped, per_level[L] == dropped["_ml"], "left")
    in_m03 = F.col(L).isNotNull() & (F.col("_ns") > 0) & (F.col("_nt") > 0) & (F.col("_starts") > 0)
    return j.select(
        L, "total_attempts", "unique_users", "avg_playtime", "success_rate",
        # The NULL level never joins M02's rows.
        F.when(F.col(L).isNotNull(), ratio(F.coalesce(F.col("_dropped"), F.lit(0)), F.col("unique_users")))
        .alias("dropoff_rate"),
        F.when(in_m03, F.col("_fail_rate")).alias("fail_rate"),
        F.when(in_m03, ratio(F.col("_starts"), F.col("_players"))).alias("avg_attempts"))


def build_marts(clean: DataFrame) -> dict[str, DataFrame]:
    dropoff = level_dropoff(clean)
    difficulty = level_difficulty(clean)
    return {
        "game_events_clean": clean,
        "level_dropoff": dropoff,
        "level_difficulty": difficulty,
        "user_progression": user_progression(clean),
        "level_summary": level_summary(clean),
    }


def preview(tables: dict[str, DataFrame], n: int = 10) -> dict[str, DataFrame]:
    """The first ``n`` rows of each output table by its key (a top-k,
    planned as TakeOrderedAndProject)."""
    return {name: df.orderBy(*[F.col(k).asc_nulls_first() for k in TABLE_KEYS[name]]).limit(n)
            for name, df in tables.items()}


def write_marts(clean: DataFrame, root: str, fmt: str = "parquet") -> dict[str, str]:
    """Replace the output tables under ``root``, all together once all are written
    (see ``sources.tableset``); the folder of each."""
    return TableSet(clean.sparkSession, root).write(build_marts(clean), fmt)


def read_marts(spark: SparkSession, root: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The current output tables under ``root``."""
    return TableSet(spark, root).read(fmt)
