"""Exploratory metrics (E01-E11) over the clean table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.functions.columns import ratio, round6
from playlens.model import FAIL, LEVEL_START, MIN_ATTEMPTS, SUCCESS, TOP_COUNTRIES

S, T, L, U = "is_success", "time_played", "level", "user_id"


def dataset_overview(df: DataFrame) -> DataFrame:
    """E01. Each distinct count is a subquery that reads its own column and shuffles
    its distinct values; counted together, every row would be multiplied by five."""
    counted = {"total_users": U, "total_sessions": "session_id", "total_levels": L, "total_countries": "country",
               "total_app_versions": "app_version"}
    return df.agg(F.count("*").alias("total_events")).select("total_events", *[
        df.select(c).distinct().agg(F.count(c)).scalar().alias(name) for name, c in counted.items()])


def _count_by(df: DataFrame, col: str, out: str = "total_events") -> DataFrame:
    return df.groupBy(col).agg(F.count("*").alias(out))


def event_distribution(df: DataFrame) -> DataFrame:
    """E02."""
    return _count_by(df, "event_name").orderBy(F.col("total_events").desc(), "event_name")


def success_rate(df: DataFrame) -> DataFrame:
    """E03."""
    known = df.where(F.col(S).isNotNull())
    return known.agg(ratio(F.count_if(F.col(S) == SUCCESS), F.count(S)).alias("success_rate"))


def playtime_stats(df: DataFrame) -> DataFrame:
    """E04."""
    known = df.where(F.col(T).isNotNull())
    return known.agg(F.min(T).alias("min_time"), F.max(T).alias("max_time"),
                     round6(F.avg(T)).alias("avg_time"))


def top_countries(df: DataFrame, n: int = TOP_COUNTRIES) -> DataFrame:
    """Top ``n`` countries by distinct users (ties -> country, NULL first)."""
    return (df.groupBy("country").agg(F.countDistinct(U).alias("total_users"))
            .orderBy(F.col("total_users").desc(), F.col("country").asc_nulls_first()).limit(n))


def device_distribution(df: DataFrame) -> DataFrame:
    """E06."""
    return _count_by(df, "device_category").orderBy(F.col("total_events").desc(), "device_category")


def level_distribution(df: DataFrame) -> DataFrame:
    """E07."""
    return _count_by(df, L, "total_attempts").orderBy(F.col(L).asc_nulls_first())


def user_level_attempts(df: DataFrame) -> DataFrame:
    """Starts per (user, level); the base of the retry metrics."""
    return (df.where(F.col("event_name") == LEVEL_START).groupBy(U, L)
            .agg(F.count("*").alias("attempts")))


def retries_per_level(df: DataFrame) -> DataFrame:
    """E08."""
    return (user_level_attempts(df).groupBy(L)
            .agg(round6(F.avg("attempts")).alias("avg_attempts_per_user"),
                 F.max("attempts").alias("max_attempts"), F.min("attempts").alias("min_attempts"))
            .orderBy(F.col(L).asc_nulls_first()))


def fail_rate_by_level(df: DataFrame, min_attempts: int = MIN_ATTEMPTS) -> DataFrame:
    """Levels with at least ``min_attempts`` known outcomes."""
    return (df.where(F.col(S).isNotNull()).groupBy(L)
            .agg(ratio(F.count_if(F.col(S) == FAIL), F.count(S)).alias("fail_rate"),
                 F.count("*").alias("total_attempts"))
            .where(F.col("total_attempts") >= min_attempts)
            .orderBy(F.col("fail_rate").desc(), F.col(L).asc_nulls_first()))


def playtime_by_level(df: DataFrame, min_attempts: int = MIN_ATTEMPTS) -> DataFrame:
    """E10 / F03."""
    return (df.where(F.col(T).isNotNull()).groupBy(L)
            .agg(round6(F.avg(T)).alias("avg_playtime"), F.max(T).alias("max_playtime"),
                 F.count("*").alias("total_attempts"))
            .where(F.col("total_attempts") >= min_attempts)
            .orderBy(F.col("avg_playtime").desc(), F.col(L).asc_nulls_first()))


def fail_and_playtime(df: DataFrame) -> DataFrame:
    """Fail rate and average playtime of levels that have both, from one
    conditional aggregate instead of two scans and a join."""
    return (df.where(F.col(L).isNotNull()).groupBy(L)
            .agg(ratio(F.count_if(F.col(S) == FAIL), F.count(S)).alias("fail_rate"),
                 round6(F.avg(T)).alias("avg_playtime"),
                 F.count(S).alias("_ns"), F.count(T).alias("_nt"))
            .where((F.col("_ns") > 0) & (F.col("_nt") > 0)).drop("_ns", "_nt")
            .orderBy(F.col("fail_rate").desc(), F.col("avg_playtime").desc(), L))
