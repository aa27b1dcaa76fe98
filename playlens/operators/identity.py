"""Missing player ids.

All fills work on the rows with a NULL ``user_id`` (a small share) against
aggregates of the known rows; known rows pass through untouched and are
never shuffled for a fill.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.operators.asof import nearest_by_time
from playlens.operators.ranking import dense_rank_global
from playlens.session import measured_stage

USER = "user_id"
SESSION = "session_id"
TS = "event_timestamp"


def _split(df: DataFrame):
    return df.where(F.col(USER).isNotNull()), df.where(F.col(USER).isNull())


def null_user_matches(df: DataFrame) -> DataFrame:
    """How each NULL-user row of a session pairs with the known users of
    that session, as (session_id, matched_user_id, null_rows, known_rows,
    pairs). ``pairs = null_rows * known_rows`` is the number of rows the
    reference's n x m self-join lists; the pairs themselves are not emitted.
    """
    nulls = (df.where(F.col(USER).isNull() & F.col(SESSION).isNotNull())
             .groupBy(SESSION).agg(F.count("*").alias("null_rows")))
    known = (df.where(F.col(USER).isNotNull() & F.col(SESSION).isNotNull())
             .groupBy(SESSION, USER).agg(F.count("*").alias("known_rows")))
    return (nulls.join(known, SESSION)
            .select(SESSION, F.col(USER).alias("matched_user_id"), "null_rows", "known_rows",
                    (F.col("null_rows") * F.col("known_rows")).alias("pairs")))


def ambiguous_sessions(df: DataFrame) -> DataFrame:
    """Sessions with more than one distinct known user."""
    return (df.where(F.col(USER).isNotNull()).groupBy(SESSION)
            .agg(F.countDistinct(USER).alias("distinct_users"))
            .where(F.col("distinct_users") > 1))


def _single_user_sessions(known: DataFrame) -> DataFrame:
    return (known.where(F.col(SESSION).isNotNull()).groupBy(SESSION)
            .agg(F.min(USER).alias("_lo"), F.max(USER).alias("_hi"))
            .where(F.col("_lo") == F.col("_hi"))
            .select(SESSION, F.col("_lo").alias("_fill")))


def _apply(nulls: DataFrame, lookup: DataFrame, key) -> DataFrame:
    cols = nulls.columns
    return (nulls.join(lookup, key, "left")
            .withColumn(USER, F.coalesce(F.col(USER), F.col("_fill"))).select(*cols))


def fill_user_single_session(df: DataFrame) -> DataFrame:
    """C11: a NULL user takes the only known user of its session."""
    known, nulls = _split(df)
    return known.unionByName(_apply(nulls, _single_user_sessions(known), SESSION))


def _fill_nearest(known: DataFrame, nulls: DataFrame, target_rows: int | None, rows: int | None = None) -> DataFrame:
    cols = nulls.columns
    eligible = F.col(SESSION).isNotNull() & F.col(TS).isNotNull()
    targets = nulls.where(eligible)
    rest = nulls.where(~eligible)
    sessions = targets.select(SESSION).distinct()
    cands = (known.where(eligible).select(SESSION, TS, USER)
             .join(sessions, SESSION, "left_semi"))
    filled = nearest_by_time(targets, cands, SESSION, TS, USER, "_fill", target_rows, rows)
    filled = filled.withColumn(USER, F.coalesce(F.col(USER), F.col("_fill"))).select(*cols)
    return filled.unionByName(rest)


def fill_user_nearest(df: DataFrame, target_rows: int | None = None) -> DataFrame:
    """A NULL user takes the known user of the same session whose event
    is nearest in time (either direction; equal distance -> smaller id).
    Rows without a timestamp, and known rows without one, take no part."""
    known, nulls = _split(df)
    return known.unionByName(_fill_nearest(known, nulls, target_rows))


def _fill_surrogate(nulls: DataFrame, rows: int | None = None) -> DataFrame:
    cols = nulls.columns
    ranks = dense_rank_global(nulls, SESSION, "_rank", rows=rows)
    lookup = ranks.select(SESSION, (-F.col("_rank")).alias("_fill"))
    return _apply(nulls, lookup, SESSION).select(*cols)


def fill_user_surrogate(df: DataFrame) -> DataFrame:
    """Remaining NULL users get a negative id per session, -1 for the
    smallest session id; a NULL session stays NULL."""
    known, nulls = _split(df)
    return known.unionByName(_fill_surrogate(nulls))


def repair_user_ids(df: DataFrame, target_rows: int | None = None, rows: int | None = None) -> DataFrame:
    """C11 -> C12 -> C13 in sequence, with the known rows read once."""
    return measured_user_ids(df, target_rows, rows)[0]


def measured_user_ids(df: DataFrame, target_rows: int | None = None, rows: int | None = None) -> tuple[DataFrame, dict | None]:
    """:func:`repair_user_ids` and how many rows had no player and how many still have none before C13.

    The rows that had no user (a small share) are materialised after C12,
    so ranking their sessions for C13 does not recompute C11 and C12; the write
    counts what is left, and without a row left there is no C13.
    """
    known, nulls = _split(df)
    step1 = _apply(nulls, _single_user_sessions(known), SESSION)
    done1, open1 = step1.where(F.col(USER).isNotNull()), step1.where(F.col(USER).isNull())
    after = done1.unionByName(_fill_nearest(known, open1, target_rows, rows))
    open_rows = F.col(USER).isNull()
    after, seen = measured_stage(after, "user_fill", {
        "rows_without_user": F.count("*"), "open_after_nearest": F.count_if(open_rows),
        "open_with_session": F.count_if(open_rows & F.col(SESSION).isNotNull())})
    if seen and not seen["open_with_session"]:
        return known.unionByName(after), seen
    done2, open2 = after.where(~open_rows), after.where(open_rows)
    filled = _fill_surrogate(open2, seen and seen["open_with_session"])
    return known.unionByName(done2).unionByName(filled), seen


def remaining_null_users(df: DataFrame) -> DataFrame:
    """C14."""
    return df.agg(F.count_if(F.col(USER).isNull()).alias("remaining_nulls"))
