"""Missing categorical attributes.

The reference fills each column in three UPDATEs: from the same
(user, session), then the user's most frequent value, then the global most
frequent value, each step seeing the previous one's result. Here all three
lookups come from one partial aggregate at (user, session, values)
granularity, and rows with a gap are joined once to a (user, session)
lookup; rows without gaps pass through unshuffled.

Ties: a session with several values gives the smallest; equal counts give
the smallest value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlens.session import stage_table

USER = "user_id"
SESSION = "session_id"
LEVELS = ("session", "user", "global")
ATTRIBUTES = ("app_version", "game_mode", "mobile_brand_name")


def _top(counts: DataFrame, by: list[str], value: str, weight: str, out: str) -> DataFrame:
    """Most frequent ``value`` per ``by`` (ties -> smallest value)."""
    w = Window.partitionBy(*by).orderBy(F.col(weight).desc(), F.col(value).asc())
    return (counts.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") == 1)
            .select(*by, F.col(value).alias(out)))


def _null_safe_keys(prefix: str):
    """(user, session) as four plain equi-join keys that also match NULLs."""
    return [F.coalesce(F.col(USER), F.lit(0)).alias(f"{prefix}0"), F.col(USER).isNull().alias(f"{prefix}1"),
            F.coalesce(F.col(SESSION), F.lit(0)).alias(f"{prefix}2"), F.col(SESSION).isNull().alias(f"{prefix}3")]


def fill_cascade(df: DataFrame, cols=ATTRIBUTES, levels=LEVELS) -> DataFrame:
    """Fill NULLs of each column in ``cols`` by the ``levels`` in order.

    The columns are stacked into (user, session, attribute, value) and
    counted - a partial aggregate, so a hot user or session shrinks to its
    distinct values map-side. From those counts:

    * session value: smallest value of the (user, session, attribute);
    * user mode: counts after the session fill, per (user, attribute);
    * global mode: counts after the user fill, per attribute.

    Rows with a gap are then joined once to a (user, session) lookup.
    """
    cols = list(cols)
    vtype = df.schema[cols[0]].dataType
    out_cols = df.columns
    idx = {c: i for i, c in enumerate(cols)}
    stacked = df.select(USER, SESSION, F.inline(F.array(*[
        F.struct(F.lit(i).alias("_a"), F.col(c).cast(vtype).alias("_v")) for c, i in idx.items()])))
    counts = stacked.groupBy(USER, SESSION, "_a", "_v").agg(F.count("*").alias("_n"))
    # Read by several branches below; materialised once (it is an
    # aggregate, far smaller than the events) instead of re-scanning.
    counts = stage_table(counts, "attribute_counts")

    null_v = F.lit(None).cast(vtype)
    keyed = F.col(USER).isNotNull() & F.col(SESSION).isNotNull()
    if "session" in levels:
        session_min = F.min("_v").over(Window.partitionBy(USER, SESSION, "_a"))
        counts = counts.withColumn("_s", F.when(keyed, session_min).otherwise(null_v))
    else:
        counts = counts.withColumn("_s", null_v)
    after_session = F.coalesce(F.col("_v"), F.col("_s"))

    if "user" in levels:
        per_user = (counts.where(F.col(USER).isNotNull()).select(USER, "_a", after_session.alias("_e"), "_n")
                    .where(F.col("_e").isNotNull()).groupBy(USER, "_a", "_e").agg(F.sum("_n").alias("_w")))
        counts = counts.join(_top(per_user, [USER, "_a"], "_e", "_w", "_u"), [USER, "_a"], "left")
    else:
        counts = counts.withColumn("_u", null_v)
    after_user = F.coalesce(F.col("_v"), F.col("_s"), F.col("_u"))

    if "global" in levels:
        per_attr = (counts.select("_a", after_user.alias("_e"), "_n").where(F.col("_e").isNotNull())
                    .groupBy("_a", "_e").agg(F.sum("_n").alias("_w")))
        # At most one row per attribute column: a broadcast with a fixed bound.
        top = F.broadcast(_top(per_attr, ["_a"], "_e", "_w", "_g"))
        counts = counts.join(top, "_a", "left")
    else:
        counts = counts.withColumn("_g", null_v)
    final = F.coalesce(F.col("_s"), F.col("_u"), F.col("_g"))

    # One lookup row per (user, session); NULL ids are keys of their own.
    lookup = counts.groupBy(*_null_safe_keys("_l")).agg(
        *[F.max(F.when(F.col("_a") == i, final)).alias(f"_f{i}") for i in idx.values()])
    gap = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])
    complete = df.where(~gap)
    holes = df.where(gap)
    keyed_holes = holes.select("*", *_null_safe_keys("_h"))
    cond = reduce(lambda a, b: a & b, [F.col(f"_h{i}") == F.col(f"_l{i}") for i in range(4)])
    filled = keyed_holes.join(lookup, cond, "left").select(
        *[F.coalesce(F.col(c), F.col(f"_f{idx[c]}")).alias(c) if c in idx else F.col(c) for c in out_cols])
    return complete.unionByName(filled)


def fill_mode_for_entity(df: DataFrame, entity_col: str, entity, col: str) -> DataFrame:
    """NULL ``col`` of one entity <- that entity's most frequent value
    (ties -> smallest). The mode is a scalar subquery over the entity's rows."""
    mode = (df.where((F.col(entity_col) == F.lit(entity)) & F.col(col).isNotNull())
            .groupBy(col).agg(F.count("*").alias("_n"))
            .orderBy(F.col("_n").desc(), F.col(col).asc()).limit(1).select(col).scalar())
    hit = (F.col(entity_col) == F.lit(entity)) & F.col(col).isNull()
    return df.withColumn(col, F.when(hit, mode).otherwise(F.col(col)))
