"""Level timeline and level inference.

Ordinary users take one window per user: one shuffle of their rows. Users above
the target row count are cut into ranges of rows (see ``buckets``); the first and
last row of a range take their outer neighbour from a summary with the first and
last event of each range, so a very active user is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlens.functions.columns import level_gap_pick
from playlens.model import SUCCESS, FAIL, TIMELINE_ORDER
from playlens.operators.buckets import split_hot
from playlens.session import measured_stage, staging

USER = "user_id"
USER_KEYS = ["_uk", "_un"]
KEYS = [*USER_KEYS, "_b"]


def null_level_backup(df: DataFrame) -> DataFrame:
    """Snapshot of the rows without a level (written by the pipeline's
    sink before any level is dropped or inferred)."""
    return df.where(F.col("level").isNull())


def drop_isolated_null_level(df: DataFrame) -> DataFrame:
    """Delete level-less rows of users that have exactly one event.
    A NULL user never matches."""
    singles = (df.where(F.col(USER).isNotNull()).groupBy(USER).agg(F.count("*").alias("_n"))
               .where(F.col("_n") == 1).select(USER))
    nulls = df.where(F.col("level").isNull())
    return df.where(F.col("level").isNotNull()).unionByName(nulls.join(singles, USER, "left_anti"))


def _order() -> list:
    return [F.col(c).asc_nulls_first() for c in TIMELINE_ORDER]


def _neighbours(rows: DataFrame, part: list[str]) -> DataFrame:
    """Add the neighbours within ``part``: _pl, _ps, _nl; _hp / _hn are NULL at its ends."""
    w = Window.partitionBy(*part).orderBy(*_order())
    return rows.select(
        "*",
        F.lag(F.lit(1)).over(w).alias("_hp"),
        F.lead(F.lit(1)).over(w).alias("_hn"),
        F.lag("level").over(w).alias("_pl"),
        F.lag("is_success").over(w).alias("_ps"),
        F.lead("level").over(w).alias("_nl"),
    )


def _across_ranges(rows: DataFrame) -> DataFrame:
    """The neighbours of hot users' rows, over the ends of their ranges."""
    ev = F.struct(*[F.col(c) for c in TIMELINE_ORDER])
    by_range = Window.partitionBy(*USER_KEYS).orderBy("_b")
    ends = (rows.groupBy(*KEYS).agg(F.min(ev).alias("_first"), F.max(ev).alias("_last"))
            .select(*KEYS, F.lag("_last").over(by_range).alias("_plast"), F.lead("_first").over(by_range).alias("_nfirst")))
    at_start, at_end = F.col("_hp").isNull(), F.col("_hn").isNull()
    inner = _neighbours(rows, KEYS)
    edges = inner.where(at_start | at_end).join(ends, KEYS, "left").withColumns({
        "_pl": F.when(at_start, F.col("_plast.level")).otherwise(F.col("_pl")),
        "_ps": F.when(at_start, F.col("_plast.is_success")).otherwise(F.col("_ps")),
        "_nl": F.when(at_end, F.col("_nfirst.level")).otherwise(F.col("_nl")),
    }).drop("_plast", "_nfirst")
    return inner.where(~(at_start | at_end)).unionByName(edges).drop("_b")


def _named(found: DataFrame) -> DataFrame:
    return found.withColumnsRenamed({"_pl": "prev_level", "_ps": "prev_success", "_nl": "next_level"})


def level_timeline(df: DataFrame, target_rows: int | None = None, with_user_rows: bool = False,
                   known_rows: int | None = None) -> DataFrame:
    """Previous level, previous outcome and next level of each event in
    its user's order (timestamp, batch index, then the remaining columns);
    immediate neighbours, NULLs not skipped, across sessions. Runs a job that
    counts the users' rows, unless ``known_rows`` says that ``df`` is small."""
    cols = df.columns
    # NULL user ids form their own group, NULL timestamps sort first.
    keyed = df.withColumns({"_uk": F.coalesce(F.col(USER), F.lit(0).cast("long")), "_un": F.col(USER).isNull()})
    ordinary, hot = split_hot(keyed, USER_KEYS, _order(), "_b", target_rows, known_rows)
    found = _neighbours(ordinary, USER_KEYS)
    rows = F.lit(None).cast("long")
    if with_user_rows:
        found = found.withColumn("_user_rows", F.count("*").over(Window.partitionBy(*USER_KEYS)))
    if hot is not None:
        across = _across_ranges(hot)
        found = found.unionByName(across.withColumn("_user_rows", rows) if with_user_rows else across)
    return _named(found).select(*cols, "prev_level", "prev_success", "next_level", *(["_user_rows"] if with_user_rows else []))


def _inferred(preview: bool):
    p, s, n = F.col("prev_level"), F.col("prev_success"), F.col("next_level")
    case4 = level_gap_pick(p, n, F.col("event_timestamp"), F.col(USER), F.col("batch_event_index"))
    expr = F.when(p == n, p).when((s == SUCCESS) & (n == p + 1), p + 1)
    if preview:
        # Looser case 3 of the preview: after a fail (or unknown) stay.
        expr = expr.when((s == FAIL) | s.isNull(), p)
    # The update's case 3 also requires next = prev, which case 1 already
    # took, so it never fires and is left out.
    expr = expr.when(p.isNotNull() & n.isNotNull() & (F.abs(n - p) > 1), case4)
    return F.when(F.col("level").isNull(), expr)


ROW = "_row_id"
#: What decides a neighbour's place but for ties.
PLACE = ["event_timestamp", "batch_event_index"]


def with_row_id(df: DataFrame) -> DataFrame:
    """Number the rows; the numbers hold once the result is written as a stage table."""
    return df.withColumn(ROW, F.monotonically_increasing_id())


def _is_isolated():
    """The only event of a known user, without a level."""
    return F.col("level").isNull() & F.col(USER).isNotNull() & (F.coalesce(F.col("_user_rows"), F.lit(2)) == 1)


def _infer_wide(df: DataFrame, target_rows: int | None, drop_isolated: bool, rows: int | None) -> DataFrame:
    """C29 with whole rows in the window: for tables whose rows have no numbers."""
    cols = df.columns
    tl = level_timeline(df, target_rows, drop_isolated, rows)
    if drop_isolated:
        tl = tl.where(~_is_isolated())
    return tl.withColumn("level", F.coalesce(F.col("level"), _inferred(False).cast("int"))).select(*cols)


def _decided(tl: DataFrame, *more) -> DataFrame:
    """Inferred level of the rows without one, and whether C27 deletes them."""
    return tl.where(F.col("level").isNull()).select(
        ROW, *USER_KEYS, _inferred(False).cast("int").alias("_inferred"), _is_isolated().alias("_isolated"), *more)


def _narrow_timeline(rows: DataFrame) -> DataFrame:
    """Timeline by time and batch index alone (of outcomes only success is known), with ``_tied``: a neighbour could be another
    row if the remaining order columns were looked at."""
    w = Window.partitionBy(*USER_KEYS).orderBy(*[F.col(c).asc_nulls_first() for c in PLACE])
    offsets = {-2: "_b2", -1: "_b1", 1: "_a1", 2: "_a2"}
    # Plain columns only: a struct or a repeated key would be worked out, and shipped, before the shuffle.
    found = rows.select(
        "*", F.lag("level").over(w).alias("prev_level"), F.lag("_won").over(w).alias("_pw"), F.lead("level").over(w).alias("next_level"),
        *[F.lead(c, k).over(w).alias(f"{name}_{c}") for k, name in offsets.items() for c in PLACE],
        F.row_number().over(w).alias("_at"), F.count("*").over(Window.partitionBy(*USER_KEYS)).alias("_user_rows"))

    def equal(one: str, two: str):
        return F.col(f"{one}{PLACE[0]}").eqNullSafe(F.col(f"{two}{PLACE[0]}")) & F.col(f"{one}{PLACE[1]}").eqNullSafe(F.col(f"{two}{PLACE[1]}"))

    at, n = F.col("_at"), F.col("_user_rows")
    tied = (((at > 2) & equal("_b2_", "_b1_")) | ((at > 1) & equal("_b1_", ""))
            | ((at < n) & equal("", "_a1_")) | ((at < n - 1) & equal("_a1_", "_a2_")))
    return found.withColumns({USER: F.when(~F.col("_un"), F.col("_uk")), "_tied": tied,
                              "prev_success": F.when(F.col("_pw"), F.lit(SUCCESS))})


def infer_level(df: DataFrame, target_rows: int | None = None, drop_isolated: bool = False,
                rows: int | None = None) -> DataFrame:
    """C29 (update variant): fill NULL levels from the neighbours; runs of
    NULLs and unmatched patterns stay NULL. With ``drop_isolated`` the C27
    deletion is applied in the same pass (it removes only the sole event of
    a user, which is nobody's neighbour).

    Only what the rules read goes through the window: time, batch index, level and
    outcome. Where two rows tie there and a neighbour of a row without a level could
    be either, that row's user is taken again with all order columns. What was decided
    for the rows without a level is joined to them by row number; rows with a level are
    never shuffled whole. ``df`` may bring the numbers (``with_row_id``, staged);
    otherwise it is staged with them. ``rows`` bounds its size, if the caller knows it.
    """
    if not staging():
        return _infer_wide(df, target_rows, drop_isolated, rows)
    cols = [c for c in df.columns if c != ROW]
    if ROW not in df.columns:
        df, seen = measured_stage(with_row_id(df), "numbered_rows", {"rows": F.count("*")})
        rows = seen["rows"]
    keys = {"_uk": F.coalesce(F.col(USER), F.lit(0).cast("long")), "_un": F.col(USER).isNull()}
    # Numbers of rows with a level are not needed; left out, they take no room in the shuffle.
    slim = df.select(USER, *TIMELINE_ORDER, F.when(F.col("level").isNull(), F.col(ROW)).alias(ROW)).withColumns(keys)
    ordinary, hot = split_hot(slim, USER_KEYS, _order(), "_b", target_rows, rows)
    won = F.col("is_success").eqNullSafe(SUCCESS).alias("_won")  # all that the update's rules ask of an outcome
    found = _decided(_narrow_timeline(ordinary.select(*USER_KEYS, ROW, *PLACE, "level", won)), "_tied")
    if hot is not None:
        found = found.unionByName(_decided(_named(_across_ranges(hot)).withColumn("_user_rows", F.lit(None).cast("long")),
                                           F.lit(False).alias("_tied")))
    found, seen = measured_stage(found, "inferred_levels", {"tied": F.count_if("_tied")})
    if seen["tied"]:
        users = found.where("_tied").select(*USER_KEYS).distinct()
        again = _neighbours(slim.join(users, USER_KEYS, "left_semi"), USER_KEYS)
        again = _decided(_named(again).withColumn("_user_rows", F.lit(None).cast("long"))).drop("_isolated")
        # An isolated row has no neighbours to tie with.
        found = (found.join(again.select(ROW, F.col("_inferred").alias("_resolved")), ROW, "left")
                 .withColumn("_inferred", F.when(F.col("_tied"), F.col("_resolved")).otherwise(F.col("_inferred"))))
    filled = df.where(F.col("level").isNull()).join(found.select(ROW, "_inferred", "_isolated"), ROW)
    if drop_isolated:
        filled = filled.where(~F.col("_isolated"))
    filled = filled.withColumn("level", F.col("_inferred")).select(*cols)
    return df.where(F.col("level").isNotNull()).select(*cols).unionByName(filled)


def infer_level_preview(df: DataFrame, target_rows: int | None = None) -> DataFrame:
    """Rows without a level for which the preview rules propose one."""
    tl = level_timeline(df, target_rows).withColumn("inferred_level", _inferred(True).cast("int"))
    return (tl.where(F.col("level").isNull() & F.col("inferred_level").isNotNull())
            .select(USER, "event_timestamp", "prev_level", "prev_success", "next_level", "inferred_level")
            .orderBy(F.col(USER).asc_nulls_first(), F.col("event_timestamp").asc_nulls_first()))
