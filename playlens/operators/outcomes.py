"""Missing durations and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from playlens.functions.columns import round6
from playlens.model import SUCCESS, FAIL
from playlens.session import stage_table, staging

T = "time_played"
S = "is_success"
L = "level"


def _key_cols(keys: list[str], prefix: str):
    """Group keys as plain equi-join columns that also match NULL keys."""
    cols = []
    for i, k in enumerate(keys):
        cols += [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"{prefix}{i}v"),
                 F.col(k).isNull().alias(f"{prefix}{i}n")]
    return cols


#: Distinct values that one range of the median search should hold.
RANGE_ROWS = 1_000_000


def _median_in_groups(known: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """:func:`exact_median` by one window per group, for tables of a bounded size."""
    vc = known.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys).orderBy(value)
    vc = vc.select("*", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_end"),
                   F.sum("_c").over(Window.partitionBy(*keys)).alias("_n"))

    def at(pos: str):
        return F.min(F.when((F.col("_end") - F.col("_c") <= F.expr(pos)) & (F.expr(pos) < F.col("_end")), F.col(value)))

    picked = vc.groupBy(*keys).agg(at("(_n - 1) div 2").alias("_lo"), at("_n div 2").alias("_hi"))
    return picked.select(*keys, round6(F.col("_lo") + (F.col("_hi") - F.col("_lo")) * 0.5).alias(out))


def exact_median(df: DataFrame, keys: list[str], value: str, out: str, range_rows: int | None = None,
                 rows: int | None = None) -> DataFrame:
    """Exact PERCENTILE_CONT(0.5) of ``value`` per ``keys`` (NULL values
    ignored), rounded to 6 decimals.

    1. count rows per (keys, value) - a partial aggregate, so a hot group
       shrinks to its distinct values before any shuffle;
    2. range-partition the distinct values by (keys, value), with as many ranges
       as their estimated number asks for, and count rows per range;
    3. from running counts over the ranges (a few rows per group), keep only
       the one or two ranges holding the middle ranks, and find the exact
       middle values by a window over those ranges alone.

    A range holds about ``range_rows`` distinct values however many there are.
    Runs jobs while the plan is built: an estimate and the write of the ranges. Where
    the caller knows that ``df`` has at most ``rows`` rows and those fit one range, neither
    runs and a window per group does the same.
    """
    known = df.where(F.col(value).isNotNull())
    if rows is not None and rows <= (range_rows or RANGE_ROWS):
        return _median_in_groups(known, keys, value, out)
    distinct = known.agg(F.approx_count_distinct(F.struct(*keys, value))).first()[0]
    ranges = distinct // (range_rows or RANGE_ROWS) + 1 if staging() else 1
    vc = known.groupBy(*keys, value).agg(F.count("*").alias("_c")).select("*", *_key_cols(keys, "_g"))
    gk = [f"_g{i}{t}" for i in range(len(keys)) for t in "vn"]
    # Written once: the ranges come from a sample and both branches below must see the same.
    vc = stage_table(vc.repartitionByRange(ranges, *gk, value).withColumn("_r", F.spark_partition_id()), "median_values")

    per_range = vc.groupBy(*gk, "_r").agg(F.sum("_c").alias("_rc"))
    w = Window.partitionBy(*gk).orderBy("_r")
    per_range = per_range.select(
        *gk, "_r", "_rc",
        F.sum("_rc").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_rend"),
        F.sum("_rc").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_n"))
    lo, hi = F.expr("(_n - 1) div 2"), F.expr("_n div 2")

    def covers(pos, start, end):
        return (start <= pos) & (pos < end)

    rstart = F.col("_rend") - F.col("_rc")
    middle = (per_range.where(covers(lo, rstart, F.col("_rend")) | covers(hi, rstart, F.col("_rend")))
              .select(*gk, "_r", rstart.alias("_rstart"), "_n"))
    sub = vc.join(middle, gk + ["_r"])
    w2 = Window.partitionBy(*gk, "_r").orderBy(value)
    sub = sub.withColumn("_end", F.col("_rstart")
                         + F.sum("_c").over(w2.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    start = F.col("_end") - F.col("_c")
    picked = sub.groupBy(*gk).agg(*[F.first(k).alias(k) for k in keys],
                                  F.min(F.when(covers(lo, start, F.col("_end")), F.col(value))).alias("_lo"),
                                  F.min(F.when(covers(hi, start, F.col("_end")), F.col(value))).alias("_hi"))
    med = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * 0.5
    return picked.select(*keys, round6(med).alias(out))


def median_by_level_outcome(df: DataFrame, require_level: bool = True, rows: int | None = None) -> DataFrame:
    """Median duration per (level, is_success)."""
    src = df.where(F.col(T).isNotNull() & F.col(S).isNotNull())
    if require_level:
        src = src.where(F.col(L).isNotNull())
    return exact_median(src, [L, S], T, "median_time", rows=rows)


def success_fail_medians(df: DataFrame, medians: DataFrame | None = None) -> DataFrame:
    """Success and fail median per level, levels having both."""
    m = medians if medians is not None else median_by_level_outcome(df, require_level=False)
    return (m.where(F.col(L).isNotNull()).groupBy(L)
            .agg(F.max(F.when(F.col(S) == SUCCESS, F.col("median_time"))).alias("success_median"),
                 F.max(F.when(F.col(S) == FAIL, F.col("median_time"))).alias("fail_median"))
            .where(F.col("success_median").isNotNull() & F.col("fail_median").isNotNull()))


def _time_fill_targets():
    return F.col(T).isNull() & F.col(S).isNotNull()


def _outcome_targets():
    return F.col(S).isNull() & F.col(T).isNotNull()


def _closer_outcome(t, s_med, f_med):
    return F.when(F.abs(t - s_med) < F.abs(t - f_med), F.lit(SUCCESS)).otherwise(F.lit(FAIL))


def fill_time_played_median(df: DataFrame) -> DataFrame:
    """NULL duration with a known outcome <- median of the same level
    and outcome."""
    cols = df.columns
    m = median_by_level_outcome(df, require_level=True)
    tgt = df.where(_time_fill_targets())
    filled = tgt.join(m, [L, S], "left").withColumn(T, F.coalesce(F.col(T), F.col("median_time")))
    return df.where(~_time_fill_targets()).unionByName(filled.select(*cols))


def infer_is_success(df: DataFrame) -> DataFrame:
    """NULL outcome with a known duration <- the outcome whose median is
    strictly nearer (tie -> FALSE); levels lacking either median are skipped."""
    cols = df.columns
    sf = success_fail_medians(df)
    tgt = df.where(_outcome_targets())
    joined = tgt.join(sf, L, "left")
    inferred = F.when(F.col("success_median").isNotNull() & F.col("fail_median").isNotNull(),
                      _closer_outcome(F.col(T), F.col("success_median"), F.col("fail_median")))
    return df.where(~_outcome_targets()).unionByName(
        joined.withColumn(S, inferred).select(*cols))


def missing_time_rows(df: DataFrame) -> DataFrame:
    """C35."""
    return df.where(_time_fill_targets())


def missing_outcome_rows(df: DataFrame) -> DataFrame:
    """C36."""
    return df.where(_outcome_targets())


def _inconsistent():
    return F.col(T).isNull() != F.col(S).isNull()


def inconsistent_rows(df: DataFrame) -> DataFrame:
    """Exactly one of duration / outcome is NULL."""
    return df.where(_inconsistent()).orderBy(*[F.col(c).asc_nulls_first()
                                              for c in ("user_id", "event_timestamp", "batch_event_index")])


def outcome_null_counts(df: DataFrame) -> DataFrame:
    """C38."""
    return df.agg(F.count_if(F.col(T).isNull()).alias("null_time_played"),
                  F.count_if(F.col(S).isNull()).alias("null_is_success"))


def drop_inconsistent(df: DataFrame) -> DataFrame:
    """Rows with both NULL (unfinished plays) stay."""
    return df.where(~_inconsistent())


def outcome_checks() -> dict:
    """What the reference counts between its fills and the deletion."""
    return {
        "row_count": F.count("*"),
        "null_time_played": F.count_if(F.col(T).isNull()),
        "null_is_success": F.count_if(F.col(S).isNull()),
        "missing_time_rows": F.count_if(_time_fill_targets()),
        "missing_outcome_rows": F.count_if(_outcome_targets()),
        "inconsistent_rows": F.count_if(_inconsistent()),
    }


def fill_outcomes(df: DataFrame, rows: int | None = None) -> DataFrame:
    """C32 -> C34 in one pass; ``df`` has at most ``rows`` rows, if given.

    One median table serves both fills: the C32 fill adds copies of a
    group's own (rounded) median to that group, which leaves the rounded
    median unchanged, so C34's medians equal those before C32. Its rows become
    one row per level with the medians by outcome, joined once to the rows with a gap.
    """
    cols = df.columns
    medians = median_by_level_outcome(df, require_level=True, rows=rows)
    by_level = medians.groupBy(L).agg(F.map_from_entries(F.collect_list(F.struct(S, "median_time"))).alias("_medians"))
    gap = _time_fill_targets() | _outcome_targets()
    j = df.where(gap).join(by_level, L, "left")
    s_med, f_med = F.try_element_at("_medians", F.lit(SUCCESS)), F.try_element_at("_medians", F.lit(FAIL))
    t_new = F.coalesce(F.col(T), F.try_element_at("_medians", F.col(S)))
    s_new = F.when(F.col(S).isNotNull(), F.col(S)).when(
        s_med.isNotNull() & f_med.isNotNull(), _closer_outcome(F.col(T), s_med, f_med))
    return df.where(~gap).unionByName(j.withColumns({T: t_new, S: s_new}).select(*cols))


def repair_outcomes(df: DataFrame, rows: int | None = None) -> DataFrame:
    """C32 -> C34 -> C39."""
    return drop_inconsistent(fill_outcomes(df, rows))
