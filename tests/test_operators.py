"""Hand-made rows for the rules the fixture does not exercise."""

from pyspark.sql import functions as F

from playlens.model import RAW_SCHEMA
from playlens.operators import attributes as attr
from playlens.operators import dedup as dd
from playlens.operators import identity as ident
from playlens.operators import outcomes as oc
from playlens.operators import repair as rp
from playlens.operators import timeline as tl
from playlens.plans import dropoff, eda
from rows import as_dicts, frame


def raw_row(user, user2, ts, ts2, success="TRUE"):
    return (user, user2, ts, ts2, 0, "level_end", "1.0", 1, 1.0, "VN", 1, success, "n", "mobile", "A", "iOS")


def test_sci_repair_case_insensitive_and_bad_cast(spark):
    raw = spark.createDataFrame([
        raw_row("2.4e+16", "24553301114356402", "1", "1"),
        raw_row("7", "7", "1.70407E+15", "1704067200000001"),
        raw_row("", None, "5", "5", success=" true "),
        raw_row(None, None, None, None, success=None),
    ], RAW_SCHEMA)
    out = as_dicts(rp.typed_events(raw))
    assert [r["user_id"] for r in out] == [24553301114356402, 7, None, None]
    assert [r["event_timestamp"] for r in out] == [1, 1704067200000001, 5, None]
    assert [r["is_success"] for r in out] == ["TRUE", "TRUE", "TRUE", None]
    lost = rp.count_cast_failures(raw).first()
    assert (lost["user_id_lost"], lost["event_timestamp_lost"]) == (1, 0)


def test_exact_dedup_treats_nulls_as_equal(spark):
    df = frame(spark, [dict(level=None), dict(level=None), dict(level=2)])
    assert dd.exact_dedup(df).count() == 2
    rep = as_dicts(dd.duplicate_report(df))
    assert len(rep) == 2 and {r["duplicate_count"] for r in rep} == {2}


def test_key_dedup_keeps_first_by_batch_index_nulls_first(spark):
    df = frame(spark, [dict(batch_event_index=3, app_version="a"), dict(batch_event_index=None, app_version="b"),
                       dict(batch_event_index=1, app_version="c"), dict(level=2, app_version="d")])
    out = as_dicts(dd.key_dedup(df), ["level"])
    assert [(r["level"], r["app_version"]) for r in out] == [(1, "b"), (2, "d")]


def test_fill_user_single_session_and_null_session(spark):
    df = frame(spark, [dict(user_id=5, session_id=1), dict(user_id=None, session_id=1, event_timestamp=9),
                       dict(user_id=None, session_id=None), dict(user_id=5, session_id=2),
                       dict(user_id=6, session_id=2), dict(user_id=None, session_id=2)])
    out = as_dicts(ident.fill_user_single_session(df), ["session_id", "user_id"])
    assert [(r["session_id"], r["user_id"]) for r in out] == [(None, None), (1, 5), (1, 5), (2, None), (2, 5), (2, 6)]


def test_fill_user_nearest_ties_and_null_timestamps(spark):
    rows = [dict(user_id=7, session_id=1, event_timestamp=100), dict(user_id=3, session_id=1, event_timestamp=300),
            dict(user_id=None, session_id=1, event_timestamp=200),   # equal distance -> smaller id 3
            dict(user_id=None, session_id=1, event_timestamp=110),   # nearer 7
            dict(user_id=None, session_id=1, event_timestamp=None),  # never filled
            dict(user_id=9, session_id=1, event_timestamp=None),     # not a candidate
            dict(user_id=4, session_id=1, event_timestamp=300),      # same time as 3 -> 3 wins
            dict(user_id=None, session_id=1, event_timestamp=1000)]
    out = ident.fill_user_nearest(frame(spark, rows), target_rows=2)
    got = {(r["event_timestamp"], r["user_id"]) for r in out.where(F.col("session_id") == 1).collect()}
    assert (200, 3) in got and (110, 7) in got and (None, None) in got and (1000, 3) in got


def test_fill_user_surrogate_one_id_per_session(spark):
    df = frame(spark, [dict(user_id=None, session_id=30), dict(user_id=None, session_id=30, level=2),
                       dict(user_id=None, session_id=20), dict(user_id=None, session_id=None),
                       dict(user_id=1, session_id=10)])
    out = {(r["session_id"], r["user_id"]) for r in ident.fill_user_surrogate(df).collect()}
    assert out == {(30, -2), (20, -1), (None, None), (10, 1)}


def test_cascade_ties_and_order(spark):
    rows = [dict(user_id=1, session_id=1, app_version="b"), dict(user_id=1, session_id=1, app_version="a"),
            dict(user_id=1, session_id=1, app_version=None),           # session -> smallest 'a'
            dict(user_id=1, session_id=2, app_version=None),           # user mode after session fill: a(2) > b(1)
            dict(user_id=2, session_id=3, app_version=None),           # no value for user -> global
            dict(user_id=None, session_id=4, app_version=None),        # NULL user -> global
            dict(user_id=3, session_id=5, app_version="z"), dict(user_id=3, session_id=6, app_version="z"),
            dict(user_id=4, session_id=7, app_version="c"), dict(user_id=4, session_id=7, app_version="c")]
    out = attr.fill_cascade(frame(spark, rows), ["app_version"])
    got = {(r["user_id"], r["session_id"], r["app_version"]) for r in out.collect()}
    # global counts after the user fill: a=4, b=1, z=2, c=2 -> 'a'
    assert (1, 1, "a") in got and (1, 2, "a") in got and (2, 3, "a") in got and (None, 4, "a") in got
    assert out.count() == len(rows)


def test_entity_mode_tie_smallest(spark):
    df = frame(spark, [dict(batch_event_index=4), dict(batch_event_index=2), dict(batch_event_index=None),
                       dict(user_id=2, batch_event_index=None)])
    out = attr.fill_mode_for_entity(df, "user_id", 1, "batch_event_index")
    got = sorted((r["user_id"], r["batch_event_index"] if r["batch_event_index"] is not None else -1)
                 for r in out.collect())
    assert got == [(1, 2), (1, 2), (1, 4), (2, -1)]


def test_drop_isolated_null_level_keeps_null_user(spark):
    df = frame(spark, [dict(user_id=1, level=None), dict(user_id=None, level=None),
                       dict(user_id=2, level=None), dict(user_id=2, level=3)])
    assert tl.drop_isolated_null_level(df).count() == 3


def test_timeline_same_timestamp_tie_break_and_buckets(spark):
    rows = [dict(event_timestamp=5, batch_event_index=1, level=1),
            dict(event_timestamp=5, batch_event_index=0, level=2),
            dict(event_timestamp=50, batch_event_index=0, level=None, is_success="FALSE"),
            dict(event_timestamp=900, level=4)]
    out = as_dicts(tl.level_timeline(frame(spark, rows), target_rows=2), ["event_timestamp", "batch_event_index"])
    assert [(r["prev_level"], r["next_level"]) for r in out] == [(None, 1), (2, None), (1, 4), (None, None)]
    assert out[2]["prev_success"] == "TRUE" and out[3]["prev_success"] == "FALSE"


def test_infer_level_rules(spark):
    def seq(user, levels, outcomes):
        return [dict(user_id=user, event_timestamp=i, level=lv, is_success=s)
                for i, (lv, s) in enumerate(zip(levels, outcomes))]
    rows = (seq(1, [3, None, 3], ["TRUE", None, "TRUE"])          # case 1
            + seq(2, [3, None, 4], ["TRUE", None, "TRUE"])        # case 2
            + seq(3, [3, None, 4], ["FALSE", None, "TRUE"])       # preview case 3 only
            + seq(4, [2, None, 9], ["TRUE", None, "TRUE"])        # case 4
            + seq(5, [2, None, None, 2], ["TRUE"] * 4))           # runs stay NULL
    df = frame(spark, rows)
    upd = {(r["user_id"], r["event_timestamp"]): r["level"] for r in tl.infer_level(df).collect()}
    assert upd[(1, 1)] == 3 and upd[(2, 1)] == 4 and upd[(3, 1)] is None
    assert 2 < upd[(4, 1)] < 9 and upd[(5, 1)] is None and upd[(5, 2)] is None
    prev = {(r["user_id"], r["event_timestamp"]): r["inferred_level"] for r in tl.infer_level_preview(df).collect()}
    assert prev[(3, 1)] == 3 and (5, 1) not in prev


def test_outcome_tie_goes_to_fail_and_missing_median_skips(spark):
    rows = [dict(level=1, time_played=10.0, is_success="TRUE"), dict(level=1, time_played=30.0, is_success="FALSE"),
            dict(level=1, time_played=20.0, is_success=None, event_timestamp=1),    # tie -> FALSE
            dict(level=1, time_played=12.0, is_success=None, event_timestamp=2),    # nearer success
            dict(level=2, time_played=5.0, is_success="TRUE"),
            dict(level=2, time_played=5.0, is_success=None, event_timestamp=3)]     # no fail median
    got = {r["event_timestamp"]: r["is_success"] for r in oc.infer_is_success(frame(spark, rows)).collect()
           if r["event_timestamp"] in (1, 2, 3)}
    assert got == {1: "FALSE", 2: "TRUE", 3: None}


def test_exact_median_even_and_odd(spark):
    df = frame(spark, [dict(level=1, time_played=t) for t in (1.0, 2.0, 2.0, 10.0)]
               + [dict(level=2, time_played=t) for t in (3.0, 1.0, 2.0)])
    m = {r["level"]: r["median_time"] for r in oc.median_by_level_outcome(df).collect()}
    assert m == {1: 2.0, 2: 2.0}


def test_last_event_ties_count_every_event(spark):
    df = frame(spark, [dict(event_timestamp=9, level=1), dict(event_timestamp=9, level=2, batch_event_index=1),
                       dict(event_timestamp=1, level=3)])
    got = {r["level"]: r["users_dropped"] for r in dropoff.dropoff_last_event(df).collect()}
    assert got == {1: 1, 2: 1}


def test_top_countries_null_is_a_group_and_ties_by_name(spark):
    rows = [dict(user_id=i, country=c) for i, c in enumerate(["B", "A", None, "C"] * 3)]
    out = [r["country"] for r in eda.top_countries(frame(spark, rows), n=2).collect()]
    assert out == [None, "A"]


def test_dropoff_null_user_counts_in_dropped_only(spark):
    df = frame(spark, [dict(user_id=None, level=2), dict(user_id=1, level=1), dict(user_id=1, level=2)])
    got = {r["level"]: (r["users_reached"], r["dropped_users"]) for r in dropoff.level_dropoff(df).collect()}
    assert got == {1: (1, 0), 2: (1, 2)}


def test_level_summary_equals_join_of_marts(spark):
    from playlens.plans import marts

    rows = [dict(level=None, user_id=1), dict(level=1, event_name="level_start", user_id=None),
            dict(level=1, user_id=2, is_success="FALSE"), dict(level=2, user_id=2, time_played=None,
                                                               is_success=None),
            dict(level=3, user_id=3, event_name="level_end"), dict(level=3, user_id=4, event_name="level_start")]
    df = frame(spark, rows)
    fused = {r["level"]: tuple(r) for r in marts.level_summary(df).collect()}
    d = marts.level_dropoff(df).select(F.col("level").alias("_dl"), "dropoff_rate")
    f = marts.level_difficulty(df).select(F.col("level").alias("_fl"), "fail_rate", "avg_attempts")
    base = df.groupBy("level").agg(F.count("*").alias("total_attempts"),
                                   F.countDistinct("user_id").alias("unique_users"),
                                   F.round(F.avg("time_played"), 6).alias("avg_playtime"),
                                   F.round(F.try_divide(F.count_if(F.col("is_success") == "TRUE").cast("double"),
                                                        F.count("is_success").cast("double")), 6)
                                   .alias("success_rate"))
    joined = (base.join(d, base["level"] == d["_dl"], "left").join(f, base["level"] == f["_fl"], "left")
              .select("level", "total_attempts", "unique_users", "avg_playtime", "success_rate",
                      "dropoff_rate", "fail_rate", "avg_attempts"))
    assert fused == {r["level"]: tuple(r) for r in joined.collect()}
