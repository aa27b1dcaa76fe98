"""Row order of presentational queries (the driver's hash ignores it), and
fills that must never touch known values."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from playlens.operators import identity as ident
from playlens.operators import outcomes as oc
from playlens.operators import timeline as tl
from playlens.plans.cleaning import dedup_events
from playlens.sources.fixture import game_events_raw

SF = "/root/testdata/sf0.01"


def _key(v, desc=False):
    # NULLs first ascending (as the reference's engine sorts them)
    if v is None:
        return (0, 0)
    return (1, -v if desc else v)


ORDERS = {
    "event_distribution": [("total_events", True)],
    "device_distribution": [("total_events", True)],
    "top_countries": [("total_users", True)],
    "level_distribution": [("level", False)],
    "retries_per_level": [("level", False)],
    "fail_rate_by_level": [("fail_rate", True)],
    "playtime_by_level": [("avg_playtime", True)],
    "fail_and_playtime": [("fail_rate", True), ("avg_playtime", True)],
    "dropoff_next_level": [("level", False)],
    "dropoff_last_event": [("users_dropped", True)],
    "dropoff_fail_at_max_level": [("fail_events", True)],
    "difficulty_avg_retries": [("avg_attempts", True)],
    "difficulty_combined": [("fail_rate", True), ("avg_attempts", True), ("avg_playtime", True)],
    "duplicate_report": [("duplicate_count", True), ("event_timestamp", False)],
    "inconsistent_rows": [("user_id", False), ("event_timestamp", False), ("batch_event_index", False)],
    "infer_level_preview": [("user_id", False), ("event_timestamp", False)],
}


@pytest.mark.parametrize("key", sorted(ORDERS))
def test_presentational_order(spark, key):
    rows = entry.queries()[key](spark, SF).collect()
    keys = [tuple(_key(r[c], d) for c, d in ORDERS[key]) for r in rows]
    assert keys == sorted(keys)


def _known_unchanged(before, after, col, keys):
    b = before.where(F.col(col).isNotNull()).select(*keys, col)
    a = after.select(*keys, col)
    return b.exceptAll(a).count() == 0


def test_fills_keep_known_values(spark):
    dedup = dedup_events(game_events_raw(spark, "/root/testdata/sf0.001"))
    k = ["event_timestamp", "session_id", "batch_event_index", "event_name", "time_played", "level"]
    assert _known_unchanged(dedup, ident.repair_user_ids(dedup), "user_id", k)
    k2 = ["user_id", "event_timestamp", "batch_event_index", "session_id", "event_name"]
    assert _known_unchanged(dedup, tl.infer_level(dedup), "level", k2)
    assert _known_unchanged(dedup, oc.fill_time_played_median(dedup), "time_played", k2)
    assert _known_unchanged(dedup, oc.infer_is_success(dedup), "is_success", k2)
    for f in (ident.repair_user_ids, tl.infer_level, oc.fill_time_played_median, oc.infer_is_success):
        assert f(dedup).count() == dedup.count()
