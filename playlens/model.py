"""Column sets and schemas of the event table."""

from __future__ import annotations

from pyspark.sql import types as T

# The 14 columns of the event table, in the order of the reference's
# duplicate check; dedup, null profile and the clean table use this order.
ALL14 = [
    "user_id",
    "event_timestamp",
    "batch_event_index",
    "event_name",
    "app_version",
    "session_id",
    "time_played",
    "country",
    "level",
    "is_success",
    "game_mode",
    "device_category",
    "mobile_brand_name",
    "operating_system",
]

# Raw layout: the two big-integer columns arrive as text, each with a
# shadow copy that holds the exact value.
RAW_COLUMNS = [
    "user_id",
    "user_id2",
    "event_timestamp",
    "event_timestamp2",
    "batch_event_index",
    "event_name",
    "app_version",
    "session_id",
    "time_played",
    "country",
    "level",
    "is_success",
    "game_mode",
    "device_category",
    "mobile_brand_name",
    "operating_system",
]

_STR = T.StringType()

RAW_SCHEMA = T.StructType(
    [
        T.StructField("user_id", _STR),
        T.StructField("user_id2", _STR),
        T.StructField("event_timestamp", _STR),
        T.StructField("event_timestamp2", _STR),
        T.StructField("batch_event_index", T.IntegerType()),
        T.StructField("event_name", _STR),
        T.StructField("app_version", _STR),
        T.StructField("session_id", T.LongType()),
        T.StructField("time_played", T.DoubleType()),
        T.StructField("country", _STR),
        T.StructField("level", T.IntegerType()),
        T.StructField("is_success", _STR),
        T.StructField("game_mode", _STR),
        T.StructField("device_category", _STR),
        T.StructField("mobile_brand_name", _STR),
        T.StructField("operating_system", _STR),
    ]
)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("user_id", T.LongType()),
        T.StructField("event_timestamp", T.LongType()),
    ]
    + [f for f in RAW_SCHEMA.fields if f.name in ALL14[2:]]
)

# Fixed values used by the reference's logic.
LEVEL_START = "level_start"
SUCCESS = "TRUE"
FAIL = "FALSE"
MIN_ATTEMPTS = 30  # HAVING COUNT(*) >= 30 in the per-level difficulty views
TOP_COUNTRIES = 10  # TOP 10 countries by distinct users
# Weights of the combined difficulty score (stated, never executed, in the reference).
SCORE_WEIGHTS = {"fail_rate": 0.4, "retries": 0.3, "playtime": 0.2, "dropoff": 0.1}

# Columns appended to the window order so that LAG/LEAD never depend on
# which of two rows with the same timestamp and batch index comes first.
TIMELINE_ORDER = [
    "event_timestamp",
    "batch_event_index",
    "session_id",
    "event_name",
    "time_played",
    "is_success",
    "level",
]

# Order of the survivor in the (user_id, event_timestamp, level) dedup.
KEY_DEDUP_ORDER = [
    "batch_event_index",
    "event_name",
    "app_version",
    "session_id",
    "time_played",
    "country",
    "is_success",
    "game_mode",
    "device_category",
    "mobile_brand_name",
    "operating_system",
]

# Key of each output table, used to order its preview (the reference's
# TOP 10 has no ORDER BY).
TABLE_KEYS = {
    "game_events_clean": ["user_id", "event_timestamp", "batch_event_index"],
    "level_dropoff": ["level"],
    "level_difficulty": ["level"],
    "user_progression": ["user_id"],
    "level_summary": ["level"],
}
