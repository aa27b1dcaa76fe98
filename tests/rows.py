"""Hand-made event rows for unit tests (the fixture lacks ties, NULL
sessions, NULL timestamps and similar cases)."""

from __future__ import annotations

from playlens.model import ALL14, EVENT_SCHEMA

DEFAULTS = dict(user_id=1, event_timestamp=0, batch_event_index=0, event_name="level_end",
                app_version="1.0", session_id=10, time_played=10.0, country="VN", level=1,
                is_success="TRUE", game_mode="normal", device_category="mobile",
                mobile_brand_name="Apple", operating_system="iOS")


def ev(**kw):
    row = dict(DEFAULTS)
    row.update(kw)
    return tuple(row[c] for c in ALL14)


def frame(spark, rows):
    return spark.createDataFrame([ev(**r) if isinstance(r, dict) else r for r in rows], EVENT_SCHEMA)


def as_dicts(df, order=None):
    rows = [r.asDict() for r in df.collect()]
    if order:
        rows.sort(key=lambda r: tuple((r[c] is not None, r[c]) for c in order))
    return rows
