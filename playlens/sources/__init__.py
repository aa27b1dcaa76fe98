from playlens.sources.fixture import game_events_raw, load_events
from playlens.sources.readers import read_raw_csv_checked, read_raw_events, read_typed_events, write_table
from playlens.sources.tableset import TableSet

__all__ = ["TableSet", "game_events_raw", "load_events", "read_raw_csv_checked", "read_raw_events", "read_typed_events", "write_table"]
