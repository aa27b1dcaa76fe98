from playlens.streaming.ingest import ingest_raw_events, typed_stream  # noqa: F401
