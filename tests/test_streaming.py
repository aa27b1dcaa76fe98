"""The streaming ingest loses nothing: with the batch chain's copy removal it
equals the batch over all files, whatever order they come in."""

import os
import subprocess
import sys
import tempfile

from pyspark.sql import functions as F

from playlens.model import ALL14
from playlens.operators.dedup import exact_dedup
from playlens.plans.cleaning import dedup_events
from playlens.sources.fixture import game_events_raw
from playlens.streaming import ingest_raw_events

RESTART = """
import sys
from playlens.session import build_session
from playlens.streaming import ingest_raw_events
spark = build_session("local[2]", 2, driver_memory="1g")
ingest_raw_events(spark, *sys.argv[1:4]).awaitTermination(300)
spark.stop()
"""


def test_late_files_repeats_and_a_restart(spark):
    raw = game_events_raw(spark, "/root/testdata/sf0.001")
    scratch = tempfile.mkdtemp(prefix="playlens-stream-", dir="/tmp")
    src, sink, progress = (os.path.join(scratch, d) for d in ("raw", "typed", "progress"))
    cut = raw.agg(F.expr("percentile_approx(cast(event_timestamp2 as bigint), 0.5)").cast("string")).first()[0]
    newer = raw.where(F.col("event_timestamp2") >= cut)
    older = raw.where(F.coalesce(F.col("event_timestamp2") < cut, F.lit(True)))
    assert newer.count() and older.count()

    def run():
        ingest_raw_events(spark, src, sink, progress).awaitTermination(300)

    newer.write.mode("append").parquet(src)
    run()
    older.write.mode("append").parquet(src)
    run()
    assert spark.read.parquet(sink).count() == raw.count()
    newer.write.mode("append").parquet(src)  # copies of what came first
    env = os.environ | {"PYTHONPATH": os.pathsep.join(p for p in sys.path if p)}
    subprocess.run([sys.executable, "-c", RESTART, src, sink, progress], check=True, timeout=300, env=env)
    got = spark.read.parquet(sink).select(*ALL14)
    assert got.count() == raw.count() + newer.count()
    got, want = exact_dedup(got), dedup_events(raw)
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
