"""Readers with explicit schemas, the drop-and-recreate sinks, previews."""

import os
import tempfile

from pyspark.sql import functions as F

from playlens.model import ALL14
from playlens.plans.marts import build_marts, preview, write_marts
from playlens.plans.cleaning import CleanConfig, clean_events, dedup_events
from playlens.sources import read_raw_events, read_typed_events
from playlens.sources.fixture import game_events_raw

SF = "/root/testdata/sf0.001"


def test_csv_export_reads_like_parquet(spark):
    raw = game_events_raw(spark, SF)
    d = tempfile.mkdtemp(prefix="playlens-csv-", dir="/tmp")
    raw.write.option("header", "true").csv(os.path.join(d, "raw"))
    back = read_raw_events(spark, os.path.join(d, "raw"), fmt="csv")
    # text ids stay text (no inference), so 'E+' values can still be repaired
    assert back.schema["user_id"].dataType.simpleString() == "string"
    a, b = dedup_events(back), dedup_events(raw)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_marts_written_and_backup_taken(spark):
    d = tempfile.mkdtemp(prefix="playlens-marts-", dir="/tmp")
    backup = os.path.join(d, "game_events_null_level_backup")
    clean = clean_events(game_events_raw(spark, SF), CleanConfig(null_level_backup_path=backup))
    paths = write_marts(clean, os.path.join(d, "marts"))
    assert set(paths) == {"game_events_clean", "level_dropoff", "level_difficulty", "user_progression",
                          "level_summary"}
    assert read_typed_events(spark, paths["game_events_clean"]).count() == clean.count()
    assert spark.read.parquet(paths["level_summary"]).columns[0] == "level"
    snap = spark.read.parquet(backup)
    assert snap.count() > 0 and snap.where(F.col("level").isNotNull()).count() == 0
    # written twice: overwrite, not append
    write_marts(clean, os.path.join(d, "marts"))
    assert spark.read.parquet(paths["level_dropoff"]).count() == build_marts(clean)["level_dropoff"].count()


def test_previews_are_top10_by_key(spark):
    clean = clean_events(game_events_raw(spark, SF))
    prev = preview(build_marts(clean))
    rows = prev["game_events_clean"].collect()
    assert len(rows) == 10 and [c for c in prev["game_events_clean"].columns] == ALL14
    keys = [(r["user_id"], r["event_timestamp"]) for r in rows]
    assert keys == sorted(keys)


def test_scale_conf_sizes_partitions():
    from playlens.session import scale_conf

    big = scale_conf(100 * 10**12, 8000)
    assert int(big["spark.sql.shuffle.partitions"]) == -(-100 * 10**12 // (256 * 1024**2))
    assert big["spark.sql.adaptive.skewJoin.enabled"] == "true"
    small = scale_conf(10**6, 8)
    assert small["spark.sql.shuffle.partitions"] == "16"


def test_local_checkpoint_folders_are_refused_on_a_cluster():
    import pytest

    from playlens.session import ensure_checkpoint_dir

    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Context:
        master = "spark://host:7077"

        def __init__(self, **conf):
            self.conf, self.folder = Conf(conf), None

        def getConf(self):
            return self.conf

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        def __init__(self, **conf):
            self.sparkContext = Context(**conf)

    key, shared = "spark.checkpoint.dir", "spark.playlens.sharedLocalPaths"
    for conf in ({}, {key: "/tmp/x"}, {key: "file:///tmp/x"}):
        with pytest.raises(RuntimeError):
            ensure_checkpoint_dir(Session(**conf))
    assert ensure_checkpoint_dir(Session(**{key: "hdfs://n/x"})) == "hdfs://n/x"
    assert ensure_checkpoint_dir(Session(**{key: "file:///mnt/x", shared: "true"})) == "file:///mnt/x"


def test_asof_is_linear_in_one_hot_session(spark):
    import time

    from playlens.operators.asof import nearest_by_time

    rows = spark.range(200_000).select(F.lit(1).cast("long").alias("session_id"), F.col("id").alias("ts"), F.col("id").alias("u"))
    t = time.time()
    out = nearest_by_time(rows.where("u % 2 = 0").drop("u"), rows.where("u % 2 = 1"), "session_id", "ts", "u", "near")
    assert out.where("near = ts + 1 or near = ts - 1").count() == 100_000
    assert time.time() - t < 60


def failing(df):
    """``df`` with a row that ends its write half-way."""
    return df.withColumn("level", F.when(F.monotonically_increasing_id() % 2**33 == 3, F.raise_error("lost").cast("int")).otherwise(F.col("level")))


def test_failed_run_leaves_all_old_tables(spark):
    import pytest

    from playlens.plans.marts import build_marts, read_marts
    from playlens.sources.tableset import TableSet

    root = tempfile.mkdtemp(prefix="playlens-set-", dir="/tmp")
    clean = clean_events(game_events_raw(spark, SF))
    assert read_marts(spark, root) == {}
    write_marts(clean, root)
    before = {k: sorted(map(str, df.collect())) for k, df in read_marts(spark, root).items()}
    planned = read_marts(spark, root)
    tables = build_marts(clean.where("level > 2"))
    for broken in tables:  # whichever table fails, none is replaced
        with pytest.raises(Exception, match="lost"):
            TableSet(spark, root).write(tables | {broken: failing(clean)})
        assert {k: sorted(map(str, df.collect())) for k, df in read_marts(spark, root).items()} == before
    write_marts(clean.where("level > 2"), root)
    after = read_marts(spark, root)
    assert after["game_events_clean"].count() == clean.where("level > 2").count() < clean.count()
    # a reader that planned on the old version still reads it; failed runs are gone
    assert {k: sorted(map(str, df.collect())) for k, df in planned.items()} == before
    assert all(len(os.listdir(os.path.join(root, name))) == 2 for name in tables)
    write_marts(clean, root)
    assert all(len(os.listdir(os.path.join(root, name))) == 2 for name in tables)
    assert len([n for n in os.listdir(os.path.join(root, "_manifests")) if n[0] != "."]) == 2


def test_failed_overwrite_leaves_the_old_table(spark):
    import pytest

    from playlens.sources.readers import write_table

    path = os.path.join(tempfile.mkdtemp(prefix="playlens-table-", dir="/tmp"), "t")
    clean = clean_events(game_events_raw(spark, SF))
    write_table(clean, path)
    with pytest.raises(Exception, match="lost"):
        write_table(failing(clean), path)
    assert spark.read.parquet(path).count() == clean.count()
    write_table(clean.limit(5), path)
    assert spark.read.parquet(path).count() == 5
    write_table(clean.limit(5), path, mode="append")
    assert spark.read.parquet(path).count() == 10


def test_broken_csv_lines_are_set_apart(spark):
    from playlens.model import RAW_COLUMNS
    from playlens.sources.readers import read_raw_csv_checked

    path = os.path.join(tempfile.mkdtemp(prefix="playlens-csv-", dir="/tmp"), "raw.csv")
    good = "2.45E+16,24500000000000001,1704067200000000,1704067200000000,1,level_end,1.0,10,5.5,VN,3,TRUE,normal,mobile,Apple,iOS"
    bad = [good.replace(",10,5.5,", ",ten,5.5,"), good.replace(",3,TRUE", ",three,TRUE"), good[:60], good + ",more"]
    with open(path, "w") as f:
        f.write("\n".join([",".join(RAW_COLUMNS), good, *bad, good.replace("VN", ""), ""]))
    rows, broken = read_raw_csv_checked(spark, path)
    assert rows.count() == 2 and rows.select("user_id").distinct().count() == 1 and rows.columns == RAW_COLUMNS
    assert sorted(r.line for r in broken.collect()) == sorted(bad) and broken.count() == len(bad)
    assert broken.select("file").first()[0].endswith("raw.csv")
    assert clean_events(rows).count() == 2
