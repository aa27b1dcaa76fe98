"""Queries on a cluster whose ``spark.checkpoint.dir`` is a shared folder with a plain path.

The session's master is shown as one that is not local, which is all that the code
looks at; its folder is really shared, as tasks and driver are one process.
"""

import os
import subprocess

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oracle_check import compare, duck
from playlens import registry, session

SF = "/root/testdata/sf0.001"
STAGED = [
    "chain_inconsistent_rows", "chain_missing_outcome_rows", "chain_missing_time_rows", "chain_null_level_backup",
    "chain_outcome_null_counts", "churn_profile", "chain_report", "clean_events", "device_distribution", "dataset_overview",
    "difficulty_avg_playtime", "difficulty_avg_retries", "difficulty_combined", "difficulty_score", "difficulty_fail_rate",
    "difficulty_spikes", "dropoff_fail_at_max_level", "dropoff_next_level", "dropoff_last_event", "event_distribution",
    "duplicate_report", "fail_rate_by_level", "fail_and_playtime", "fail_rate_trend",
]


@pytest.fixture(scope="module")
def cluster(spark):
    """The session with a master that is not local, and without what other tests have staged."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(spark.sparkContext, "master", "spark://host:7077")
        patch.setattr(registry, "_CACHE", {})
        patch.setattr(session, "_PROBED", set(), raising=False)
        yield spark


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", STAGED)
def test_query_runs_in_a_shared_folder_with_a_plain_path(cluster, con, name):
    res, _ = compare(entry.queries()[name](cluster, SF), con, entry.oracle_sql()[name])
    assert res["ok"], res


def losing(monkeypatch, part):
    """Every write from now on loses the files that ``part`` matches, as if one machine had kept them to itself."""
    write = DataFrameWriter.parquet

    def parquet(self, path, *args, **kwargs):
        write(self, path, *args, **kwargs)
        local = path.removeprefix("file:")
        subprocess.run(["find", local, "-name", part, "-type", "f", "-delete"], check=True)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)


def test_folder_that_an_executor_does_not_share_is_refused(cluster, monkeypatch):
    monkeypatch.setattr(session, "_PROBED", set(), raising=False)
    before = set(os.listdir(cluster.sparkContext.getCheckpointDir().removeprefix("file:")))
    session.ensure_checkpoint_dir(cluster)
    assert set(os.listdir(cluster.sparkContext.getCheckpointDir().removeprefix("file:"))) == before
    monkeypatch.setattr(session, "_PROBED", set(), raising=False)
    losing(monkeypatch, "part-00001-*")
    with pytest.raises(RuntimeError, match="machine's own folder"):
        session.ensure_checkpoint_dir(cluster)


def test_rows_kept_by_an_executor_that_came_later_are_missed(cluster, monkeypatch):
    session.ensure_checkpoint_dir(cluster)
    df = cluster.range(0, 100, 1, 4)
    back, seen = session.measured_stage(df, "whole", {"rows": F.count("*")})
    assert back.count() == 100 and seen == {"rows": 100}
    assert session.stage_table(df, "plain").count() == 100 and session.stage_table(df.where("id < 0"), "empty").count() == 0
    losing(monkeypatch, "part-00002-*")
    with pytest.raises(RuntimeError, match="75 of 100 rows"):
        session.stage_table(df, "split")


def test_probe_runs_once_and_not_where_the_folder_is_known(spark, monkeypatch):
    written = []
    monkeypatch.setattr(session, "_PROBED", set(), raising=False)
    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *args: written.append(path) or write(self, path, *args))
    monkeypatch.setattr(spark.sparkContext, "master", "local[8]")
    session.ensure_checkpoint_dir(spark)
    assert not written
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    for _ in range(3):
        session.ensure_checkpoint_dir(spark)
    assert len(written) == 1 and "/playlens-probe-" in written[0]


def test_scratch_folder_is_the_same_one_in_every_process(monkeypatch, tmp_path):
    class Context:
        master, folder = "local-cluster[2,1,1024]", None

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder

    class Session:
        sparkContext = Context()

    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("TMPDIR", "/proc/self/cwd")
    assert os.path.dirname(session.ensure_checkpoint_dir(Session())) == os.path.realpath(tmp_path)
