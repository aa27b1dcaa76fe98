"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
from collections import deque

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Defaults for a batch job over the event table. AQE re-plans joins at run
# time (broadcast only once a side's real size is known, split skewed
# partitions) and coalesces small shuffle partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "playlens", extra: dict | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    if master and master.startswith("local"):
        # Local mode: the driver JVM is the executor; the 1g default starves it.
        builder = builder.config("spark.driver.memory", driver_memory or "8g")
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


#: Set on a cluster whose file: paths are one shared mount on all machines.
SHARED_FILES_CONF = "spark.playlens.sharedLocalPaths"


#: (application, folder) that a probe found shared.
_PROBED: set = set()


def _in_doubt(sc, folder: str) -> bool:
    """Whether only files written there can tell if all machines see the same folder."""
    return (not sc.master.startswith("local") and folder.partition("://")[0] in ("file", folder)
            and sc.getConf().get(SHARED_FILES_CONF, "false") != "true")


def _probe(spark: SparkSession, folder: str) -> None:
    """Raise unless the driver sees what the tasks of all executors write to ``folder``:
    a table of one row a task, two tasks a slot, is written and read back as a stage table is."""
    try:
        sc = spark.sparkContext
        if (sc.applicationId, folder) in _PROBED:
            return
        tasks = 2 * sc.defaultParallelism
        path = f"{folder.rstrip('/')}/playlens-probe-{uuid.uuid4().hex}"
        rows = spark.range(0, tasks, 1, tasks)
        rows.write.parquet(path)
        back = spark.read.schema(rows.schema).parquet(path).count()
        place = sc._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)
    except Exception as e:
        raise RuntimeError(f"spark.checkpoint.dir {folder} could not be written and read back; name a shared one") from e
    if back != tasks:
        raise RuntimeError(f"spark.checkpoint.dir {folder} is a machine's own folder: {back} of {tasks} rows "
                           "written there came back; name a shared one")
    _PROBED.add((sc.applicationId, folder))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder.

    On a cluster ``spark.checkpoint.dir`` names a shared folder. A path without a
    scheme or with ``file:`` may be a shared mount or each machine's own disk, over which
    stage tables would be split: unless ``spark.playlens.sharedLocalPaths`` says that
    it is shared, a small table is written there once per application, and the path is
    refused if a part of it does not come back. Only a local-mode session without a folder
    (tests) gets a scratch folder of its own.
    """
    sc = spark.sparkContext
    local = sc.master.startswith("local")
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if current and _in_doubt(sc, current):
        _probe(spark, current)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir()
    if not local:
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    # The real path: one such as /proc/self/cwd/tmp is another folder in each executor of local-cluster.
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="playlens-ckpt-", dir=os.path.realpath(os.environ.get("TMPDIR", "/tmp"))))
    return sc.getCheckpointDir()


#: (name, seconds) of the last stage tables written, for benches.
STAGE_LOG: deque = deque(maxlen=1000)


class StageScope:
    """The stage tables written inside a ``with`` block, so that a chain can
    delete those that a later one has replaced."""

    _open: list = []

    def __init__(self, spark: SparkSession, enabled: bool = True):
        self.spark, self.enabled, self.paths = spark, enabled, []
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/playlens-stages/{uuid.uuid4().hex}" if enabled else None

    def __enter__(self) -> "StageScope":
        StageScope._open.append(self)
        return self

    def __exit__(self, *exc) -> None:
        StageScope._open.remove(self)

    def drop_all_but_last(self) -> None:
        """Delete every table but the newest, which was read from them."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths[:-1]:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        self.paths = self.paths[-1:]


def staging() -> bool:
    """Whether stage tables are written here; without them a step must not
    depend on sampled ranges, which a second evaluation draws anew."""
    return not StageScope._open or StageScope._open[-1].enabled


#: Metric of a write in a folder that may not be shared.
WRITTEN = "_rows_written"


def measured_stage(df: DataFrame, name: str, metrics: dict[str, Column] | None = None,
                   columns: list[str] | None = None) -> tuple[DataFrame, dict | None]:
    """Write ``df`` as parquet under the checkpoint folder and read it back, with counts of its rows.

    Cuts a long plan at a stage boundary: later stages get column pruning and filter
    pushdown on it, the files survive executor loss, and the optimizer plans a
    short lineage. Inside a :class:`StageScope` the table goes to the scope's
    folder; inside one that is not enabled ``df`` is returned as it is, with None.

    ``metrics`` are aggregates that the write itself collects (``DataFrame.observe``), so
    they cost no job. They are taken in the tasks that write the files, each of which
    counts once however often it is tried. ``columns`` are what is written, if not all.

    In a folder that only a probe found shared (``ensure_checkpoint_dir``) the rows are counted
    again as they are read, from the footers, since an executor that came later may not share it.
    """
    spark = df.sparkSession
    scope = StageScope._open[-1] if StageScope._open else None
    if not staging():
        return (df.select(*columns) if columns else df), None
    root = scope.root if scope else f"{ensure_checkpoint_dir(spark).rstrip('/')}/playlens-stages/{uuid.uuid4().hex}"
    path = f"{root}/{len(scope.paths):02d}-{name}" if scope else f"{root}/{name}"
    if scope:
        path = f"{path}-{uuid.uuid4().hex[:8]}"
        scope.paths.append(path)
    doubt = _in_doubt(spark.sparkContext, path)
    collected = {**(metrics or {}), **({WRITTEN: F.count("*")} if doubt else {})}
    seen = Observation(f"{name}-{uuid.uuid4().hex}") if collected else None
    if seen:
        df = df.observe(seen, *[c.alias(k) for k, c in collected.items()])
    out = df.select(*columns) if columns else df
    began = time.perf_counter()
    out.write.mode("overwrite").parquet(path)
    STAGE_LOG.append((name, time.perf_counter() - began))
    got = seen.get if seen else {}
    counts = {k: got.get(k) or 0 for k in metrics} if metrics else None
    back = spark.read.schema(out.schema).parquet(path)  # a known schema needs no job that reads footers
    if doubt and (rows := back.count()) != (got.get(WRITTEN) or 0):
        raise RuntimeError(f"{rows} of {got.get(WRITTEN) or 0} rows written to {path} came back: "
                           "some executor does not share spark.checkpoint.dir; name a shared folder")
    return back, counts


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """:func:`measured_stage` without counts."""
    return measured_stage(df, name)[0]


def scale_conf(input_bytes: int, total_cores: int, partition_bytes: int = 256 * 1024**2) -> dict:
    """Session settings sized for an input of ``input_bytes`` on a cluster
    with ``total_cores`` task slots.

    Shuffles start with enough partitions that each holds about
    ``partition_bytes`` of the full table (at least two waves of tasks) and
    AQE coalesces them down after small aggregates; scans split files at the
    same size; a partition several times the median and above 1 GiB counts
    as skewed and is split in joins. Example: 100 TB on 8000 cores ->
    about 373,000 initial shuffle partitions of 256 MiB.
    """
    partitions = max(2 * total_cores, -(-input_bytes // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
    }
