"""Helpers shared by the operators: tables, stage files, Arrow batch sizes."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import playlens
from playlens.session import stage_table

#: Rows per Arrow batch for whole texts, so that a batch of long documents
#: stays small. A setting of the session's own wins.
TEXT_BATCH_ROWS = 1000
_SHIPPED: dict = {}
#: What this Python worker remembers, by operator, and the task that it was last asked in.
_REMEMBERED: dict = {}
_ASKED: dict = {"task": None}
#: Rows of one key that a join leaves in one task, at least.
HOT_ROWS = 10_000
#: Keys that a join spreads, at most: a key is hot from total / HOT_KEYS rows on.
HOT_KEYS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application.

    Python workers then import it wherever they run, also where it is not
    installed. A zip of some 100 kB that Spark itself serves.
    """
    sc = spark.sparkContext
    if _SHIPPED.get("application") == sc.applicationId:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(playlens.__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="playlens-code-"), "playlens_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.dirname(playlens.__file__)):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, top))
    sc.addPyFile(path)
    _SHIPPED["application"] = sc.applicationId


def small_batches(spark: SparkSession, rows: int = TEXT_BATCH_ROWS) -> None:
    """Make the session fit for Python work on whole texts: the code is on the
    executors, and the rows of an Arrow batch are bounded unless they already are."""
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back.

    The files outlive lost executors and give the next step a short lineage,
    pruned columns and pushed filters.
    """
    return stage_table(df, f"llm-{name}")


def drop_stage(df: DataFrame) -> None:
    """Delete the files of a stage table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/playlens-stages/" in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def doc_fold(folds: int, key: str = "doc_id") -> Column:
    """``crc32(key as text) mod folds``: the hold-out rule of the queries."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(folds))


def shuffle_tasks(spark: SparkSession) -> int:
    """Partitions that the session gives a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def grouped(batches: Iterator[pa.RecordBatch], keys: list) -> Iterator[pa.Table]:
    """Runs of rows with equal bigint ``keys`` from the sorted batches of one task,
    whole even where a run goes on into the next batch. Runs must be bounded."""
    held: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys], axis=1)
        cuts = (np.nonzero((ids[1:] != ids[:-1]).any(axis=1))[0] + 1).tolist()
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            if held and (ids[lo] != last).any():
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = ids[lo]
    if held:
        yield pa.Table.from_batches(held)


def local_roots(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``ids`` the smallest id reachable over links (i, j), given both ways."""
    root = ids.copy()
    while True:
        least = root.copy()
        np.minimum.at(least, i, root[j])
        if (least == root).all():
            return root
        root = least


def give_back() -> None:
    """Return freed memory to the system, which Arrow's pool and glibc keep for later otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def remembered(operator: str, make: Callable[[], object] = dict):
    """What ``make()`` gave, remembered in this Python worker for later batches and tasks of ``operator``.

    Spark uses a Python worker again for other stages. When a task of another operator
    begins there, what the worker remembered for the one before goes, so that
    it never holds the tables of several at once; operators in one task keep theirs.
    """
    context = TaskContext.get()
    task = context and context.taskAttemptId()
    if task != _ASKED["task"]:
        _ASKED["task"] = task
        if others := [k for k in _REMEMBERED if k != operator]:
            for k in others:
                del _REMEMBERED[k]
            give_back()
    if operator not in _REMEMBERED:
        _REMEMBERED[operator] = make()
    return _REMEMBERED[operator]


class Memo(dict):
    """What a worker remembers of strings, in two generations of at most ``entries`` each.

    A full young generation becomes the old one, so strings that come again and
    again are kept and those seen once fall out. ``resolve`` gives the value of
    a string; one of more than ``chars`` characters is resolved whenever it is met.
    """

    def __init__(self, resolve: Callable[[str], object], entries: int, chars: int = 64):
        super().__init__()
        self.resolve, self.entries, self.chars = resolve, entries, chars
        self.old: dict = {}

    def __missing__(self, k: str):
        got = self.old.get(k)
        if got is None:
            got = self.resolve(k)
        if len(k) <= self.chars:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[k] = got
        return got


def join_unique(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Left join of ``rows`` to a ``lookup`` with one row per ``key``, hot keys spread over tasks.

    A key with more than ``HOT_ROWS`` rows and more than one in ``HOT_KEYS`` of all is
    hot: its lookup row is repeated under several salts and its rows are dealt to
    them in turn. At most ``HOT_KEYS`` keys can be hot, so their list is broadcast.
    ``rows`` must be a stage table (it is read twice, in the same order); a null key
    finds nothing. Runs a job that counts the rows.
    """
    bound = max(HOT_ROWS, -(-rows.count() // HOT_KEYS))
    hot = (rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot_key")).agg(F.count("*").alias("_hot_rows"))
           .where(F.col("_hot_rows") > bound)
           .select("_hot_key", F.ceil(F.col("_hot_rows") / bound).cast("int").alias("_salts")))
    salts = F.coalesce(F.col("_salts"), F.lit(1))
    dealt = (rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
             .withColumn("_salt", F.pmod(F.monotonically_increasing_id(), salts).cast("int"))
             .drop("_hot_key", "_salts"))
    copies = (lookup.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
              .withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_hot_key", "_salts"))
    return dealt.join(copies, [key, "_salt"], "left").drop("_salt")
