"""Near-duplicate vectors by p-stable hashing for Euclidean distance.

Vectors are scaled to length one, where cosine c is distance sqrt(2 - 2c). A hash
is a random Gaussian projection, shifted and cut into steps of ``WIDTH``;
``hashes`` of them key one of ``tables`` tables. Both numbers follow from the
number of distinct vectors by the usual rule (see :func:`plan`): hashes so that
a table holds about one stray vector beside each vector, tables so that a pair
right at the threshold is missed with probability ``MISS``. Equal vectors of
one label are one class from the start, counted with their copies.

Buckets with one class leave before vectors are shipped. A bucket of n
classes is dealt to ceil(n / BLOCK) blocks and every pair of blocks is compared
in one matrix product, wherever Spark puts it, so a hot bucket is spread over
many tasks and no pair becomes a row: a block sends on, per class, its
number of partners and the smallest class it reaches there. A pair that meets
in several tables counts in the first only.

Cases: vectors that are null, empty, zero or hold null or non-finite components,
and vectors without a label, link with nothing; vectors of different length
never link; rows that share a vec_id are rows of their own but one node of the
links; a null vec_id links with nothing; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.llm.common import grouped, local_roots, shuffle_tasks, small_batches, stage
from playlens.llm.components import connected_components

COSINE = 0.98
#: Step of a hash on vectors of length one.
WIDTH = 2.0
#: Chance that a pair right at the threshold meets in no table.
MISS = 1e-6
#: Expected classes of one block of a bucket.
BLOCK = 256
SEED = 20240601


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that two vectors at this distance share one hash."""
    r = width / distance
    tail = 0.5 * math.erfc(r / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(classes: int, cosine: float = COSINE, miss: float = MISS) -> tuple:
    """(hashes per table, tables) for so many distinct vectors."""
    near, far = collision(math.sqrt(2 - 2 * cosine)), collision(math.sqrt(2))
    hashes = max(4, math.ceil(math.log(max(2, classes)) / -math.log(far)))
    return hashes, math.ceil(math.log(miss) / math.log1p(-near ** hashes))


def valid(v: str = "embedding"):
    """Whether a vector can link: no null or non-finite component, not all zero."""
    return (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def classes_of(vectors: DataFrame) -> DataFrame:
    """Distinct (label, embedding) with rep, the smallest vec_id, and copies."""
    return (vectors.where("vec_id is not null and label is not null").where(F.coalesce(valid(), F.lit(False)))
            .groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))


def keyed(classes: DataFrame, hashes: int, tables: int) -> DataFrame:
    """Add keys: one 64-bit table key per table, apart for labels and lengths."""

    def run(labels: pd.Series, vectors: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        lengths = vectors.map(len).to_numpy()
        for d in np.unique(lengths):
            rng = np.random.default_rng([SEED, int(d)])
            lines = rng.standard_normal((int(d), hashes * tables))
            shifts = rng.uniform(0, WIDTH, hashes * tables)
            salts = rng.integers(0, 2**64, (3, hashes * tables), dtype=np.uint64) | np.uint64(1)
            at = np.nonzero(lengths == d)[0]
            x = np.stack(vectors.iloc[at].to_list()).astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            steps = np.floor((x @ lines + shifts) / WIDTH).astype(np.int64).astype(np.uint64)
            steps += labels.iloc[at].to_numpy().astype(np.int64).astype(np.uint64)[:, None] * salts[1] + np.uint64(d)
            steps = (steps * salts[0]) ^ ((steps * salts[2]) >> np.uint64(29))
            got = steps.reshape(len(at), tables, hashes).sum(axis=2, dtype=np.uint64).view(np.int64)
            for i, row in zip(at, got):
                out[i] = row
        return pd.Series(out, dtype=object)

    return classes.withColumn("keys", F.pandas_udf(run, "array<long>")("label", "embedding"))


def dealt(reps: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per class, table and pair of blocks: tab, key, g, h, mine and the class."""
    keys = reps.select("rep", F.posexplode("keys").alias("tab", "key"))
    shared = (keys.groupBy("tab", "key").agg(F.count("*").alias("n")).where("n > 1")
              .select("tab", "key", F.ceil(F.col("n") / block).alias("blocks")))
    return (keys.join(shared, ["tab", "key"]).join(reps, "rep")
            .withColumn("mine", F.pmod(F.xxhash64("rep"), "blocks"))
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            .select("tab", "key", F.least("mine", "other").alias("g"), F.greatest("mine", "other").alias("h"),
                    "mine", "rep", "copies", "embedding", "keys"))


def _lists(column) -> np.ndarray:
    """Rows of a list column whose lists have one length, as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def block_links(rows: pa.Table, cosine: float) -> dict | None:
    """Links within one pair of blocks: rep, root (smallest class reached), links."""
    reps = rows["rep"].to_numpy()
    x = _lists(rows["embedding"].combine_chunks()).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= cosine
    np.fill_diagonal(near, False)
    mine = rows["mine"].to_numpy()
    if rows["g"][0].as_py() != rows["h"][0].as_py():
        near &= mine[:, None] != mine
    i, j = np.nonzero(near)
    if not len(i):
        return None
    keys = _lists(rows["keys"].combine_chunks())
    first = np.empty(len(i), dtype=bool)
    for lo in range(0, len(i), 65536):
        a, b = keys[i[lo:lo + 65536]], keys[j[lo:lo + 65536]]
        first[lo:lo + 65536] = (a == b).argmax(axis=1) == rows["tab"][0].as_py()
    links = np.zeros(len(reps), dtype=np.int64)
    np.add.at(links, i[first], rows["copies"].to_numpy()[j[first]])
    root = local_roots(reps, i, j)
    hit = near.any(axis=1)
    return {"rep": reps[hit], "root": root[hit], "links": links[hit]}


def linked(reps: DataFrame, cosine: float = COSINE, block: int = BLOCK) -> DataFrame:
    """(rep, root, links) rows of all blocks; links of a rep add up to its partners."""
    schema = pa.schema([("rep", pa.int64()), ("root", pa.int64()), ("links", pa.int64())])
    order = ["tab", "key", "g", "h"]

    def run(batches):
        for rows in grouped(batches, order):
            if rows.num_rows > 1 and (got := block_links(rows, cosine)):
                yield pa.RecordBatch.from_pydict(got, schema)

    groups = dealt(reps, block).repartition(shuffle_tasks(reps.sparkSession), *order).sortWithinPartitions(*order)
    return groups.mapInArrow(run, "rep long, root long, links long")


def near_duplicate_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of (vec_id, embedding, label)."""
    small_batches(vectors.sparkSession)
    vectors = vectors.select("vec_id", "embedding", "label")
    classes = stage(classes_of(vectors), "vector-classes")
    hashes, tables = plan(classes.count(), cosine)
    reps = stage(keyed(classes, hashes, tables).select("rep", "copies", "embedding", "keys"), "vector-keys")
    links = stage(linked(reps, cosine), "vector-links")
    comps = connected_components(links.where("rep != root").select("rep", "root").distinct())
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    of_class = (classes.join(counts, "rep", "left").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
                .select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("linked"),
                        F.coalesce("component", "rep").alias("root")))
    can = F.col("vec_id").isNotNull() & F.coalesce(valid(), F.lit(False))
    rows = vectors.withColumn("label", F.when(can, F.col("label")))
    return (rows.join(of_class, ["label", "embedding"], "left")
            .select("vec_id", F.coalesce("linked", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("root", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
