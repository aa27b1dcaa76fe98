"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of hash groups, A and B, are computed per document:
``GROUPS`` groups of ``ROWS`` minhashes each. Table (i, j) is keyed by the pair
(A_i, B_j), so GROUPS**2 tables of 2*ROWS rows each cost only 2*GROUPS*ROWS
minhashes: the square root of what as many tables of their own would take. Two
documents meet in some table exactly if some A and some B group agree. At
similarity 0.85 a pair misses with probability 2*(1-0.85**3)**9, about 4 in
10,000; at 0.9 about 3 in 100,000.

Only the groups that occur in more than one document can meet, so those are
found first by one count; the rest of the documents leave before tables are
formed. Copies (equal shingle sets) are one class from the start. Candidates are
confirmed on full sets in two rounds: first every member of a bucket against the
bucket's smallest class, then, within tables that still hold several
components, the remaining pairs between components. For that the members are
dealt to blocks of bounded size, every two blocks are tested in one matrix
product, so that a hot bucket is spread over many tasks, and only links that
connect classes come out; no pair becomes a row. Pairs inside one component
need no test, since components are what is asked for.

Cases: null text, empty text and text without words have the empty set and link
with nothing; fewer words than a shingle form one shingle; rows that share a
doc_id are one document and share its component; a null doc_id links with
nothing and is kept; an empty table gives an empty result; further columns are
not read. Texts are read whole.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.llm.common import grouped, local_roots, remembered, shuffle_tasks, small_batches, stage
from playlens.llm.components import connected_components

SHINGLE = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
#: The same bound where no contract names another.
NEAR_PERCENT = 80
GROUPS = 9
ROWS = 3
#: Chance that a pair right at the threshold meets in no table, where groups are planned.
MISS = 1e-6
#: Expected members of one block of a bucket.
BLOCK = 256
#: The group of the members of small components, which share blocks.
SHARED = -(2**63)
#: Words whose hashes a worker remembers before it starts anew (some 15 MB).
REMEMBERED = 100_000

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def _multipliers(n: int) -> tuple:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n, None], seeds[n:, None] | np.uint64(1)


def plan(percent: int, miss: float = MISS) -> int:
    """A (and B) groups so that a pair right at the threshold meets in no table with chance ``miss`` at most.

    A pair is missed if no A group or no B group agrees.
    """
    return math.ceil(math.log(miss / 2) / math.log1p(-(percent / 100) ** ROWS))


@functools.lru_cache(maxsize=4)
def family(groups: int) -> tuple:
    """Hash functions of so many A and B groups, and seeds that set the groups apart."""
    return *_multipliers(2 * groups * ROWS), mix(np.arange(101, 101 + 2 * groups, dtype=np.uint64))


XORS, ODDS, _ = family(GROUPS)


class Hashes(dict):
    """Hashes of words, worked out at first sight."""

    def __missing__(self, word: bytes) -> int:
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash per word, A-Z lower-cased, words being runs without ASCII white space."""
    words = text.encode().lower().split()
    known = remembered("minhash", Hashes)
    if len(known) > REMEMBERED:
        known.clear()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for i in range(size):
        out *= MIX1
        out += words[i:i + n]
    out = np.sort(mix(out))
    return out[np.append(True, out[1:] != out[:-1])]


def group_keys(shingles: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The 2*groups group hashes (A then B) of a set that is not empty."""
    xors, odds, seeds = family(groups)
    least = np.full(len(xors), np.uint64(2**64 - 1))
    for lo in range(0, len(shingles), 4096):
        np.minimum(least, ((shingles[lo:lo + 4096] ^ xors) * odds).min(axis=1), out=least)
    keys = seeds.copy()
    for column in least.reshape(2 * groups, ROWS).T:
        keys = mix(keys + column)
    return keys


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sketch(texts: pd.Series, groups: int = GROUPS) -> pd.DataFrame:
    rows = []
    for t in texts:
        s = shingle_set(t)
        keys = _signed(group_keys(s, groups)) if len(s) else []
        rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), keys[:groups], keys[groups:]))
    return pd.DataFrame(rows, columns=["n_shingles", "digest", "a", "b"])


def _sets(texts: pd.Series) -> pd.DataFrame:
    got = [shingle_set(t) for t in texts]
    return pd.DataFrame({"digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in got],
                         "shingles": [_signed(s) for s in got]})


def sketches(docs: DataFrame, groups: int = GROUPS) -> DataFrame:
    """doc_id, n_shingles, digest of the set, group hashes a and b."""
    def run(texts: pd.Series) -> pd.DataFrame:
        return _sketch(texts, groups)

    udf = F.pandas_udf(run, "n_shingles long, digest binary, a array<long>, b array<long>")
    return docs.select("doc_id", udf("text").alias("s")).select("doc_id", "s.*")


def candidates(classes: DataFrame) -> DataFrame:
    """Classes that share an A and a B group with others: a and b hold the shared ones."""
    groups = classes.select("cls", F.explode(F.concat("a", "b")).alias("h"))
    common = groups.groupBy("h").count().where("count > 1").select("h")
    shared = groups.join(common, "h").groupBy("cls").agg(F.collect_set("h").alias("hs"))
    return (classes.join(shared, "cls")
            .withColumns({"a": F.array_intersect("a", "hs"), "b": F.array_intersect("b", "hs")})
            .where((F.size("a") > 0) & (F.size("b") > 0)).select("cls", "digest", "n_shingles", "a", "b"))


def tables(cand: DataFrame, *more: str) -> DataFrame:
    """One row per class and table: its key (x, y)."""
    return cand.select("cls", *more, "b", F.explode("a").alias("x")).withColumn("y", F.explode("b")).drop("b")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (hi, lo) whose full sets are similar enough."""
    left = sets.select(F.col("cls").alias("hi"), F.col("shingles").alias("s"))
    right = sets.select(F.col("cls").alias("lo"), F.col("shingles").alias("t"))
    n, m = F.size("s"), F.size("t")
    both = F.when(100 * F.least(n, m) >= percent * F.greatest(n, m), F.size(F.array_intersect("s", "t")))
    return (pairs.join(left, "hi").join(right, "lo").withColumn("both", both)
            .where(100 * F.col("both") >= percent * (n + m - F.col("both"))).select("hi", "lo"))


def stars(cand: DataFrame) -> DataFrame:
    """Each member of a bucket with the bucket's smallest class: hi, lo."""
    keyed = tables(cand).select("cls", "x", "y")
    least = keyed.groupBy("x", "y").agg(F.min("cls").alias("lo"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keyed.join(least, ["x", "y"]).where("cls > lo").select(F.col("cls").alias("hi"), "lo").distinct()


def mixed_members(cand: DataFrame) -> DataFrame:
    """Members of tables that hold several components (column comp): x, cls, comp."""
    keyed = tables(cand, "comp").select("x", "y", "cls", "comp")
    mixed = (keyed.groupBy("x", "y").agg(F.min("comp").alias("p"), F.max("comp").alias("q")).where("p < q").select("x", "y"))
    return keyed.join(mixed, ["x", "y"]).select("x", "cls", "comp").distinct()


def placed(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """The block of each member: x, g, blocks, k, cls, blocks being how many its group has.

    The tables of one A group x are taken together. A component with a block's
    worth of members there has blocks of its own (g its id), the rest shares
    blocks (g = ``SHARED``).
    """
    sized = members.groupBy("x", "comp").agg(F.count("*").alias("n"))
    group = sized.withColumn("g", F.when(F.col("n") >= block, F.col("comp")).otherwise(F.lit(SHARED).cast("long")))
    counts = group.groupBy("x", "g").agg(F.ceil(F.sum("n") / block).alias("blocks"))
    return (members.join(group.select("x", "comp", "g"), ["x", "comp"]).join(counts, ["x", "g"])
            .select("x", "g", "blocks", F.pmod(F.xxhash64("cls"), "blocks").alias("k"), "cls"))


def dealt(placed: DataFrame) -> DataFrame:
    """One row per member and pair of blocks that it belongs to: x, g1, k1, g2, k2, cls.

    Two blocks of one component need no test, so a large group that is linked already
    costs no pairs of blocks within itself. ``placed`` is read twice and should be a stage table.
    """
    blocks = (placed.select("x", "g", "blocks").distinct()
              .select("x", "g", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("k")))
    one = blocks.select("x", F.col("g").alias("g1"), F.col("k").alias("k1"))
    two = blocks.select("x", F.col("g").alias("g2"), F.col("k").alias("k2"))
    pairs = one.join(two, "x").where(((F.col("g1") < F.col("g2")) | ((F.col("g1") == F.col("g2")) & (F.col("g1") == SHARED)
                                                                     & (F.col("k1") <= F.col("k2")))))
    sides = F.array_distinct(F.array(*(F.struct(F.col(f"g{i}").alias("g"), F.col(f"k{i}").alias("k")) for i in (1, 2))))
    pair = ["x", "g1", "k1", "g2", "k2"]
    of_pair = pairs.select(*pair, F.explode(sides).alias("side")).select(*pair, "side.g", "side.k")
    return placed.select("x", "g", "k", "cls").join(of_pair, ["x", "g", "k"]).select(*pair, "cls")


def block_links(rows: pa.Table, percent: int) -> tuple:
    """(cls, root) of the members of two blocks that link with any other of them.

    Intersections come from products of the incidence matrix, a band of shingles
    at a time; shingles of one member only are left out.
    """
    lists = rows["shingles"].combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    of = np.repeat(np.arange(len(lists)), lengths)
    _, column, df = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    often = df > 1
    at = np.cumsum(often) - 1
    keep = often[column]
    of, column = of[keep], at[column[keep]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    both = np.zeros((len(lists), len(lists)), dtype=np.float32)
    width = 4096
    for lo in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, [lo, lo + width])
        held = np.zeros((len(lists), width), dtype=np.float32)
        held[of[a:b], column[a:b] - lo] = 1
        both += held @ held.T
    either = lengths[:, None] + lengths - both
    near = 100 * both >= percent * either
    np.fill_diagonal(near, False)
    i, j = np.nonzero(near)
    ids = rows["cls"].to_numpy()
    root = local_roots(ids, i, j)
    moved = root != ids
    return ids[moved], root[moved]


def between(cand: DataFrame, sets: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Links between components (column comp) that share a table, as (hi, lo) rows
    that connect the same classes. Pairs are tested inside blocks and never become rows.

    Members and their blocks are written on the way: in one plan, which adaptive
    execution tells the driver anew after each of its stages, they filled its memory.
    """
    schema = pa.schema([("hi", pa.int64()), ("lo", pa.int64())])
    keys = ["x", "g1", "k1", "g2", "k2"]

    def run(batches):
        remembered("minhash", Hashes)
        for rows in grouped(batches, keys):
            hi, lo = block_links(rows, percent)
            if len(hi):
                yield pa.RecordBatch.from_arrays([pa.array(hi), pa.array(lo)], schema=schema)

    members = stage(mixed_members(cand), "mixed")
    groups = dealt(stage(placed(members, block), "placed")).join(sets, "cls")
    return (groups.repartition(shuffle_tasks(cand.sparkSession), *keys).sortWithinPartitions(*keys)
            .mapInArrow(run, "hi long, lo long").distinct())


def near_duplicates(docs: DataFrame, percent: int = NEAR_PERCENT, groups: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of (doc_id, text).

    ``groups`` is planned from ``percent`` unless given.
    """
    groups = groups or plan(percent)
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    every = stage(sketches(docs, groups), "sketches")
    classes = stage(every.where("n_shingles > 0 and doc_id is not null").groupBy("digest")
                    .agg(F.min("doc_id").alias("cls"), F.first("n_shingles").alias("n_shingles"),
                         F.first("a").alias("a"), F.first("b").alias("b")), "classes")
    cand = stage(candidates(classes), "candidates")
    udf = F.pandas_udf(_sets, "digest binary, shingles array<long>")
    sets = stage(docs.join(cand.select(F.col("cls").alias("doc_id"), F.col("digest").alias("of")), "doc_id")
                 .select("doc_id", "of", udf("text").alias("s")).where("s.digest = of")
                 .select(F.col("doc_id").alias("cls"), "s.shingles").distinct(), "sets")
    links = stage(confirm(stars(cand), sets, percent), "links")
    comps = connected_components(links)
    labelled = cand.join(comps.withColumnRenamed("id", "cls"), "cls", "left").withColumn("comp", F.coalesce("component", "cls"))
    more = stage(between(labelled, sets, percent), "more-links")
    if not more.isEmpty():
        comps = connected_components(links.union(more))
    of_class = (classes.select("digest", "cls").join(comps.withColumnRenamed("id", "cls"), "cls", "left")
                .select("digest", F.coalesce("component", "cls").alias("linked")))
    ids = every.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    return (ids.join(of_class, "digest", "left").withColumn("component_id", F.coalesce("linked", "doc_id"))
            .select("doc_id", "n_shingles", "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))
