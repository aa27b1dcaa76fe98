"""Source divergence audit: how differently two groups of documents use the terms of their language.

Every (lang, source) group is a sparse vector of term counts. The kept terms of a
language are dealt to blocks by hash and numbered inside their block; a group
has one sorted (term id, count) array pair per block. A pair task co-groups the
arrays of two tiles of a language's groups in one block and prices every unordered
pair of groups: a galloping intersection of the two sorted id arrays finds the
terms of both, the rest of either array is one-sided, and all other terms of the
block are absent from both and cost the same each. Partial prices add up over
blocks and count for both directions. A task holds at most ``2 * TILE`` arrays of
about ``BLOCK`` terms, however many terms or documents there are, and an array is
shipped once per tile of its language, not once per group.

Probabilities are integers: ``1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V))``
with N the group's occurrences of kept terms and V the number of kept terms of the
language. All arithmetic is exact, by long division in 64 bits.

Cases: null text, lang and source count as empty strings, so rows without a
language are a language of their own; groups without terms take part with counts of
0; a language without kept terms has prices of 0; repeated rows count again; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from playlens.llm.common import small_batches, stage

#: Terms are runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased.
TERM = re.compile("[^\x00-\x60\x7b-\x7f]+")
#: Documents of its language that a kept term is in, at least.
MIN_DOCS = 30
SCALE = 1_000_000_000
SMOOTH = 5
TOP = 50
#: Terms of one block, about.
BLOCK = 65_536
#: Groups of one tile.
TILE = 8
SLICE_CHARS = 1_000_000
#: Distinct (lang, source, term) that a task counts before it hands them on.
HELD = 200_000

GROUP = ["lang", "source"]


def terms(text: str) -> Counter:
    """Occurrences of each term of a text; long texts are cut between terms."""
    text = text.encode().lower().decode()
    found: Counter = Counter()
    at = 0
    while len(text) - at > SLICE_CHARS:
        end = at + SLICE_CHARS
        rest = TERM.match(text, end)
        end = rest.end() if rest else end
        found.update(TERM.findall(text[at:end]))
        at = end
    found.update(TERM.findall(text[at:]))
    return found


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, count, docs: occurrences and documents of each term in each
    group. Tasks count before they shuffle."""
    names = ["lang", "source", "term", "count", "docs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def size() -> int:
            return sum(len(counts) for counts, _ in held.values())

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (counts, documents) in held.items():
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(counts.keys(), pa.string()),
                     pa.array(counts.values(), pa.int64()), pa.array([documents[t] for t in counts], pa.int64())], names)
            held.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts, documents = held.setdefault((lang, source), (Counter(), Counter()))
                found = terms(text)
                counts.update(found)
                documents.update(found.keys())
            if size() > HELD:
                yield from rows()
        yield from rows()

    small_batches(docs.sparkSession)
    texts = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in (*GROUP, "text")])
    return (texts.mapInArrow(run, "lang string, source string, term string, count long, docs long")
            .groupBy(*GROUP, "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")))


def price(counts: np.ndarray, total: int) -> np.ndarray:
    """Integer probabilities of counts; ``total`` is N + SMOOTH * V, at most 9e15."""
    rest, out = counts + SMOOTH, np.zeros(len(counts), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def gallop(short: np.ndarray, long: np.ndarray) -> tuple:
    """Positions in ``short`` and ``long`` (sorted, distinct) of their common values.

    Strides of the shorter array look for their end in the longer one by doubling
    steps from where the last stride ended, and only that window is searched.
    """
    mine, theirs, at, stride = [], [], 0, 256
    for lo in range(0, len(short), stride):
        part = short[lo:lo + stride]
        step, last = stride, part[-1]
        while at + step < len(long) and long[at + step] < last:
            step *= 2
        window = long[at:at + step + 1]
        where = np.searchsorted(window, part)
        inside = where < len(window)
        hit = np.zeros(len(part), bool)
        hit[inside] = window[where[inside]] == part[inside]
        mine.append(lo + np.nonzero(hit)[0])
        theirs.append(at + where[hit])
        at += int(where[-1])
        if at >= len(long):
            break
    none = np.zeros(0, np.int64)
    return (np.concatenate(mine), np.concatenate(theirs)) if mine else (none, none)


def difference(one: dict, two: dict, terms_of_block: int) -> int:
    """Sum of ``abs(p - q)`` over all terms of a block for two groups."""
    if len(one["ids"]) > len(two["ids"]):
        one, two = two, one
    i, j = gallop(one["ids"], two["ids"])
    both = np.abs(one["p"][i] - two["p"][j]).sum()
    only_one = np.abs(np.delete(one["p"], i) - two["p0"]).sum()
    only_two = np.abs(np.delete(two["p"], j) - one["p0"]).sum()
    absent = terms_of_block - len(one["ids"]) - len(two["ids"]) + len(i)
    return int(both + only_one + only_two + absent * abs(one["p0"] - two["p0"]))


def _vectors(rows: pa.Table) -> list:
    out = []
    for r in range(rows.num_rows):
        total = rows["total"][r].as_py()
        listed = rows["ids"][r].values
        ids = np.zeros(0, np.int64) if listed is None else listed.to_numpy()
        counts = np.zeros(0, np.int64) if listed is None else rows["counts"][r].values.to_numpy()
        p0 = int(price(np.zeros(1, np.int64), total)[0]) if total else 0
        out.append({"source": rows["source"][r].as_py(), "ids": ids, "p0": p0,
                    "p": price(counts, total) if len(ids) else np.zeros(0, np.int64), "terms": rows["terms"][r].as_py()})
    return out


def pair_task(left: pa.Table, right: pa.Table) -> pa.Table:
    """One row per unordered pair of the groups of two tiles (or of one tile with itself) in one block."""
    one, two = _vectors(left), _vectors(right)
    lang = (left if left.num_rows else right)["lang"][0].as_py()
    same = left["lo"][0].as_py() == left["hi"][0].as_py() if left.num_rows else False
    found = [(lang, a["source"], b["source"], difference(a, b, a["terms"]))
             for a in one for b in two if not same or a["source"] < b["source"]]
    columns = list(zip(*found)) if found else [[], [], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64()))],
                    names=["lang", "a", "b", "value"])


def _price_sql(count: str, n: str, v: str) -> Column:
    """:func:`price` as a column over columns of these names."""
    return F.expr(f"1 + (CAST({SCALE} AS DECIMAL(10, 0)) * ({count} + {SMOOTH})) DIV ({n} + {SMOOTH} * {v})")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: per group every other group of the language (item) and the sum of
    ``abs(p - q)`` over all kept terms. Part ``term``: the group's ``top`` terms by
    ``p - q`` above 0, q being the language's. Jobs run while the plan is built.
    """
    counted = stage(term_counts(docs), "term-counts")
    kept = (counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("of_lang"))
            .where(F.col("docs") >= min_docs).drop("docs"))
    kept = stage(kept, "kept-terms")
    langs = stage(kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("of_lang").alias("lang_n")), "languages")
    # A kept term is in at least min_docs documents, the blocks of the largest language bound those of all.
    blocks = (langs.agg(F.max("v")).first()[0] or 0) // block + 1
    in_block = Window.partitionBy("lang", "block").orderBy("term")
    kept = stage(kept.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int"))
                 .withColumn("id", F.row_number().over(in_block).cast("long")), "numbered-terms")
    used = stage(counted.join(kept, ["lang", "term"]).select(*GROUP, "term", "block", "id", "count", "of_lang"), "used-terms")

    every = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in GROUP]).distinct()
    sums = used.groupBy(*GROUP).agg(F.sum("count").alias("n"))
    zero = F.lit(0).cast("long")
    groups = every.join(sums, GROUP, "left").join(langs, "lang", "left").select(
        *GROUP, F.coalesce("n", zero).alias("n"), F.coalesce("v", zero).alias("v"), F.coalesce("lang_n", zero).alias("lang_n"))
    by_source = Window.partitionBy("lang").orderBy("source")
    groups = stage(groups.withColumn("tile", F.floor((F.row_number().over(by_source) - 1) / tile).cast("int"))
                   .withColumn("total", F.col("n") + SMOOTH * F.col("v")), "groups")

    sized = kept.groupBy("lang", "block").agg(F.count("*").alias("terms"))
    arrays = (used.groupBy(*GROUP, "block").agg(F.sort_array(F.collect_list(F.struct("id", "count"))).alias("t"))
              .select(*GROUP, "block", F.col("t.id").alias("ids"), F.col("t.count").alias("counts")))
    tiles = groups.groupBy("lang").agg((F.max("tile") + 1).alias("tiles"))
    vectors = (groups.select(*GROUP, "tile", "total").join(tiles, "lang").join(sized, "lang", "left")
               .withColumns({"block": F.coalesce("block", F.lit(0)), "terms": F.coalesce("terms", zero)})
               .join(arrays, [*GROUP, "block"], "left"))
    vectors = stage(vectors, "vectors")
    key = ["lang", "block", "lo", "hi"]
    value = ["source", "total", "terms", "ids", "counts"]
    low = (vectors.withColumn("lo", F.col("tile")).withColumn("hi", F.explode(F.sequence("tile", F.col("tiles") - 1)))
           .select(*key, *value))
    high = (vectors.withColumn("hi", F.col("tile")).withColumn("lo", F.explode(F.sequence(F.lit(0), F.col("tile"))))
            .select(*key, *value))
    priced = (low.groupBy(*key).cogroup(high.groupBy(*key)).applyInArrow(pair_task, "lang string, a string, b string, value long")
              .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    priced = stage(priced, "priced-pairs")
    both = (priced.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
            .union(priced.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")))

    apart = (used.join(groups.select(*GROUP, "n", "v", "lang_n"), GROUP)
             .withColumn("value", _price_sql("count", "n", "v") - _price_sql("of_lang", "lang_n", "v"))
             .where("value > 0").select(*GROUP, F.col("term").alias("item"), "value"))

    ranked = Window.partitionBy(*GROUP).orderBy(F.col("value").desc(), F.col("item").asc())
    pairs = both.select(*GROUP, F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    tops = apart.select(*GROUP, F.lit("term").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank")).where(F.col("rank") <= top)
    return pairs.union(tops)
