"""Document fingerprints: bottom-k sketches of word-shingle hashes, in SQL functions only.

A sketch is the sorted array of the ``K`` least distinct 64-bit hashes of a text's
five-word shingles. Sketches of parts merge into the sketch of the whole (the
``K`` least of both), and from two sketches follow estimates of resemblance
(Jaccard), containment and the number of distinct shingles; with fewer than ``K``
shingles all of them are exact.

:func:`with_next` gives every row the text and sketch of the next document by
ascending id (after the last: the first) with one shuffle of the texts: ids are
cut into ranges, at most ``MAX_RANGES`` of them whatever the corpus, each range
also gets a copy of the next range's first row, and the neighbour is looked up
within the range. The table of first rows is the only thing broadcast and is
bounded by the number of ranges. Ranges are equally wide in ids; where ids are spread
very unevenly some hold more rows and take longer (they are sorted and spill).

Cases: null text counts as empty; a text without words has an empty sketch (two
empty ones resemble fully, an empty and another not at all); fewer than five
words are one shingle; words are runs without white space, lower-cased; rows that
share an id are ordered by text; null ids come first; a single document is its
own next; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from playlens.llm.common import shuffle_tasks

SHINGLE = 5
K = 256
#: Ranges of ids per shuffle partition, and in all.
RANGES_PER_TASK = 32
MAX_RANGES = 200_000


def with_sketch(df: DataFrame, text: str, out: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Add column ``out``: the sketch of the text column, array<bigint>."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    hashed = df.withColumn("_hashes", F.transform(words, lambda w: F.xxhash64(w)))
    h = F.col("_hashes")
    n = F.size(h)

    def joined(x: Column, i: Column) -> Column:
        return F.xxhash64(x, *(F.get(h, i + j) for j in range(1, shingle)))

    shingles = (F.when(n >= shingle, F.transform(F.slice(h, 1, n - (shingle - 1)), joined))
                .when(n > 0, F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x))))
                .otherwise(F.array().cast("array<bigint>")))
    return hashed.withColumn(out, F.slice(F.sort_array(F.array_distinct(shingles)), 1, k)).drop("_hashes")


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two parts."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def _shared(a: Column, b: Column, k: int) -> Column:
    return F.size(F.array_intersect(F.array_intersect(merge(a, b, k), a), b))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, 0 to 1."""
    size = F.size(merge(a, b, k))
    return F.when(size == 0, F.lit(1.0)).otherwise(_shared(a, b, k) / size)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles (exact below ``k``)."""
    last = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / last)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def to_text(sketch: Column) -> Column:
    """A sketch as 16 lower-case hexadecimal digits per hash."""
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch) of each row of (doc_id, text)."""
    spark = docs.sparkSession
    tasks = shuffle_tasks(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    ranges = min(MAX_RANGES, RANGES_PER_TASK * tasks)
    width = 1 if low is None else (high - low) // ranges + 1
    before = (0 if low is None else abs(low) // width) + 1  # the range of null ids, below all others
    ranged = docs.withColumn("range", F.coalesce(F.expr(f"doc_id div {width}L"), F.lit(-before).cast("long")))
    firsts = ranged.groupBy("range").agg(F.min("doc_id").alias("first_id"))  # one row per range
    order = W.orderBy("range")
    ghosts = firsts.select("first_id", F.coalesce(F.lag("range").over(order), F.max("range").over(
        order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("of"))
    copies = (ranged.join(F.broadcast(ghosts), F.col("doc_id").eqNullSafe(F.col("first_id")), "left")
              .select("doc_id", "text", F.explode(F.when(F.col("of").isNull(), F.array(
                  F.struct(F.col("range"), F.lit(False).alias("ghost")))).otherwise(F.array(
                      F.struct(F.col("range"), F.lit(False).alias("ghost")),
                      F.struct(F.col("of").alias("range"), F.lit(True).alias("ghost"))))).alias("p"))
              .select("doc_id", "text", "p.range", "p.ghost"))
    dealt = with_sketch(copies.repartition(tasks, "range"), "text", "sketch", k)
    near = W.partitionBy("range").orderBy("ghost", "doc_id", "text")
    return (dealt.withColumns({"next_text": F.lead("text").over(near), "next_sketch": F.lead("sketch").over(near)})
            .where("not ghost").drop("range", "ghost"))


def edited(text: Column, after: Column) -> Column:
    """The text with its last floor(n/2) code points replaced by the first as many of ``after``."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(after, F.lit(1), half))
