"""A training corpus from raw documents: language, quality, near duplicates, personal data, packing.

``STAGES`` lists (name, function) in order. Each function takes (spark, docs, sf_dir)
and works on all rows that its predecessor kept; all but the last return the columns
of ``documents``, the last one row per packed piece. :func:`run` writes each
stage's result as Parquet under ``spark.checkpoint.dir`` and reads it again for the
next; then it removes the result before and all that the stage wrote on its way.

Cases: rows with nulls, empty texts, repeated rows, empty tables and further columns go
through every stage as its operator says; further columns are kept up to packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from playlens.llm import langid, minhash, packing, pii, quality
from playlens.llm.common import doc_fold, small_batches, stage, table
from playlens.operators.ranking import dense_rank_global
from playlens.session import StageScope

#: A document's best language must have this probability.
MIN_LANGUAGE_SCORE = 0.5
#: A document's quality score must be this high.
MIN_QUALITY_SCORE = 0.3
#: Documents whose sets of five-word shingles are this similar (in percent) are near duplicates.
NEAR_PERCENT = minhash.NEAR_PERCENT
#: Key of the surrogates; a user sets a secret one.
PII_KEY = "playlens"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose text has letters and a clear language."""
    model = langid.train(docs.where(F.coalesce(doc_fold(3) != 1, F.lit(True))))
    return docs.where(model.predict(spark, F.col("text"))["score"] >= MIN_LANGUAGE_SCORE)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the classifier takes for good ones."""
    labels = table(spark, sf_dir, "labels").where(F.coalesce(doc_fold(5) != 0, F.lit(True)))
    model = quality.train(docs, quality.trusted(labels))
    return docs.where(model.score(spark, F.col("text")) >= MIN_QUALITY_SCORE)


def unused(name: str, df: DataFrame) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def with_own_ids(docs: DataFrame, own: str) -> DataFrame:
    """Add column ``own``: the doc_id where it stands for one text; else an id for each of its texts.

    Texts under a null id or one that other texts have too are numbered in the
    order of (doc_id, SHA-256 of the text), beyond all other ids. Without such ids the
    column is the doc_id, and only digests were read.
    """
    digest, spelled = unused("_sha", docs), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    several = (rows.groupBy("doc_id").agg(F.min("sha").alias("lo"), F.max("sha").alias("hi"))
               .where("doc_id is null or lo != hi").select(F.col("doc_id").alias("of")))
    texts = stage(rows.join(several, F.col("doc_id").eqNullSafe(F.col("of"))).select("doc_id", "sha").distinct(), "shared-ids")
    if texts.isEmpty():
        return docs.withColumn(own, F.col("doc_id"))
    least, most = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    key = F.format_string("%020d:%s", F.coalesce("doc_id", F.lit(0)), F.concat(spelled, F.lit(":"), F.col("sha")))
    ranks = dense_rank_global(texts.select(key.alias("key")), "key", "number")
    up = most is None or most < 2**62  # one side has room for more ids than there can be texts
    number = F.lit(most or 0) + F.col("number") if up else F.lit(least) - F.col("number")
    ranks = ranks.select(F.split_part("key", F.lit(":"), F.lit(2)).alias(f"{digest}_of"),
                         F.split_part("key", F.lit(":"), F.lit(3)).alias(f"{digest}_is"), number.alias(own))
    marked = docs.withColumn(digest, F.sha2(F.coalesce("text", F.lit("")), 256))
    found = marked.join(ranks, (spelled == F.col(f"{digest}_of")) & (F.col(digest) == F.col(f"{digest}_is")), "left")
    return found.withColumn(own, F.coalesce(own, "doc_id")).select(*docs.columns, own)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates.

    A document is a doc_id with a text: equal rows collapse to the first in the order of
    their JSON texts, while other texts under the same id, or none, stay unless they are
    near duplicates themselves.
    """
    rows, kept, doc, own = (unused(c, docs) for c in ("_rows", "_kept", "_doc", "_own"))
    docs, columns = with_own_ids(docs, own), docs.columns
    found = minhash.near_duplicates(docs.select(F.col(own).alias("doc_id"), "text"), NEAR_PERCENT)
    touched = stage(found.groupBy(F.col("doc_id").alias(doc)).agg(F.count("*").alias(rows), F.bool_or("kept").alias(kept))
                    .where((F.col(rows) > 1) | ~F.col(kept)), "dedup-decisions")
    marked = docs.join(touched, F.col(own) == F.col(doc), "left")
    once = marked.where(F.col(rows).isNull()).select(*columns)
    row = F.struct(*columns)
    again = (marked.where(F.col(kept) & (F.col(rows) > 1)).groupBy(own).agg(F.min_by(row, F.to_json(row)).alias(own + "_row"))
             .select(f"{own}_row.*"))
    return once.unionByName(again)


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data; n_chars follows the new text."""
    small_batches(spark)
    found = unused("_pii_entities", docs)
    done = pii.masked(docs, PII_KEY, found).drop(found)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens: one row per piece."""
    small_batches(spark)
    pieces = packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packing.pack(stage(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), "pieces"))


STAGES = [
    ("language_id", language_id),
    ("quality", quality_filter),
    ("near_dedup", near_dedup),
    ("pii", pii_surrogates),
    ("packing", best_fit_packing),
]

#: Classifiers, MinHash and tokens are not SQL; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    with StageScope(spark) as scope:
        for name, step in STAGES:
            docs = stage(step(spark, docs, sf_dir), name)
            scope.drop_all_but_last()  # the stage before and what this one wrote on its way
    return docs
