"""Token counts through a cache keyed by digests of content and tokenizer.

A text is normalised by what its tokenizer provably ignores, and digested. Counts
of earlier runs are stored by (tokenizer version, content digest); documents
are joined to them by digest, and only the distinct digests that the cache lacks are
encoded, once each, and appended to it. The version is a digest of the library,
its version, the tokenizer file and the rule of normalisation, so another
tokenizer never finds a stale count. Appended files appear when their job has
committed, whole or not at all; a repeated append leaves a second row with the
same count, of which one is read.

Two kinds of file are read: ``.json`` by ``tokenizers`` and ``.model`` by
``sentencepiece``; without begin, end or other added tokens, truncation or
padding, special strings in texts as each library takes them by default.

Cases: null text counts as empty (0 bytes, 0 tokens); equal texts are encoded once
however many rows hold them; rows with equal or null ids are rows of their own;
an empty table gives an empty result; columns beside the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlens.llm.common import Memo, join_unique, small_batches, stage
from playlens.llm.packing import LATIN_LETTERS, LATIN_SPACE, byte_alphabet, is_latin

#: Documents with more tokens are over the limit.
LIMIT = 2048
#: Words in each of the two generations that a worker remembers (some 35 MB together).
REMEMBERED = 150_000
#: Characters from which a text's words are not listed all at once, and a text without short cut is cut at spaces.
LONG_TEXT = 1_000_000

#: The parts of a ``.json`` file for which words can be counted one by one (fixed values).
WORD_LAYOUT = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
#: That split for lower-cased texts of the first 256 code points.
LATIN_WORDS = re.compile("[{0}]+|'(?:[stmd]|re|ve|ll)|[0-9²³¹¼-¾]|[^{1}{0}0-9²³¹¼-¾]+".format(LATIN_LETTERS, LATIN_SPACE))


class WholeTexts:
    """Counts of a ``.json`` tokenizer, each text encoded whole."""

    def __init__(self, data: bytes):
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_buffer(data)
        self.coder.no_truncation()
        self.coder.no_padding()

    def count(self, text: str) -> int:
        return len(self.coder.encode(text, add_special_tokens=False))


class Words(WholeTexts):
    """Counts of a ``.json`` tokenizer of :data:`WORD_LAYOUT`, which drops white space and
    encodes each word by itself.

    Texts of the first 256 code points are split here, and a word's count is
    remembered. For them NFC changes nothing and lower case is the same letter by
    letter. Other texts, and those with a special token's string, go to the library;
    long ones in parts that end at a space, as no token reaches over one.
    """

    def __init__(self, data: bytes):
        super().__init__(data)
        self.model = self.coder.model
        self.letters = {b: c for c, b in byte_alphabet().items()}
        self.special = [t["content"] for t in json.loads(data)["added_tokens"]]
        self.memo = Memo(self.tokens_of, REMEMBERED)

    def tokens_of(self, word: str) -> int:
        return len(self.model.tokenize(word.encode().decode("latin-1").translate(self.letters)))

    def count(self, text: str) -> int:
        if is_latin(text) and not any(s in text for s in self.special):
            text = text.lower()
            if len(text) <= LONG_TEXT:
                return sum(map(self.memo.__getitem__, LATIN_WORDS.findall(text)))
            return sum(self.memo[m.group()] for m in LATIN_WORDS.finditer(text))
        at, n = 0, 0
        while at < len(text):
            end = text.find(" ", at + LONG_TEXT)
            end = len(text) if end < 0 else end
            n += super().count(text[at:end])
            at = end
        return n


class Pieces:
    """Counts of a ``.model`` file."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.coder = sentencepiece.SentencePieceProcessor(model_proto=data)

    def count(self, text: str) -> int:
        return len(self.coder.encode(text))


class TokenizerFile:
    """A tokenizer file with its kind, the texts it cannot tell apart, and its version."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.data = f.read()
        if path.endswith(".model"):
            import sentencepiece as library

            self.kind: Callable = Pieces
        else:
            import tokenizers as library

            spec = json.loads(self.data)
            words = spec["model"]["type"] == "BPE" and all(spec[k] == v for k, v in WORD_LAYOUT.items())
            marks = [t for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"])]
            self.kind = Words if words and not marks else WholeTexts
        about = [os.path.splitext(path)[1], library.__version__, self.kind.__name__, hashlib.sha256(self.data).hexdigest()]
        self.version = hashlib.sha256("\n".join(about).encode()).hexdigest()

    def normalised(self, text: Column) -> Column:
        """The text without what this tokenizer ignores: where it drops white space, a
        run counts as one space and none at the ends. Null counts as empty."""
        text = F.coalesce(text, F.lit(""))
        return F.trim(F.regexp_replace(text, r"(?U)\s+", " ")) if self.kind is Words else text

    def counted(self, spark: SparkSession, text: Column) -> Column:
        """n_tokens of normalised texts."""
        shared, version, kind = spark.sparkContext.broadcast(self.data), self.version, self.kind

        def run(texts: pd.Series) -> pd.Series:
            coder = _coder(version, kind, shared)
            return pd.Series(np.fromiter(map(coder.count, texts), np.int64, len(texts)))

        return F.pandas_udf(run, "long")(text)


#: This worker's tokenizer and its version.
_CODER: dict = {}


def _coder(version: str, kind: Callable, shared):
    if _CODER.get("of") != version:
        _CODER.clear()
        _CODER.update(of=version, coder=kind(shared.value))
    return _CODER["coder"]


CACHE_SCHEMA = "digest binary, n_tokens long"


class DigestCache:
    """Stored counts: a Parquet folder per tokenizer version under a shared path."""

    def __init__(self, spark: SparkSession, path: str, version: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/version={version}"

    def read(self) -> DataFrame:
        """One row per digest; no rows if nothing was stored yet."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(conf).exists(folder):
            return self.spark.range(0).select(F.lit(b"").alias("digest"), F.col("id").alias("n_tokens"))
        rows = self.spark.read.schema(CACHE_SCHEMA).parquet(self.path)
        return rows.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    def append(self, rows: DataFrame) -> None:
        rows.select("digest", "n_tokens").write.mode("append").parquet(self.path)


def count_tokens(docs: DataFrame, tokenizer: TokenizerFile, cache_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of (doc_id, text).

    Jobs run while the plan is built: the digests are staged, and the counts of the
    texts that the cache lacked are appended to it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    cache = DigestCache(spark, cache_path, tokenizer.version)
    content = tokenizer.normalised(F.col("text"))
    digest = F.unhex(F.sha2(content, 256)).alias("digest")
    every = stage(docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), digest),
                  "digests")
    missing = stage(every.select("digest").distinct().join(cache.read(), "digest", "left_anti"), "missing-digests")
    # Copies collapse before the shuffle; where few digests are missing, Spark
    # pushes the semi join below this aggregate, so that only their texts are shuffled.
    distinct = docs.select(digest, content.alias("content")).dropDuplicates(["digest"])
    fresh = distinct.join(missing, "digest", "left_semi")
    if not missing.isEmpty():
        cache.append(fresh.select("digest", tokenizer.counted(spark, F.col("content")).alias("n_tokens")))
    found = F.coalesce("n_tokens", F.raise_error("a digest is neither stored nor encoded").cast("long"))
    return (join_unique(every, cache.read(), "digest")
            .select("doc_id", "n_bytes", found.alias("n_tokens"), (found > limit).alias("over_limit")))
