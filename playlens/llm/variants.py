"""Spelling variants: words one edit apart, found through a reduced alphabet.

Letters are hashed to a few symbols. Two words one inserted, deleted or replaced
letter apart have reduced words at most one such edit apart, so the full one-edit
neighbourhood of each distinct reduced word is generated and joined to the reduced
vocabulary; the words behind each two neighbours are verified as they are. A few
symbols keep the neighbourhoods small (about 2 * symbols a letter), more keep apart
more words; the number is planned from the size of the vocabulary.

Reduced words are never spelled out: they are polynomials over the symbols, and
the whole neighbourhood follows from prefix sums, so a word of n letters costs
n * symbols steps, however long. Two reduced words with one key by chance only cost a
verification. The words of one reduced word are dealt to blocks of about ``BLOCK``
and two blocks are verified at a time, so a reduced word shared by very many words
is spread over tasks and its pairs never become rows.

Cases: null texts have no words; a null id spells as the empty string; repeated
rows count again; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from playlens.llm.common import drop_stage, join_unique, small_batches, stage

#: Words are runs of these letters; A-Z are lower-cased first.
RUN = re.compile("[a-zÀ-ÿ]+")
#: Characters of a long text worked on at once.
SLICE_CHARS = 1_000_000
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
#: Words of one block of a reduced word.
BLOCK = 64
#: Cells of one matrix of variants.
CELLS = 1 << 20
MIN_LETTERS = 5
MIN_COUNT = 3

B = np.uint64(0x9E3779B97F4A7C15)
B_INVERSE = np.uint64(pow(int(B), -1, 2**64))
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def slices(text: str) -> Iterator[str]:
    """A text in parts that end between words."""
    at = 0
    while len(text) - at > SLICE_CHARS:
        end = at + SLICE_CHARS
        while end < len(text) and RUN.match(text, end):
            end = RUN.match(text, end).end()
        yield text[at:end]
        at = end
    yield text[at:]


def runs(text: str | None) -> Counter:
    """Occurrences of each run of letters, A-Z lower-cased."""
    found: Counter = Counter()
    for part in slices((text or "").encode().lower().decode()):
        found.update(RUN.findall(part))
    return found


def unchanged(key: str, run: str) -> str:
    return run


def vocabulary(docs: DataFrame, spell: Callable[[str, str], str] = unchanged, key: str = "doc_id",
               min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: distinct words of all texts with so many letters and occurrences.

    ``spell`` gives the word for a document's key (as text) and a run. Tasks count
    before they shuffle and hand on at most ``HELD`` words at a time.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(*batch.columns):
                doc = doc.as_py()
                for run, n in runs(text.as_py()).items():
                    word = spell(doc, run)
                    if len(word) >= min_letters:
                        held[word] += n
                if len(held) > HELD:
                    yield rows()
        if held:
            yield rows()

    small_batches(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    return (texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= min_count))


def symbols_for(words: int) -> int:
    """A power of two near the sixth root of the number of words, 4 to 32, which keeps
    the words of one reduced word few and the neighbourhoods no larger than they need be."""
    return 2 ** max(2, min(5, round(math.log2(words + 1) / 6)))


def reduced(letters: np.ndarray, symbols: int) -> np.ndarray:
    """Symbols 1 to ``symbols`` of code points."""
    return (letters.astype(np.uint64) * MIX1 >> np.uint64(40)) % np.uint64(symbols) + np.uint64(1)


def finish(sums: np.ndarray, length: int) -> np.ndarray:
    """Keys of polynomials of words of ``length`` symbols."""
    x = sums + np.uint64(length * int(MIX2) % 2**64)
    x = (x ^ (x >> np.uint64(31))) * MIX1
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def by_length(words: list) -> Iterator[tuple]:
    """(positions, matrix of code points) of the words of each length, in parts."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(lengths).tolist():
        at = np.nonzero(lengths == n)[0]
        step = max(1, CELLS // max(1, n))
        for lo in range(0, len(at), step):
            part = at[lo:lo + step]
            joined = "".join(words[i] for i in part)
            yield part, np.frombuffer(joined.encode("utf-32-le"), "<u4").reshape(len(part), n)


def powers(n: int) -> np.ndarray:
    return np.append(np.uint64(1), np.cumprod(np.full(n, B, dtype=np.uint64)))


def keys(words: list, symbols: int) -> np.ndarray:
    """Key of each word's reduced word."""
    out = np.empty(len(words), np.int64)
    for at, letters in by_length(words):
        n = letters.shape[1]
        out[at] = finish((reduced(letters, symbols) * powers(n)[:n]).sum(axis=1, dtype=np.uint64), n)
    return out


def neighbourhoods(words: list, symbols: int) -> Iterator[tuple]:
    """(positions, matrix of keys): the reduced words one edit away from each word's, and itself."""
    every = np.arange(1, symbols + 1, dtype=np.uint64)
    for at, letters in by_length(words):
        n = letters.shape[1]
        s, p = reduced(letters, symbols), powers(n)
        before = np.zeros((len(at), n + 1), np.uint64)
        np.cumsum(s * p[:n], axis=1, dtype=np.uint64, out=before[:, 1:])
        total = before[:, -1:]
        yield at, finish(total, n)
        wide = max(1, CELLS // (len(at) * symbols))
        for lo in range(0, n + 1, wide):
            hi = min(lo + wide, n)
            here = before[:, lo:lo + wide]
            put = here + (total - here) * B  # room for a symbol before position lo, lo + 1, ...
            yield at, finish((put[:, :, None] + (every * p[lo:lo + wide, None])[None]).reshape(len(at), -1), n + 1)
            if lo < n:
                yield at, finish(before[:, lo:hi] + (total - before[:, lo + 1:hi + 1]) * B_INVERSE, n - 1)
                other = (every[None, None, :] - s[:, lo:hi, None]) * p[lo:hi, None]
                yield at, finish((total[:, :, None] + other).reshape(len(at), -1), n)


def links(vocab: DataFrame, symbols: int | None = None) -> DataFrame:
    """(a, b) for every two words of ``vocab`` (a stage table with distinct words) that are one edit apart, both ways."""
    symbols = symbols or symbols_for(vocab.count())

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = keys(batch["word"].to_pylist(), symbols)
            yield pa.RecordBatch.from_arrays([batch["word"], pa.array(found)], ["word", "k"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch["k"].to_numpy()
            for at, near in neighbourhoods(batch["word"].to_pylist(), symbols):
                near = np.sort(near, axis=1)
                # Neighbourhood is mutual: of two reduced words, the one with the smaller key finds the other.
                take = near >= own[at][:, None]
                take[:, 1:] &= near[:, 1:] != near[:, :-1]
                row, _ = np.nonzero(take)
                yield pa.RecordBatch.from_arrays([pa.array(own[at][row]), pa.array(near[take])], ["k1", "k2"])

    words = stage(vocab.select("word").mapInArrow(keyed, "word string, k long"), "keyed-words")
    forms = words.groupBy("k").agg(F.min("word").alias("word"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    forms = stage(forms, "reduced-words")
    blocks = stage(words.join(forms.select("k", "blocks"), "k")
                   .groupBy("k", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("block"))
                   .agg(F.collect_list("word").alias("words")), "word-blocks")
    near = forms.mapInArrow(around, "k1 long, k2 long")
    sized = forms.select(F.col("k").alias("k2"), F.col("blocks").alias("n2"))
    pairs = near.join(sized, "k2").distinct()
    pairs = (pairs.join(forms.select(F.col("k").alias("k1"), F.col("blocks").alias("n1")), "k1")
             .withColumn("b1", F.explode(F.sequence(F.lit(0), F.col("n1") - 1)))
             .withColumn("b2", F.explode(F.sequence(F.lit(0), F.col("n2") - 1)))
             .where("k1 != k2 or b1 <= b2"))
    left = blocks.select(F.col("k").alias("k1"), F.col("block").alias("b1"), F.col("words").alias("w1"))
    right = blocks.select(F.col("k").alias("k2"), F.col("block").alias("b2"), F.col("words").alias("w2"))
    met = pairs.join(left, ["k1", "b1"]).join(right, ["k2", "b2"])
    same = (F.col("k1") == F.col("k2")) & (F.col("b1") == F.col("b2"))
    verified = F.expr("""transform(w1, a -> struct(a, filter(w2, b -> levenshtein(a, b, 1) = 1)))""")
    found = (met.select(same.alias("same"), F.explode(verified).alias("p")).where("size(p.col2) > 0")
             .select("same", F.col("p.a").alias("a"), F.explode("p.col2").alias("b")))
    # Two words of one block have met both ways already.
    return found.select("a", "b").union(found.where("not same").select("b", "a"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each chain of (word, form), by doubling the steps.

    ``forms`` has one row per word that has a form. Each round is a stage table and
    the rounds grow with the logarithm of the longest chain.
    """
    now = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        then = stage(join_unique(now, ahead, "root").select("word", F.coalesce("next", "root").alias("root"),
                                                           F.col("next").isNotNull().alias("moved")), "roots")
        drop_stage(now)
        now = then.select("word", "root")
        if then.where("moved").isEmpty():
            return now


def spelling_variants(vocab: DataFrame, symbols: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of (word, n), words being distinct.

    A word's form is its near word of largest n (ties: smallest word), if that has at
    least twice its own n; its root is the end of the chain of forms.
    """
    vocab = stage(vocab.select("word", "n"), "vocabulary")
    near = links(vocab, symbols).join(vocab.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = (near.groupBy(F.col("a").alias("word"))
            .agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("b").alias("b"))).alias("best")))
    formed = F.col("best.m") <= -2 * F.col("n")
    rows = stage(vocab.join(best, "word", "left")
                 .select("word", F.when(formed, F.col("best.b")).alias("form"), "n",
                         F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
                         F.when(formed, -F.col("best.m")).alias("form_n")), "forms")
    ends = roots(rows.where("form is not null"))
    return (rows.join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def one_letter_lost(key: str, run: str) -> str:
    """The run, or for one in 97 of a document's runs the run without one letter, by a checksum of both."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{key}:".encode()))
    if h % 97:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]
