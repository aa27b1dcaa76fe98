"""Best-fit packing of tokenised documents after dominance reduction.

Only token counts decide a packing, and there are at most ``capacity`` of
them, so the solver works on the histogram of lengths: a table of at most
``capacity`` rows whatever the corpus holds. Following Martello and Toth it
takes the largest length first and permanently fixes a set of up to three
lengths when that set provably dominates every other set with the same
largest member; the instance shrinks, and what no rule fixes goes through
best-fit decreasing. Equal lengths are handled in bulk, so the work does not
grow with the corpus. The outcome is a list of placements (length, ranks of the
documents of that length, sequences, offset), bounded by a small multiple of
``capacity``, which is joined back to the pieces by their rank within their
length. Ranks come from salted windows, so one very common length is
spread over many tasks.

Ids come from ``tokenizers``. Texts are split by the public pattern first, as the
file's own pre-tokenizer does, and frequent pieces are remembered: a piece alone has
the ids that it has in its text.

Cases: null text counts as empty (one token, the separator); repeated rows are
pieces of their own; an empty table gives an empty result; further columns of
the documents are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from playlens.llm.common import Memo, remembered

CAPACITY = 2048
#: Expected rows of one window partition when documents of a length are ranked.
RANK_ROWS = 512
#: Distinct pieces in each of the two generations that a worker remembers (some 80 MB together).
REMEMBERED = 200_000
#: Characters from which a text's pieces are not listed all at once.
LONG_TEXT = 1_000_000
#: Characters of the longest piece that is remembered.
SHORT = 64

PIECES = "array<struct<piece int, start long, length long, ids binary>>"


def byte_alphabet() -> dict:
    """Byte of each character of a byte-level vocabulary file: printable
    Latin-1 stands for itself, the other bytes for 256, 257, ... in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_tokenizer(path: str) -> tuple:
    """(token bytes by id, special tokens) of a byte-level BPE tokenizer file.

    A token's id must follow the order of merges, as ids serve as ranks.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    split = spec["pre_tokenizer"]
    if spec["model"]["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or spec["normalizer"]:
        raise ValueError(f"{path} is not a plain byte-level BPE tokenizer")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    byte = byte_alphabet()
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    merged = [ranks[bytes(byte[c] for c in a + b)] for a, b in
              (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
    if merged != sorted(merged):
        raise ValueError(f"{path}: ids do not follow the order of merges")
    return ranks, special


#: Letters, digits and white space among the first 256 code points, as the public pattern's classes have them.
LATIN_LETTERS, LATIN_DIGITS, LATIN_SPACE = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
#: The public pattern for texts of these code points alone, twice as fast (a test holds both against each other).
LATIN_PATTERN = re.compile(" ?[{0}]+|'(?:[stmd]|re|ve|ll)| ?[{1}]+| ?[^{2}{0}{1}]+|[{2}]+(?![^{2}])|[{2}]+".format(
    LATIN_LETTERS, LATIN_DIGITS, LATIN_SPACE))


def is_latin(text: str) -> bool:
    """Whether the text has no code point above 255."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    A piece of the pattern has the same ids alone as in its text, so pieces are
    remembered; one not met lately goes to the tokenizer's own model.
    """

    def __init__(self, spec: str, special: dict):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(spec).model
        self.letters = {b: c for c, b in byte_alphabet().items()}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in special.items()}
        self.marks = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.memo = Memo(self.ids_of, REMEMBERED, SHORT)

    def ids_of(self, piece: str) -> bytes:
        if piece.isascii() and piece[1:].isalpha() and piece[0] == " ":  # by far the most: letters spell themselves
            spelled = self.letters[32] + piece[1:]
        else:
            spelled = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def plain(self, text: str) -> bytes:
        pattern = LATIN_PATTERN if is_latin(text) else self.pattern
        if len(text) <= LONG_TEXT:
            return b"".join(map(self.memo.__getitem__, pattern.findall(text)))
        return b"".join(self.memo[m.group()] for m in pattern.finditer(text))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, in which special tokens count as such."""
        if self.marks is None or not self.marks.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [self.plain(text[at:m.start()]), self.special[m.group()]]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])


def _encoder(digest: str, shared) -> Encoder:
    """This worker's encoder for the tokenizer file of that digest."""
    held = remembered("packing")
    if held.get("of") != digest:
        held.clear()
        held.update(of=digest, coder=Encoder(*shared.value))
    return held["coder"]


def cut(n: int, capacity: int) -> list:
    """(start, length) of the pieces of ``n`` tokens: only the first may be short."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def tokenized(spark: SparkSession, text: Column, path: str, capacity: int = CAPACITY, separator: int = 0) -> Column:
    """array of (piece, start, length, ids): a document's ids and the separator,
    cut into pieces; ids are little-endian unsigned 32-bit."""
    _, special = load_tokenizer(path)
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    shared, digest = spark.sparkContext.broadcast((spec, special)), hashlib.sha256(spec.encode()).hexdigest()

    def run(texts: pd.Series) -> pd.Series:
        coder = _encoder(digest, shared)
        end = np.array([separator], dtype="<u4").tobytes()
        out = []
        for t in texts:
            ids = coder.encode(t or "") + end
            out.append([{"piece": i, "start": at, "length": n, "ids": ids[4 * at:4 * (at + n)]}
                        for i, (at, n) in enumerate(cut(len(ids) // 4, capacity))])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, PIECES)(text)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, separator: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids."""
    got = docs.select("doc_id", F.explode(tokenized(docs.sparkSession, F.col("text"), path, capacity, separator)).alias("p"))
    return got.select("doc_id", "p.piece", "p.start", "p.length", "p.ids")


class Solver:
    """Packs a histogram {length: count} into sequences of ``capacity``.

    ``placed`` has rows (length, rank_lo, count, first sequence, how many per
    sequence, offset there): documents of the length with ranks from rank_lo
    on go, so many per sequence, to consecutive sequences.
    """

    def __init__(self, histogram: dict, capacity: int = CAPACITY):
        if any(not 0 < s <= capacity for s in histogram):
            raise ValueError("lengths must be from 1 to the capacity")
        self.capacity = capacity
        self.left = {s: n for s, n in histogram.items() if n}
        self.sizes = sorted(self.left)
        self.rank = dict.fromkeys(self.left, 0)
        self.placed: list = []
        self.sequences = 0

    def take(self, size: int, count: int, sequence: int, per: int, offset: int) -> None:
        self.placed.append((size, self.rank[size], count, sequence, per, offset))
        self.rank[size] += count
        self.left[size] -= count
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def fix(self, members: list) -> None:
        """Fix as many equal sets of these lengths as the counts allow."""
        need = {s: members.count(s) for s in members}
        sets = min(self.left[s] // k for s, k in need.items())
        first, offset = self.sequences, 0
        for s, k in need.items():
            self.take(s, sets * k, first, k, offset)
            offset += s * k
        self.sequences += sets

    def smallest(self, without: int, k: int) -> list:
        """The k smallest lengths left beside one of ``without``."""
        out: list = []
        for s in self.sizes:
            out += [s] * min(k - len(out), self.left[s] - (s == without))
            if len(out) == k:
                break
        return out

    def pairs(self, j: int, room: int) -> tuple:
        """(largest sum, largest smaller member) over pairs beside j that fit in ``room``."""
        best = low = 0
        hi = len(self.sizes) - 1
        for lo, a in enumerate(self.sizes):
            if 2 * a > room:
                break
            if not self.left[a] - (a == j):
                continue
            while hi >= lo:
                b = self.sizes[hi]
                free = self.left[b] - (b == j) - (a == b)
                if a + b <= room and free > 0:
                    break
                if a + b <= room:  # b fits but none is left of it: the next smaller one
                    hi_free = hi - 1
                    while hi_free >= lo and self.left[self.sizes[hi_free]] - (self.sizes[hi_free] == j) - (self.sizes[hi_free] == a) <= 0:
                        hi_free -= 1
                    b = self.sizes[hi_free] if hi_free >= lo else 0
                    break
                hi -= 1
            else:
                b = 0
            if b:
                best, low = max(best, a + b), max(low, a)
        return best, low

    def largest(self, room: int, *used: int) -> int:
        """The largest length left that fits in ``room`` beside those used, or 0."""
        for i in range(bisect_right(self.sizes, room) - 1, -1, -1):
            s = self.sizes[i]
            if self.left[s] > used.count(s):
                return s
        return 0

    def dominating(self, j: int) -> list | None:
        """A set with j as its largest member that dominates all others, if a rule proves one.

        A set dominates another if the other's members can be dealt to its
        members so that each gets no more than its own length: swapping them
        never costs a sequence.
        """
        room = self.capacity - j
        mate = self.largest(room, j)
        if not mate:
            return [j]  # nothing fits beside it
        if mate == room:
            return [j, mate]  # fills the sequence
        small = self.smallest(j, 3)
        if len(small) < 2 or small[0] + small[1] > room:
            return [j, mate]  # one more fits at most, and this is the largest
        if len(small) < 3 or sum(small) > room:  # two more fit at most
            most, low = self.pairs(j, room)
            if most <= mate:
                return [j, mate]  # any two that fit can take the mate's place
            third = self.largest(room - mate, j, mate)
            if third >= low > 0:
                return [j, mate, third]  # larger mate than any, larger third than any smaller one
        return None

    def reduce(self) -> None:
        """Fix dominating sets, largest member first, until no rule applies."""
        before = None
        while before != self.sequences:
            before = self.sequences
            for j in self.sizes[::-1]:
                while j in self.left and (members := self.dominating(j)):
                    self.fix(members)

    def best_fit(self) -> None:
        """Best-fit decreasing of what is left; alike sequences are one group."""
        groups: list = [[] for _ in range(self.capacity + 1)]  # by room: (first sequence, how many)
        for s in self.sizes[::-1]:
            while n := self.left.get(s, 0):
                room = next((r for r in range(s, self.capacity + 1) if groups[r]), None)
                if room is None:
                    room, count = self.capacity, -(-n // (self.capacity // s))
                    groups[room].append((self.sequences, count))
                    self.sequences += count
                first, count = groups[room].pop()
                per = room // s
                full = min(count, n // per)
                if full:
                    self.take(s, full * per, first, per, self.capacity - room)
                    groups[room - per * s].append((first, full))
                elif n:
                    self.take(s, n, first, n, self.capacity - room)
                    groups[room - n * s].append((first, 1))
                    full = 1
                if count > full:
                    groups[room].append((first + full, count - full))

    def solve(self) -> list:
        self.reduce()
        self.best_fit()
        return self.placed


def _longs(spark: SparkSession, rows: list, names: list) -> DataFrame:
    """A small table of bigint columns, through Arrow: of rows as a list, Spark makes a job of
    Python workers of their own, which stay on the executors."""
    values = np.array(rows, dtype=np.int64).reshape(len(rows), len(names))
    return spark.createDataFrame(pa.table([pa.array(v) for v in values.T], names=names))


def pack(items: DataFrame, capacity: int = CAPACITY, key: tuple = ("doc_id", "piece")) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` from 1 to ``capacity``.

    ``items`` is read twice and should be a stage table. Rows keep all their
    columns but ones named sequence_id or offset, which are replaced.
    """
    spark = items.sparkSession
    items = items.drop("sequence_id", "offset")
    histogram = {r["length"]: r["count"] for r in items.groupBy("length").count().collect()}  # <= capacity rows
    placed = _longs(spark, Solver(histogram, capacity).solve(),
                    ["_p_length", "_p_lo", "_p_n", "_p_first", "_p_per", "_p_at"])
    salts = _longs(spark, [(s, -(-n // RANK_ROWS)) for s, n in histogram.items()], ["_p_size", "_p_salts"])
    # Both small tables have a bounded number of rows (a few per length).
    salted = (items.join(F.broadcast(salts), F.col("length") == F.col("_p_size"))
              .withColumn("_p_salt", F.pmod(F.xxhash64(*items.columns), "_p_salts")).drop("_p_size", "_p_salts"))
    before = (salted.groupBy("length", "_p_salt").count()
              .select(F.col("length").alias("_p_of"), F.col("_p_salt").alias("_p_in"),
                      (F.sum("count").over(W.partitionBy("length").orderBy("_p_salt")) - F.col("count")).alias("_p_before")))
    ranked = (salted.withColumn("_p_row", F.row_number().over(W.partitionBy("length", "_p_salt").orderBy(*key)))
              .join(before, (F.col("length") == F.col("_p_of")) & (F.col("_p_salt") == F.col("_p_in")))
              .withColumn("_p_rank", F.col("_p_before") + F.col("_p_row") - 1))
    at = F.col("_p_rank") - F.col("_p_lo")
    return (ranked.join(F.broadcast(placed), (F.col("length") == F.col("_p_length")) & at.between(0, F.col("_p_n") - 1))
            .withColumn("sequence_id", F.col("_p_first") + F.floor(at / F.col("_p_per")))
            .withColumn("offset", F.col("_p_at") + F.pmod(at, "_p_per") * F.col("length"))
            .select(*items.columns, "sequence_id", "offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (joined in
    place; little-endian unsigned 32-bit). A sequence has at most ``capacity`` pieces."""
    return (packed.groupBy("sequence_id")
            .agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
            .select("sequence_id", "n_tokens", F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")))
