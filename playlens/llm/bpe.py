"""Byte-level BPE encoding and decoding with numpy matrices.

Texts are split by the public pattern. The distinct pieces of a slice of
texts are dealt into buckets by byte length; each bucket is one padded matrix
of token ids with a row per piece. In every round all rows merge their
leftmost pair of least rank at once; ranks of pairs come from an
open-addressed hash table in two arrays. Rows without a mergeable pair leave
the matrix, and the matrix narrows as its rows get shorter. Pieces longer than
``LONG`` bytes (white space, ruled lines, scripts without spaces) would make
quadratic work there and go through a heap instead; same merges, same result.

Cases: null text counts as empty; empty text gives no ids; texts are never
cut. Rows and columns beside the text are not looked at.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

NONE = np.int32(2**31 - 1)
EMPTY = np.uint64(2**64 - 1)
MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes from which a piece goes through the heap.
LONG = 256
#: Cells of one matrix; rows beyond go to a further one.
CELLS = 1 << 20
#: Distinct pieces that a worker remembers before it starts anew.
REMEMBERED = 600_000
#: Characters of text worked on at once.
SLICE_CHARS = 2_000_000


@dataclass(frozen=True)
class Vocabulary:
    """Tokens by id with the hashed table of mergeable pairs.

    Everything here is bounded by the vocabulary's size, not by the data.
    """

    tokens: tuple
    pair_keys: np.ndarray
    pair_ids: np.ndarray
    pattern: str

    @functools.cached_property
    def ids(self) -> dict:
        return {t: i for i, t in enumerate(self.tokens)}

    @functools.cached_property
    def decimals(self) -> list:
        return [str(i) for i in range(len(self.tokens))]

    @functools.cached_property
    def byte_ids(self) -> np.ndarray:
        return np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int32)

    @functools.cached_property
    def splitter(self):
        return regex.compile(self.pattern)


def load_ranks(path: str) -> list:
    """Tokens in order of rank from a file of ``base64 rank`` lines."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens: list = [None] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def build_vocabulary(tokens: list, pattern: str = public_tokenizers.PATTERN) -> Vocabulary:
    """Lay out every pair of tokens whose join is a token too."""
    ids = {t: i for i, t in enumerate(tokens)}
    keys, merged = [], []
    for i, token in enumerate(tokens):
        for cut in range(1, len(token)):
            left, right = ids.get(token[:cut]), ids.get(token[cut:])
            if left is not None and right is not None:
                keys.append(left << 32 | right)
                merged.append(i)
    size = 1 << (4 * len(keys)).bit_length()
    shift = np.uint64(64 - (size.bit_length() - 1))
    table, values = np.full(size, EMPTY), np.full(size, NONE, dtype=np.int32)
    pending = np.array(keys, dtype=np.uint64)
    found = np.array(merged, dtype=np.int32)
    slot = ((pending * MIX) >> shift).astype(np.int64)
    while len(pending):
        free = table[slot] == EMPTY
        _, first = np.unique(slot, return_index=True)
        take = np.zeros(len(slot), dtype=bool)
        take[first] = True
        take &= free
        table[slot[take]], values[slot[take]] = pending[take], found[take]
        pending, found, slot = pending[~take], found[~take], (slot[~take] + 1) & (size - 1)
    return Vocabulary(tuple(tokens), table, values, pattern)


def pair_ids(vocab: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Id (and rank) of each joined pair, ``NONE`` where they don't join.

    Negative ids are padding and never join.
    """
    size = len(vocab.pair_keys)
    shift = np.uint64(64 - (size.bit_length() - 1))
    key = (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))
    slot = ((key * MIX) >> shift).astype(np.int64)
    held = vocab.pair_keys[slot]
    out = np.where(held == key, vocab.pair_ids[slot], NONE)
    at = np.nonzero((held != key) & (held != EMPTY))
    while len(at[0]):
        slot[at] = (slot[at] + 1) & (size - 1)
        held = vocab.pair_keys[slot[at]]
        hit = held == key[at]
        out[tuple(a[hit] for a in at)] = vocab.pair_ids[slot[tuple(a[hit] for a in at)]]
        on = ~hit & (held != EMPTY)
        at = tuple(a[on] for a in at)
    return np.where((left < 0) | (right < 0), NONE, out)


def merge_matrix(vocab: Vocabulary, ids: np.ndarray, lengths: np.ndarray) -> list:
    """Merge all rows of a padded matrix (padding -1) to their final ids."""
    done: list = [None] * len(ids)
    rows = np.arange(len(ids))
    ranks = np.full(ids.shape, NONE, dtype=np.int32)
    ranks[:, :-1] = pair_ids(vocab, ids[:, :-1], ids[:, 1:])
    while len(rows):
        at = ranks.argmin(axis=1)
        best = ranks[np.arange(len(rows)), at]
        live = best != NONE
        if not live.all():
            for r, row, n in zip(rows[~live].tolist(), ids[~live].tolist(), lengths[~live].tolist()):
                done[r] = tuple(row[:n])
            rows, ids, ranks, lengths, at, best = (x[live] for x in (rows, ids, ranks, lengths, at, best))
            if not len(rows):
                break
            width = max(2, int(lengths.max()))
            ids, ranks = ids[:, :width], ranks[:, :width]
        every = np.arange(len(rows))
        cols = np.arange(ids.shape[1])
        take = np.minimum(cols + (cols > at[:, None]), ids.shape[1] - 1)
        ids[every, at] = best
        ids, ranks = np.take_along_axis(ids, take, 1), np.take_along_axis(ranks, take, 1)
        lengths = lengths - 1
        ids[every, lengths] = -1
        ranks[every, lengths] = NONE
        after = ids[every, np.minimum(at + 1, ids.shape[1] - 1)]
        ranks[every, at] = np.where(at + 1 < lengths, pair_ids(vocab, ids[every, at], after), NONE)
        before = every[at > 0]
        if len(before):
            left = at[before] - 1
            ranks[before, left] = pair_ids(vocab, ids[before, left], ids[before, left + 1])
    return done


def merge_long(vocab: Vocabulary, piece: bytes) -> tuple:
    """The same merges for one long piece: a heap of pairs over a linked list."""
    ids = vocab.byte_ids[np.frombuffer(piece, np.uint8)]
    first = pair_ids(vocab, ids[:-1], ids[1:]).tolist()
    ids = ids.tolist()
    n = len(ids)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = [(rank, i) for i, rank in enumerate(first) if rank != NONE]
    heapq.heapify(heap)
    now = [*first, int(NONE)]
    known, tokens = vocab.ids, vocab.tokens

    def pair(i: int) -> int:
        j = after[i]
        return known.get(tokens[ids[i]] + tokens[ids[j]], int(NONE)) if j >= 0 else int(NONE)

    while heap:
        rank, i = heapq.heappop(heap)
        if now[i] != rank or ids[i] < 0:
            continue
        j = after[i]
        ids[i], ids[j] = rank, -1
        now[j] = int(NONE)
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for k in (before[i], i):
            if k >= 0:
                now[k] = pair(k)
                if now[k] != NONE:
                    heapq.heappush(heap, (now[k], k))
    return tuple(i for i in ids if i >= 0)


def encode_pieces(vocab: Vocabulary, pieces: list) -> list:
    """Ids of each piece (bytes), in order."""
    out: list = [vocab.ids.get(p) for p in pieces]
    buckets: dict = {}
    for at, (p, whole) in enumerate(zip(pieces, out)):
        if whole is not None:
            out[at] = (whole,)
        elif len(p) > LONG:
            out[at] = merge_long(vocab, p)
        elif p:
            buckets.setdefault((len(p) - 1).bit_length(), []).append(at)
        else:
            out[at] = ()
    for power, members in buckets.items():
        width = 1 << power
        step = max(1, CELLS // width)
        for lo in range(0, len(members), step):
            part = members[lo:lo + step]
            lengths = np.array([len(pieces[i]) for i in part])
            joined = np.frombuffer(b"".join(pieces[i].ljust(width, b"\0") for i in part), np.uint8)
            ids = vocab.byte_ids[joined].reshape(len(part), width)
            ids[np.arange(width) >= lengths[:, None]] = -1
            for i, got in zip(part, merge_matrix(vocab, ids, lengths)):
                out[i] = got
    return out


def encode_texts(vocab: Vocabulary, texts: list, known: dict) -> list:
    """Ids of each text (list of int). ``known`` remembers pieces between calls."""
    find = vocab.splitter.findall
    split = [find(t) if t else [] for t in texts]
    if len(known) > REMEMBERED:
        known.clear()
    new = list(set(chain.from_iterable(split)).difference(known))
    known.update(zip(new, encode_pieces(vocab, [p.encode() for p in new])))
    look = known.__getitem__
    return [list(chain.from_iterable(map(look, pieces))) for pieces in split]


def decode_ids(vocab: Vocabulary, ids: list) -> bytes:
    """Bytes of a list of ids."""
    return b"".join(map(vocab.tokens.__getitem__, ids))


def slices(texts: list):
    """Index ranges of about ``SLICE_CHARS`` characters; one text at least."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SLICE_CHARS:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


_KNOWN: dict = {}


def remembered(vocab: Vocabulary) -> dict:
    """This worker's pieces for this vocabulary."""
    if _KNOWN.get("of") is not vocab:
        _KNOWN.clear()
        _KNOWN.update(of=vocab, pieces={})
    return _KNOWN["pieces"]


class ByteBpe:
    """Column functions over a vocabulary that is broadcast once (a few MB)."""

    def __init__(self, spark: SparkSession, path: str, pattern: str = public_tokenizers.PATTERN):
        self._vocab = spark.sparkContext.broadcast(build_vocabulary(load_ranks(path), pattern))

    def encode(self, text: Column) -> Column:
        """array<int>: ids of the text; null counts as empty."""
        shared = self._vocab

        def run(texts: pd.Series) -> pd.Series:
            vocab = shared.value
            whole = [t or "" for t in texts]
            out = []
            for lo, hi in slices(whole):
                out += encode_texts(vocab, whole[lo:hi], remembered(vocab))
            return pd.Series(out, dtype=object)

        return F.pandas_udf(run, "array<int>")(text)

    def decode(self, ids: Column) -> Column:
        """binary: bytes of an array of ids; null counts as empty."""
        shared = self._vocab

        def run(rows: pd.Series) -> pd.Series:
            return pd.Series([decode_ids(shared.value, [] if r is None else list(r)) for r in rows], dtype=object)

        return F.pandas_udf(run, "binary")(ids)

    def round_trip(self, text: Column) -> Column:
        """struct(n_tokens, ids_sha256, decoded_sha256) of encoding a text and
        decoding its ids, without sending the ids through the JVM between."""
        shared = self._vocab

        def run(texts: pd.Series) -> pd.DataFrame:
            vocab = shared.value
            whole = [t or "" for t in texts]
            decimal = vocab.decimals.__getitem__
            rows = []
            for lo, hi in slices(whole):
                for ids in encode_texts(vocab, whole[lo:hi], remembered(vocab)):
                    spelled = " ".join(map(decimal, ids)).encode()
                    rows.append((len(ids), hashlib.sha256(spelled).hexdigest(),
                                 hashlib.sha256(decode_ids(vocab, ids)).hexdigest()))
            return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

        return F.pandas_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string")(text)
