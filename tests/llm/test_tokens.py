"""Byte-pair encoding against tiktoken; packing against brute force and tokenizers."""

import collections
import hashlib
import itertools
import random
import types
import weakref
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from nasty import documents, empty, sf_dir, texts
from pyspark import TaskContext
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from playlens.llm import bpe, langid, minhash, packing, queries
from playlens.llm.common import Memo

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocab():
    return bpe.build_vocabulary(bpe.load_ranks(RANKS))


@pytest.fixture(scope="module")
def reference(vocab):
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ids, special_tokens={})


def test_every_code_point_and_random_text(vocab, reference):
    rng = random.Random(4)
    some = ["".join(chr(c) for c in range(a, a + 48) if not 0xD800 <= c < 0xE000) for a in range(0, 0x11000, 48)]
    some += ["".join(rng.choice(["th", "e ", "in", "é", "  ", "\n", "9", "!?", "ß", "́"]) for _ in range(rng.randrange(90)))
             for _ in range(300)]
    known = {}
    assert bpe.encode_texts(vocab, some, known) == [reference.encode_ordinary(t) for t in some]


def test_matrix_and_heap_agree(vocab):
    rng = random.Random(5)
    pieces = [bytes(rng.choice(b"etaoin shrdlu") for _ in range(rng.randrange(2, 200))) for _ in range(300)]
    by_matrix = bpe.encode_pieces(vocab, pieces)
    assert [bpe.merge_long(vocab, p) if p not in vocab.ids else (vocab.ids[p],) for p in pieces] == by_matrix


def test_columns_on_nasty_rows(spark, reference):
    coder = bpe.ByteBpe(spark, RANKS)
    rows = documents(spark).select("doc_id", "text", coder.encode(F.col("text")).alias("ids"))
    for r in rows.withColumn("back", coder.decode(F.col("ids"))).collect():
        assert r.ids == reference.encode_ordinary(r.text or "")
        assert bytes(r.back) == (r.text or "").encode()
    assert empty(spark).select(coder.round_trip(F.col("text"))).count() == 0


def test_query_digests(spark, reference):
    got = queries.op2_bpe(spark, sf_dir(spark, documents=documents(spark, extra=True))).collect()
    want = collections.Counter()
    for r in documents(spark).collect():
        ids, raw = reference.encode_ordinary(r.text or ""), (r.text or "").encode()
        want[(r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest())] += 1
    assert collections.Counter(map(tuple, got)) == want


def optimum(items, capacity):
    best = [(99, 0)] * (1 << len(items))
    best[0] = (1, 0)
    for m in range(1, 1 << len(items)):
        found = (99, 0)
        for i in range(len(items)):
            if m >> i & 1:
                k, used = best[m ^ (1 << i)]
                found = min(found, (k, used + items[i]) if used + items[i] <= capacity else (k + 1, items[i]))
        best[m] = found
    return best[-1][0]


def spread(solver):
    """Sequences as sorted (offset, length) lists."""
    out = collections.defaultdict(list)
    for size, _, n, first, per, at in solver.placed:
        for i in range(n):
            out[first + i // per].append((at + i % per * size, size))
    return [sorted(v) for v in out.values()]


def test_reduction_keeps_the_optimum():
    rng = random.Random(3)
    for _ in range(400):
        capacity = rng.choice([10, 20, 50])
        items = [rng.randint(1, capacity) for _ in range(rng.randint(1, 9))]
        solver = packing.Solver(collections.Counter(items), capacity)
        solver.reduce()
        rest = [s for s, n in solver.left.items() for _ in range(n)]
        assert solver.sequences + (optimum(rest, capacity) if rest else 0) == optimum(items, capacity)
        solver.best_fit()
        for seq in spread(solver):
            ends = [0, *(a + s for a, s in seq)]
            assert [a for a, _ in seq] == ends[:-1] and ends[-1] <= capacity
        assert collections.Counter(s for seq in spread(solver) for _, s in seq) == collections.Counter(items)
        assert sorted(r for s, lo, n, *_ in solver.placed for r in [(s, lo + i) for i in range(n)]) == sorted(
            (s, i) for s, n in collections.Counter(items).items() for i in range(n))


def test_query_packs_every_token(spark):
    coder = Tokenizer.from_file(JSON)
    got = queries.op5_packing(spark, sf_dir(spark, documents=documents(spark, extra=True))).collect()
    want = collections.Counter()
    for r in documents(spark).collect():
        ids = coder.encode(r.text or "", add_special_tokens=False).ids + [0]
        for i, (at, n) in enumerate(packing.cut(len(ids), 2048)):
            want[(r.doc_id, i, at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes()))] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    by_sequence = collections.defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for seq in by_sequence.values():
        ends = [0, *(a + n for a, n in sorted(seq))]
        assert [a for a, _ in sorted(seq)] == ends[:-1] and ends[-1] <= 2048
    assert len(by_sequence) <= -(-sum(r.length for r in got) // 2048) + 1


def test_cut_leaves_only_the_first_piece_short():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(3, 4) == [(0, 3)]


def test_hot_length_spreads_and_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, "same text", None, None, 9) for i in range(3000)] + [(9000, texts()[9], None, None, 0)],
                                 documents(spark).schema)
    items = packing.pieces(docs, JSON).cache()
    packed = packing.pack(items.withColumns({"n": F.lit(1), "rank": F.lit("x")}))
    rows = packing.sequences(packed).collect()
    assert sum(r.n_tokens for r in rows) == items.agg(F.sum("length")).first()[0]
    assert all(len(r.ids) == 4 * r.n_tokens <= 4 * 2048 for r in rows)
    assert packed.select("doc_id", "piece").distinct().count() == items.count()


def test_empty_table(spark):
    assert queries.op5_packing(spark, sf_dir(spark, documents=empty(spark))).count() == 0
    assert queries.op2_bpe(spark, sf_dir(spark, documents=empty(spark))).count() == 0


def encoder():
    with open(JSON, encoding="utf-8") as f:
        return packing.Encoder(f.read(), packing.load_tokenizer(JSON)[1])


def test_ids_are_those_of_tokenizers():
    coder, ours, rng = Tokenizer.from_file(JSON), encoder(), random.Random(6)
    some = ["x".join(chr(c) + " " + chr(c) + "1" for c in range(a, a + 48) if not 0xD800 <= c < 0xE000)
            for a in range(0, 0x11000, 48)] + [t or "" for t in texts()]
    some += ["".join(rng.choice(["th", "e ", "'s", "é", "  ", "\n", "9", "!?", "'", "\u3000", "<|endoftext|>", "<|"]) for _ in range(rng.randrange(90)))
             for _ in range(300)]
    for t in some:
        assert ours.encode(t) == np.array(coder.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def test_latin_pattern_cuts_as_the_public_one():
    latin = [chr(i) for i in range(256)]
    whole = encoder().pattern
    some = [a + b + "a" + a for a in latin for b in latin]
    some += ["".join(c) for n in (3, 4) for c in itertools.product(["a", "Z", "5", "²", "é", "×", "'", "'s", "'ll", " ", "\n", "\x1c", "\xa0", "."], repeat=n)]
    for t in some:
        assert packing.LATIN_PATTERN.findall(t) == whole.findall(t), t


def test_memo_keeps_what_comes_again_and_is_bounded():
    asked = []
    memo = Memo(lambda s: asked.append(s) or len(s), entries=10, chars=5)
    for i in range(1000):
        assert memo[f"n{i}"] == len(f"n{i}") and memo["often"] == 5 and memo["longer"] == 6
        assert len(memo) <= 10 and len(memo.old) <= 10
    assert asked.count("often") == 1 and asked.count("longer") == 1000


def test_more_than_a_million_spaces_and_line_ends(spark):
    coder = Tokenizer.from_file(JSON)
    runs = [f"a{c * 1_200_000}b" for c in (" ", "\n", "\u3000")]
    docs = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string")
    got = collections.defaultdict(dict)
    for r in packing.pieces(docs, JSON).collect():
        got[r.doc_id][r.piece] = bytes(r.ids)
    for i, t in enumerate(runs):
        want = np.array(coder.encode(t, add_special_tokens=False).ids + [0], "<u4").tobytes()
        assert b"".join(got[i][k] for k in sorted(got[i])) == want


def test_worker_forgets_what_another_operator_remembered(monkeypatch):
    task = types.SimpleNamespace(number=1, taskAttemptId=lambda: task.number)
    monkeypatch.setattr(TaskContext, "_taskContext", task)
    with open(JSON, encoding="utf-8") as f:
        shared = types.SimpleNamespace(value=(f.read(), packing.load_tokenizer(JSON)[1]))
    for other in (lambda: minhash.shingle_set("some words"), lambda: langid.counts("some words")):
        held = weakref.ref(packing._encoder("digest", shared))
        other()
        assert packing._encoder("digest", shared) is held()  # operators in one task keep theirs
        task.number += 1
        assert packing._encoder("digest", shared) is held()  # for the next task too
        task.number += 1
        other()
        assert held() is None
        task.number += 1


def test_packing_plan_reaches_spark_without_python_workers(spark):
    items = spark.range(50).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), (F.col("id") % 9 * 200 + 1).alias("length"))
    packed = packing.pack(items)
    assert "ExistingRDD" not in packed._jdf.queryExecution().executedPlan().toString()
    assert packed.select("doc_id").distinct().count() == 50
    assert [r.left for r in packed.groupBy("sequence_id").agg((F.sum("length") - F.max(F.col("offset") + F.col("length"))).alias("left")).collect()] == \
        [0] * packed.select("sequence_id").distinct().count()
