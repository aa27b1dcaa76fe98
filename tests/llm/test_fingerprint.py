"""Sketches against a brute-force version with the same hash."""

import collections
import hashlib
import struct

import xxhash
from nasty import documents, empty, sf_dir, words
from pyspark.sql import functions as F

from playlens.llm import fingerprint as fp
from playlens.llm import queries


def x64(data, seed=42):
    v = xxhash.xxh64_intdigest(data, seed=seed & (2**64 - 1))
    return v - 2**64 if v >> 63 else v


def join(values):
    seed = 42
    for v in values:
        seed = x64(struct.pack("<q", v), seed)
    return seed


def every(text):
    import re
    h = [x64(w.encode()) for w in re.split(r"[ \t\n\x0b\f\r]+", (text or "").lower()) if w]
    if len(h) >= 5:
        return {join(h[i:i + 5]) for i in range(len(h) - 4)}
    if not h:
        return set()
    a = 0
    for v in h:
        a = join([a, v])
    return {a}


def sketch(text, k=fp.K):
    return sorted(every(text))[:k]


def likeness(a, b, k=fp.K):
    both = sorted(set(a) | set(b))[:k]
    return sum(x in a and x in b for x in both) / len(both) if both else 1.0


def spelled(s):
    return "".join(f"{x & (2**64 - 1):016x}" for x in s)


def test_query_on_nasty_documents(spark):
    got = queries.op6_fingerprints(spark, sf_dir(spark, documents=documents(spark, extra=True))).collect()
    rows = [(r.doc_id, r.text or "") for r in documents(spark).collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    want = collections.Counter()
    for i, (d, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        edit = t[:len(t) - half] + after[:half]
        a, b, c = sketch(t), sketch(edit), sketch(after)
        want[(d, len(t), hashlib.sha256(edit.encode()).hexdigest(), spelled(a), spelled(b), round(likeness(a, b), 9), round(likeness(a, c), 9))] += 1
    have = collections.Counter((*tuple(r)[:5], round(r.near_edited, 9), round(r.near_next, 9)) for r in got)
    assert have == want


def test_one_document_follows_itself(spark):
    one = documents(spark).where("doc_id = 11").limit(1)
    r = queries.op6_fingerprints(spark, sf_dir(spark, documents=one)).first()
    assert r.near_next == 1.0
    assert queries.op6_fingerprints(spark, sf_dir(spark, documents=empty(spark))).count() == 0


def test_sparse_ids_find_their_next(spark):
    ids = [-(2**40), -3, 0, 5, 6, 10**6, 2**50, 2**50 + 1]
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in fp.with_next(df).collect()}
    assert got == {i: f"text {ids[(n + 1) % len(ids)]}" for n, i in enumerate(ids)}


def test_merge_and_estimates(spark):
    a, b = words(1, 4000, 10**6), words(1, 2500, 10**6) + " " + words(2, 1500, 10**6)
    df = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, ab string")
    for c in ("a", "b", "ab"):
        df = fp.with_sketch(df, c, f"s{c}")
    r = df.select("sa", "sb", "sab", fp.merge(F.col("sa"), F.col("sb")).alias("m"), fp.resemblance(F.col("sa"), F.col("sb")).alias("j"),
                  fp.containment(F.col("sa"), F.col("sb")).alias("c"), fp.distinct_shingles(F.col("sa")).alias("n"),
                  fp.distinct_shingles(F.slice("sa", 1, 10)).alias("few")).first()
    union = every(a) | every(b)
    assert r.m == sorted(union)[:fp.K]
    true = len(every(a) & every(b)) / len(union)
    assert abs(r.j - true) < 0.12 and abs(r.c - len(every(a) & every(b)) / len(every(a))) < 0.15
    assert abs(r.n / len(every(a)) - 1) < 0.25 and r.few == 10
