"""Spelling variants against all pairs of words."""

import collections
import random
import re
import zlib

from nasty import documents, empty, sf_dir
from pyspark.sql import functions as F

from playlens.llm import queries, variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def brute(counts):
    out = {}
    for w, n in counts.items():
        near = [x for x in counts if one_edit(w, x)]
        best = min(near, key=lambda x: (-counts[x], x)) if near else None
        form = best if best and counts[best] >= 2 * n else None
        out[w] = [form, n, len(near), counts[form] if form else None]
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w].insert(1, root)
    return {w: tuple(r) for w, r in out.items()}


def found(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def counted(rows):
    """Words of (doc_id, text) rows by the query's rules, plainly."""
    counts = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def vocab(spark, counts):
    return spark.createDataFrame(list(counts.items()), "word string, n long")


def random_words(seed, n, letters="abcé", lo=1, hi=8):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randrange(lo, hi))): rng.choice([1, 2, 3, 4, 8, 9, 16, 40]) for _ in range(n)}


def test_against_all_pairs(spark):
    for seed, symbols in ((1, None), (2, 4), (3, 1)):
        counts = random_words(seed, 400)
        assert found(variants.spelling_variants(vocab(spark, counts), symbols)) == brute(counts)


def test_one_reduced_word_for_all_is_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK", 8)
    counts = random_words(5, 300, "abcdefghÿ", 5, 7)
    assert found(variants.spelling_variants(vocab(spark, counts), symbols=1)) == brute(counts)


def test_chains_ties_and_long_words(spark):
    long = "x" * 20_000
    counts = {"aaaaa": 1, "aaaab": 2, "aaabb": 4, "aabbb": 8, "abbbb": 16, "bbbbb": 32, "abbbc": 5, "cbbbb": 16,
              long: 3, long + "x": 9, long[1:]: 9, "q" + long[1:]: 1, "𝔘𝔫𝔦𝔠𝔬": 2, "𝔘𝔫𝔦𝔠𝔬𝔡": 4, "𝔘𝔫𝔦𝔠a": 1}
    got = found(variants.spelling_variants(vocab(spark, counts)))
    assert got == brute(counts)
    assert got["aaaaa"][1] == "bbbbb" and got[long][0] == long[1:]


def test_query_on_nasty_rows(spark):
    rng = random.Random(9)
    words = ["colour", "color", "colours", "naïve", "naive", "NAÏVE", "ÉTUDE", "étude", "Etude", "a÷bcde", "a×bcde", "straße", "strasse"]
    more = [(1000 + i if i % 7 else None, " ".join(rng.choice(words) for _ in range(60)), "en", "s", 0) for i in range(120)]
    docs = documents(spark, extra=True)
    wide = spark.createDataFrame([(*r, *["e"] * 8) for r in more], docs.schema)
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()] + [r[:2] for r in more]
    got = found(queries.op12_spelling_variants(spark, sf_dir(spark, documents=docs.unionByName(wide))))
    assert got == brute(counted(rows)) and any(r[0] for r in got.values())
    assert queries.op12_spelling_variants(spark, sf_dir(spark, documents=empty(spark))).count() == 0


def test_long_texts_are_counted_in_slices(monkeypatch):
    text = "Éa-bb÷c " * 40 + "z" * 50 + "1"
    whole = variants.runs(text)
    monkeypatch.setattr(variants, "SLICE_CHARS", 7)
    assert variants.runs(text) == whole and sum(whole.values()) == 81


def test_hot_root_is_spread(spark, monkeypatch):
    monkeypatch.setattr("playlens.llm.common.HOT_ROWS", 10)
    forms = spark.range(500).select(F.concat(F.lit("w"), "id").alias("word"), F.when(F.col("id") < 400, "w400").otherwise(
        F.concat(F.lit("w"), F.col("id") + 1)).alias("form"))
    assert {r.root for r in variants.roots(forms).collect()} == {"w500"}
