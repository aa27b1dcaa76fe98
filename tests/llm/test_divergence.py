"""Source divergence against plain sums over all terms."""

import collections
import random
import re

import numpy as np
from nasty import documents, empty, sf_dir
from pyspark.sql import functions as F

from playlens.llm import divergence, queries


def brute(rows, min_docs=30, top=50):
    groups, docs_of = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        found = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in found]
        groups[lang, source].update(found)
        docs_of[lang].update(set(found))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in docs_of[lang].items() if n >= min_docs)
        mine = {s: c for (g, s), c in groups.items() if g == lang}
        whole = collections.Counter()
        for c in mine.values():
            whole.update({t: c[t] for t in kept})

        def prices(c):
            n = sum(c[t] for t in kept)
            return [1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept]

        p, q = {s: prices(c) for s, c in mine.items()}, prices(whole)
        for s in mine:
            pairs = [(sum(abs(a - b) for a, b in zip(p[s], p[o])), o) for o in mine if o != s]
            terms = [(a - b, t) for t, a, b in zip(kept, p[s], q) if mine[s][t] and a > b]
            for part, found, cut in (("pair", pairs, None), ("term", terms, top)):
                for i, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:cut]):
                    out.add((lang, s, part, item, v, i + 1))
    return out


def rows_of(n, seed, sources=11, langs=("en", "de", None, "")):
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice(['word', 'Ünter', '漢字', 'x'])}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    out = []
    for i in range(n):
        s = rng.choice([None, *(f"s{k}" for k in range(sources))])
        words = [rng.choice(vocabulary[:40 + 15 * (hash(s) % 7)]) for _ in range(rng.randrange(0, 60))]
        out.append((rng.choice(langs), s, None if i % 50 == 0 else rng.choice([" ", ", ", "9"]).join(words).upper() if i % 3 else " ".join(words)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string")


def found(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def test_against_plain_sums_in_small_blocks_and_tiles(spark):
    rows = rows_of(700, 1)
    want = brute(rows, 20)
    assert found(divergence.audit(frame(spark, rows), min_docs=20, block=16, tile=3)) == want
    assert found(divergence.audit(frame(spark, rows), min_docs=20)) == want


def test_query_on_nasty_rows(spark):
    rng = random.Random(3)
    more = [(None, " ".join(rng.choice(["the", "of", "Ωmega", "tie", "eit"]) for _ in range(9)), "en", f"s{i % 4}", 0) for i in range(80)]
    docs = documents(spark, extra=True)
    wide = spark.createDataFrame([(*r, *["e"] * 8) for r in more], docs.schema)
    every = [(r.lang, r.source, r.text) for r in documents(spark).collect()] + [(r[2], r[3], r[1]) for r in more]
    assert found(queries.op13_source_divergence(spark, sf_dir(spark, documents=docs.unionByName(wide)))) == brute(every)
    assert queries.op13_source_divergence(spark, sf_dir(spark, documents=empty(spark))).count() == 0


def test_languages_without_kept_terms_have_pairs_of_no_difference(spark):
    rows = [("xx", s, "few words") for s in ("b", "a", None)]
    got = found(divergence.audit(frame(spark, rows)))
    assert got == brute(rows) and {r[4] for r in got} == {0} and len(got) == 6


def test_galloping_finds_every_common_id():
    rng = np.random.default_rng(1)
    for n, m, most in ((0, 5, 9), (5, 0, 9), (1, 1, 1), (700, 700, 900), (300, 60_000, 100_000), (2000, 2001, 10**12), (3000, 9000, 9000)):
        a, b = (np.unique(rng.integers(0, most + 1, k)) for k in (n, m))
        i, j = divergence.gallop(a, b)
        want = np.intersect1d(a, b)
        assert (a[i] == want).all() and (b[j] == want).all() and len(i) == len(want)


def test_prices_are_exact_for_large_counts():
    counts = [0, 1, 7, 10**6 + 3, 10**12 + 9, 8 * 10**15]
    total = 9 * 10**15 - 7
    assert divergence.price(np.array(counts), total).tolist() == [1 + 10**9 * (c + 5) // total for c in counts]


def test_long_texts_are_counted_in_slices(monkeypatch):
    text = "Aé1漢b!cc " * 50 + "z" * 100
    whole = divergence.terms(text)
    monkeypatch.setattr(divergence, "SLICE_CHARS", 7)
    assert divergence.terms(text) == whole
    monkeypatch.setattr(divergence, "HELD", 1)


def test_a_source_with_a_third_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 50)
    rows = rows_of(200, 5) + [("en", "s1", "worda wordb wordc")] * 100
    assert found(divergence.audit(frame(spark, rows), min_docs=5)) == brute(rows, 5)
