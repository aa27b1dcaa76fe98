"""Near-duplicate vectors and documents against brute force."""

import collections
import re

import numpy as np
from nasty import documents, empty, sf_dir, words
from pyspark.sql import functions as F

from playlens.llm import components, embeddings, minhash, queries
from playlens.llm.common import stage
from playlens.llm.components import connected_components

VECTORS = "vec_id long, embedding array<float>, label int"


class Groups(dict):
    def root(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self[max(a, b)] = min(a, b)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (300, 299), (299, 300)]
    groups = Groups()
    for a, b in edges:
        groups.join(a, b)
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: groups.root(x) for x in groups}
    assert connected_components(empty(spark, "a long, b long")).count() == 0


def test_components_stop_at_stars(spark, monkeypatch):
    """Edges that are stars already need no round, others no further one to see that nothing changes."""
    written = []
    monkeypatch.setattr(components, "stage", lambda df, name: written.append(name) or stage(df, name))
    stars = spark.createDataFrame([(1, i) for i in range(2, 30)] + [(50, 51)], "a long, b long")
    assert dict(map(tuple, connected_components(stars).collect())) == {i: 1 for i in range(1, 30)} | {50: 50, 51: 50}
    assert written == ["edges"]
    written.clear()
    triangle = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "a long, b long")
    assert dict(map(tuple, connected_components(triangle).collect())) == {1: 1, 2: 1, 3: 1}
    assert written == ["edges", "stars"]


def test_no_plan_of_near_duplicates_is_long(spark, monkeypatch):
    """Adaptive execution sends the driver a plan after each of its stages: a long one fills its memory."""
    plans = {}

    def noted(df, name):
        plans[name] = max(plans.get(name, 0), len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString())))
        return stage(df, name)

    for module in (minhash, components):
        monkeypatch.setattr(module, "stage", noted)
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e g")], "doc_id long, text string")
    assert minhash.near_duplicates(docs).count() == 3
    assert max(plans.values()) <= 12, plans


def vectors(seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=16)
    rows = [(i, (centre + 0.1 * rng.normal(size=16)).astype(np.float32).tolist(), 1) for i in range(0, 600)]
    rows += [(1000 + i, rng.normal(size=16).astype(np.float32).tolist(), i % 3) for i in range(200)]
    copy = rows[3][1]
    rows += [(2000 + i, copy, 1) for i in range(30)] + [(2100, copy, 2), (2101, copy, None), (2102, [2 * x for x in copy], 1)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 16, 1), (3003, [None] + copy[1:], 1), (3004, [float("nan")] + copy[1:], 1),
             (3005, [float("inf")] + copy[1:], 1), (3006, copy[:8], 1), (None, copy, 1), rows[5], rows[5]]
    return rows


def test_vectors_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings.linked, "__defaults__", (0.98, 40))  # several blocks in the large bucket
    rows = vectors()
    good = [(v, l, np.array(e, float)) for v, e, l in rows if v is not None and l is not None and e
            and None not in e and np.isfinite(e).all() and any(e)]
    links, groups = collections.Counter(), Groups()
    for i, (v, l, x) in enumerate(good):
        for w, m, y in good[:i]:
            if l == m and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[v] += 1
                links[w] += 1
                groups.join(v, w)
    # rows that share an id count each other as rows
    df = spark.createDataFrame([(*r, "e", "e") for r in rows], VECTORS + ", kept string, rep string")
    got = queries.op1_embedding_dedup(spark, sf_dir(spark, embeddings=df)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (groups.root(r.vec_id) if r.vec_id is not None else None)
        assert r.kept == (r.vec_id == r.component_id)
        if r.vec_id != 5:
            assert r.n_links == links[r.vec_id], r


def test_vector_plan_and_collisions():
    for classes in (10, 10**4, 10**8):
        hashes, tables = embeddings.plan(classes)
        near = embeddings.collision(np.sqrt(2 - 2 * 0.98)) ** hashes
        assert (1 - near) ** tables <= embeddings.MISS * 1.0001
        assert embeddings.collision(np.sqrt(2)) ** hashes * classes <= 1.0001 or hashes == 4


def shingles(text):
    found = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    k = min(5, len(found))
    return {tuple(found[i:i + k]) for i in range(len(found) - k + 1)} if found else set()


def near_rows():
    """Copies, a chain of near copies, a large group that shares a passage only, and short texts."""
    base = words(50, 300).split()
    rows = [(i, " ".join(base)) for i in range(0, 40)]
    chain = list(base)
    for i in range(40, 60):
        chain[(i * 17) % 300] = f"changed{i}"
        rows.append((i, " ".join(chain)))
    passage = words(51, 200)
    rows += [(100 + i, passage + " " + words(1000 + i, 60, 10**6)) for i in range(300)]
    return rows + [(500 + i, words(2000 + i, 120)) for i in range(100)] + [(700, "a b"), (701, "A  b"), (702, "a b c")]


def test_documents_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash.between, "__defaults__", (85, 32))  # several blocks in the large bucket
    rows = near_rows() + [(r.doc_id, r.text) for r in documents(spark).collect() if r.doc_id is None]
    sets = {d: shingles(t) for d, t in rows if d is not None}
    groups, ids = Groups(), sorted(sets)
    for i, d in enumerate(ids):
        groups.root(d)
        for e in ids[:i]:
            if sets[d] and sets[e]:
                both = len(sets[d] & sets[e])
                if 100 * both >= 85 * (len(sets[d]) + len(sets[e]) - both):
                    groups.join(d, e)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"kept": F.lit("x"), "a": F.lit(1), "digest": F.lit(2)})
    got = queries.op9_minhash_dedup(spark, sf_dir(spark, documents=df)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), groups.root(r.doc_id), groups.root(r.doc_id) == r.doc_id)
    assert len({groups.root(d) for d in range(100, 400)}) == 300  # the passage alone links nothing


def test_nasty_documents(spark):
    got = queries.op9_minhash_dedup(spark, sf_dir(spark, documents=documents(spark, extra=True))).collect()
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    assert all(r.n_shingles == 0 and r.kept and r.component_id == d for d in (0, 1, 2) for r in by_id[d])
    assert by_id[5][0].component_id == 4 and by_id[10][0].component_id == 9
    assert {r.component_id for d in (11, 12, 13, 15) for r in by_id[d]} == {11} and len(by_id[11]) == 3
    assert by_id[14][0].kept
    assert len(by_id[None]) == 2 and all(r.kept and r.component_id is None for r in by_id[None])


def test_minhash_agreement_estimates_similarity():
    rng = np.random.default_rng(0)
    agree = []
    for _ in range(200):
        base = rng.integers(0, 2**63, 600).astype(np.uint64)
        x, y = base[46:], base[:-46]
        agree.append(np.mean(((x ^ minhash.XORS) * minhash.ODDS).min(1) == ((y ^ minhash.XORS) * minhash.ODDS).min(1)))
    assert abs(np.mean(agree) - 508 / 600) < 0.01


def test_empty_tables(spark):
    assert queries.op9_minhash_dedup(spark, sf_dir(spark, documents=empty(spark))).count() == 0
    assert queries.op1_embedding_dedup(spark, sf_dir(spark, embeddings=empty(spark, VECTORS))).count() == 0
