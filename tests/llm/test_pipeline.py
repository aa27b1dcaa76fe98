"""The pipeline: each stage against its operator, whole run on nasty rows, oracles of the queries."""

import os
import sys

import pytest
from nasty import documents, empty, sf_dir, words
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline as cp  # noqa: E402
from oracle_check import compare, duck  # noqa: E402
from playlens.llm import minhash, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
LABELS = "doc_id long, quality int, toxic int"


def test_entry_has_every_operator_and_the_pipeline():
    assert {f"op{n}_" for n in range(1, 11)} == {k[:k.index("_") + 1] for k in queries.QUERIES}
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("key", sorted(queries.ORACLE_SQL))
def test_query_matches_oracle(spark, key):
    res, _ = compare(queries.QUERIES[key](spark, "/root/testdata/sf0.01"), duck("/root/testdata/sf0.01"), queries.ORACLE_SQL[key])
    assert res["ok"], res


@pytest.mark.parametrize("key", ["op6_fingerprints", "op7_pii_surrogates", "op10_chat"])
def test_native_operators_run_no_python(spark, key):
    plan = queries.QUERIES[key](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_stages_take_effect_and_keep_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("_rows", F.lit("x"))
    sf = "/root/testdata/sf0.01"
    kept = cp.language_id(spark, docs, sf).cache()
    scores = {r.doc_id: r for r in queries.op4_language_id(spark, sf).collect()}
    assert {r.doc_id for r in kept.collect()} == {d for d, r in scores.items() if r.score >= cp.MIN_LANGUAGE_SCORE}
    good = cp.quality_filter(spark, kept, sf).cache()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    left = {r.doc_id for r in good.collect()}
    assert all(d in left for d in {r.doc_id for r in kept.collect()} if labels.get(d) == 1)
    assert sum(d in left for d, q in labels.items() if q == 0) <= 0.1 * sum(q == 0 for q in labels.values())
    once = cp.near_dedup(spark, good, sf).cache()
    found = queries.minhash.near_duplicates(good).where("kept").select("doc_id").collect()
    assert sorted(r.doc_id for r in once.collect()) == sorted(r.doc_id for r in found)
    clean = cp.pii_surrogates(spark, once, sf).cache()
    for step in (kept, good, once, clean):
        assert step.columns == docs.columns
    assert clean.where("n_chars != char_length(text)").count() == 0
    assert clean.count() == once.count()
    packed = cp.best_fit_packing(spark, clean, sf)
    assert packed.select("doc_id").distinct().count() == clean.count()


def test_run_on_nasty_tables(spark):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(18)] + [(None, None, None)], LABELS)
    got = cp.run(spark, sf_dir(spark, documents=documents(spark, extra=True), labels=labels)).collect()
    ids = [r.doc_id for r in got if r.piece == 0]
    assert len({i for i in ids if i is not None}) == len([i for i in ids if i is not None])  # repeated rows once
    assert not {0, 1, 2, 6, 8} & set(ids) and {9, 11} <= set(ids) and not {10, 12, 13} & set(ids)
    alone = cp.near_dedup(spark, documents(spark, extra=True), "").collect()
    assert len([r for r in alone if r.doc_id is None]) == 2 and len([r for r in alone if r.doc_id == 11]) == 1
    assert cp.run(spark, sf_dir(spark, documents=empty(spark), labels=empty(spark, LABELS))).count() == 0


def test_near_dedup_loses_no_text_under_a_shared_id(spark):
    near = words(71, 60)
    rows = [(1, words(61, 50)), (1, words(62, 50)), (2, words(63, 50)), (1, words(61, 50)), (3, near), (3, near + " end"),
            (None, words(64, 50)), (None, words(65, 50)), (None, words(63, 50)), (-(2**63), words(66, 50)), (-(2**63), words(67, 50))]
    want = sorted(t for t in {t for _, t in rows} if t not in (near, near + " end"))
    for top in ([], [(2**63 - 1, words(68, 50)), (2**63 - 1, words(68, 50))]):
        docs = spark.createDataFrame([(*r, "x", i) for i, r in enumerate(rows[:9] if top else rows)] + [(*r, "y", 0) for r in top],
                                     "doc_id long, text string, _rows string, _own int")
        runs = [sorted(map(str, cp.near_dedup(spark, docs.repartition(n), "").collect())) for n in (1, 7)]
        assert runs[0] == runs[1]
        got = [r.text for r in cp.near_dedup(spark, docs, "").collect()]
        ends = [t for t in got if t.startswith(near)]
        kept = set(want) - ({words(66, 50), words(67, 50)} if top else set()) | ({words(68, 50)} if top else set())
        assert len(ends) == 1 and sorted(set(got) - set(ends)) == sorted(kept) and len(got) == len(kept) + 1


def test_near_dedup_takes_pairs_from_80_percent(spark):
    rows = []
    for i in range(60):
        base = words(7000 + i, 400, 10**6).split()
        near = list(base)
        for j in range(5 + i % 6):  # each changed word takes five shingles
            near[20 + j * 35] = f"changed{j}"
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
    sets = [set(minhash.shingle_set(t).tolist()) for _, t in rows]
    likeness = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert sum(0.80 <= x < 0.85 for x in likeness) >= 20 and min(likeness) < 0.80
    want = {2 * i for i in range(60)} | {2 * i + 1 for i, x in enumerate(likeness) if x < 0.80}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in cp.near_dedup(spark, docs, "").collect()} == want


def test_groups_follow_threshold_and_miss():
    for percent in (80, 85, 95):
        agree = (percent / 100) ** minhash.ROWS
        assert 2 * (1 - agree) ** minhash.plan(percent) <= minhash.MISS < 2 * (1 - agree) ** (minhash.plan(percent) - 1)
