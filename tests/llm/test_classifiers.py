"""Language and quality: held-out accuracy, parts against brute force, nasty rows."""

import collections
import zlib

import numpy as np
from nasty import documents, empty, sf_dir
from pyspark.sql import functions as F

from playlens.llm import langid, quality, queries

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def test_language_held_out_accuracy(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op4_language_id(spark, SF).join(truth, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.985
    assert all(0 <= r.score <= 1 for r in got)
    for r in got[:50]:
        assert zlib.crc32(str(r.doc_id).encode()) % 3 == 1


def test_ngrams_match_brute_force():
    text = "Ab, c! É 12 \n x"
    clean = " ab c é x "
    grams = [clean[i:i + k] for k in (1, 2, 3) for i in range(len(clean) - k + 1)]
    count = langid.counts(text)
    assert count.sum() == len(grams)
    assert sorted(count[count > 0]) == sorted(collections.Counter(grams).values())
    assert langid.counts("12 !?") is None and langid.counts("") is None and langid.counts(None) is None
    assert (langid.counts("ab c é x") == count).all()


def test_ftrl_is_sparse_and_learns(monkeypatch):
    monkeypatch.setattr(langid, "L1", 1.0)
    rng = np.random.default_rng(0)
    learner = langid.Ftrl(2)
    for _ in range(400):
        label = int(rng.integers(2))
        at = np.unique(np.append(rng.integers(100, 400, 8), label))
        learner.learn(at, np.full(len(at), len(at) ** -0.5), label)
    w = learner.weights()
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0] and (w[100:400] == 0).mean() > 0.95 and (w[400:] == 0).all()


def test_temperature_minimises_log_loss():
    rng = np.random.default_rng(1)
    logits = rng.normal(0, 1, (4000, 3))
    labels = np.array([rng.choice(3, p=langid.softmax(z)) for z in logits])
    assert abs(langid.fit_temperature(logits * 5, labels) - 5) < 0.6
    assert langid.fit_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_language_on_nasty_rows(spark):
    rows = queries.op4_language_id(spark, sf_dir(spark, documents=documents(spark, extra=True))).collect()
    assert len(rows) == documents(spark).count()
    by_id = {r.doc_id: r for r in rows}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (0, 1, 2, 6, 8))
    assert all(r.lang_pred in ("en", "de", "und") and 0 <= r.score <= 1 for r in rows)
    assert queries.op4_language_id(spark, sf_dir(spark, documents=empty(spark))).count() == 0
    unlabelled = documents(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in queries.op4_language_id(spark, sf_dir(spark, documents=unlabelled)).collect()} == {"und"}


def test_document_frequencies_count_all_rows(spark):
    docs = spark.createDataFrame([("ab",), ("ab ab",), (None,), ("12",), ("c",)], "text string").repartition(3)
    n, df = langid.document_frequencies(docs)
    assert n == 3 and sorted(df[df > 0]) == sorted((sum((langid.counts(t) > 0).astype(int) for t in ("ab", "ab ab", "c")))[df > 0])


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op8_quality(spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95
    good, bad = [r.score for r in got if r.quality], [r.score for r in got if not r.quality]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.97


def test_prior_and_risk_on_known_mixture():
    rng = np.random.default_rng(2)
    positive = rng.normal(2, 1, (4000, 3))
    web = np.concatenate([rng.normal(2, 1, (4200, 3)), rng.normal(-2, 1, (1800, 3))])
    prior = quality.estimate_prior(positive, web[rng.permutation(6000)])
    assert abs(prior - 0.7) < 0.08
    net = quality.fit(positive, web, prior)
    fresh_good, fresh_bad = rng.normal(2, 1, (500, 3)), rng.normal(-2, 1, (500, 3))
    assert (net.logits(fresh_good) > 0).mean() > 0.95 and (net.logits(fresh_bad) < 0).mean() > 0.95


def test_quality_on_nasty_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(18)] + [(3, 1, 0), (3, 1, 0), (5, 0, 1), (None, 1, 0), (4, None, None), (99, 1, 0)], LABELS)
    rows = queries.op8_quality(spark, sf_dir(spark, documents=documents(spark, extra=True), labels=labels)).collect()
    assert len(rows) == documents(spark).count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    rows = queries.op8_quality(spark, sf_dir(spark, documents=documents(spark), labels=empty(spark, LABELS))).collect()
    assert {r.score for r in rows} == {0.5}
    assert queries.op8_quality(spark, sf_dir(spark, documents=empty(spark), labels=labels)).count() == 0


def test_trusted_needs_every_label(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (3, 0, 0), (4, None, 0)], LABELS)
    assert [r.doc_id for r in quality.trusted(labels).collect()] == [1]


def test_measures_of_any_text():
    sizes = {len(quality.measures(t)) for t in (None, "", " ", "\n\n", "a", "x" * 10**5, "é漢😀")}
    assert len(sizes) == 1 and all(np.isfinite(quality.measures(t)).all() for t in (None, "", "\n", "x", "!" * 9))
