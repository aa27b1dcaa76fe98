"""Language identification: sparse multinomial logistic regression on character n-grams.

A text is lower-cased, runs without letters become one space, and its 1- to 3-grams
are counted into ``BUCKETS`` hashed features, weighted log(1 + count) * idf and scaled
to length one. Document frequencies are counted over all training documents. The
weights are learned online by follow-the-regularised-leader (FTRL-proximal) with an
L1 and an L2 penalty, which leaves most of them zero, on a sample of at most about
``SAMPLE`` documents per language, drawn by a hash of the id; one task streams over
it and holds only weights. A fifth of the sample is kept back, and on it one
temperature is fitted that makes the softmax scores honest.

Cases: null text and text without letters get language ``und`` and score 0; rows with
null language or null text teach nothing; without any training row every text is
``und``; further columns are not read. Texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlens.llm.common import remembered, small_batches

BUCKETS = 1 << 15
ORDERS = 3
#: Training documents per language, in expectation.
SAMPLE = 1500
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 1e-4
UNDETERMINED = "und"

MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
_LETTERS: list = []


def letters() -> np.ndarray:
    """Whether each code point is a letter: 1 MB that a worker keeps, while what it remembered for others goes."""
    remembered("langid")
    if not _LETTERS:
        table = np.zeros(0x110000, dtype=bool)
        table[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = True
        _LETTERS.append(table)
    return _LETTERS[0]


def counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text; None without letters."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    is_letter = letters()[points]
    if not is_letter.any():
        return None
    points = np.where(is_letter, points, 32).astype(np.uint64)
    keep = is_letter.copy()
    keep[0] = True
    keep[1:] |= is_letter[:-1]  # of a run of other characters only the first
    points = np.concatenate([[np.uint64(32)], points[keep], [np.uint64(32)]])
    total = np.zeros(BUCKETS, dtype=np.int64)
    mixed = np.zeros(len(points), dtype=np.uint64)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    for order in range(min(ORDERS, len(points))):
        mixed = (mixed[:len(points) - order] + points[order:]) * MULTIPLIERS[order]
        total += np.bincount((mixed >> shift).astype(np.int64), minlength=BUCKETS)
    return total


def features(count: np.ndarray, idf: np.ndarray) -> tuple:
    """Indices and TF-IDF values of a text, of length one."""
    at = np.nonzero(count)[0]
    x = np.log1p(count[at]) * idf[at]
    return at, x / np.sqrt(x @ x)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """FTRL-proximal for a softmax over sparse rows."""

    def __init__(self, classes: int):
        self.z = np.zeros((BUCKETS, classes))
        self.n = np.zeros((BUCKETS, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = softmax(x @ w)
        error[label] -= 1
        g = x[:, None] * error
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        return -np.log(softmax(logits / np.exp(t))[np.arange(len(labels)), labels] + 1e-300).mean()

    lo, hi, step = np.log(0.02), np.log(10.0), (np.sqrt(5) - 1) / 2
    while hi - lo > 1e-3:
        a, b = hi - step * (hi - lo), lo + step * (hi - lo)
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


@dataclass(frozen=True)
class Model:
    languages: tuple
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def classify(self, text: str | None) -> tuple:
        """(language, probability)."""
        count = counts(text)
        if count is None or not self.languages:
            return UNDETERMINED, 0.0
        at, x = features(count, self.idf)
        p = softmax(x @ self.weights[at] / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])

    def predict(self, spark: SparkSession, text: Column) -> Column:
        """struct(lang, score); the model is broadcast, its size fixed by BUCKETS."""
        shared = spark.sparkContext.broadcast(self)

        def run(texts: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([shared.value.classify(t) for t in texts], columns=["lang", "score"])

        return F.pandas_udf(run, "lang string, score double")(text)


def document_frequencies(texts: DataFrame) -> tuple:
    """(documents with letters, documents per feature) of a column ``text``."""
    schema = pa.schema([("feature", pa.int32()), ("n", pa.int64())])

    def run(batches):
        total, docs = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                count = counts(t.as_py())
                if count is not None:
                    total += count > 0
                    docs += 1
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)),
                                          pa.array(np.append(total[at], docs))], schema=schema)

    rows = (texts.select("text").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n"))
            .toPandas())  # one row per feature at most
    df = np.zeros(BUCKETS + 1, dtype=np.int64)
    df[rows["feature"].to_numpy()] = rows["n"].to_numpy()
    return int(df[-1]), df[:-1]


def train(rows: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from rows of (doc_id, text, lang)."""
    spark = rows.sparkSession
    small_batches(spark)
    rows = rows.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    per_lang = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row per language
    languages = tuple(sorted(per_lang))
    docs, df = document_frequencies(rows)
    idf = np.log((1 + docs) / (1 + df)) + 1
    if not languages or not docs:
        return Model((), idf, np.zeros((BUCKETS, 0)), 1.0)
    share = F.create_map(*(x for k, n in per_lang.items() for x in (F.lit(k), F.lit(min(1.0, sample / n)))))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) / 1_000_000
    order = F.xxhash64("text", "doc_id")
    chosen = (rows.where(drawn < F.try_element_at(share, "lang"))
              .select("text", "lang", (F.pmod(order, F.lit(5)) == 0).alias("kept_back"), order.alias("o")))
    shared = spark.sparkContext.broadcast(idf)

    def run(batches):
        learner, logits, truth = Ftrl(len(languages)), [], []
        number = {k: i for i, k in enumerate(languages)}
        weights = None
        for batch in batches:
            for row in batch.to_pylist():
                count = counts(row["text"])
                if count is None:
                    continue
                at, x = features(count, shared.value)
                if not row["kept_back"]:
                    learner.learn(at, x, number[row["lang"]])
                else:
                    weights = learner.weights() if weights is None else weights
                    logits.append(x @ weights[at])
                    truth.append(number[row["lang"]])
        weights = learner.weights() if weights is None else weights
        t = fit_temperature(np.array(logits).reshape(-1, len(languages)), np.array(truth, dtype=int))
        yield pa.RecordBatch.from_pydict({"weights": [weights.astype(np.float32).tobytes()], "t": [t]})

    # A bounded sample: one task learns from it in a fixed order.
    model = chosen.repartition(1).sortWithinPartitions("kept_back", "o", "text").mapInArrow(run, "weights binary, t double").first()
    weights = np.frombuffer(model["weights"], np.float32).reshape(BUCKETS, len(languages)).astype(np.float64)
    return Model(languages, idf, weights, model["t"])
