"""Quality classifier learned from positives and unlabelled text.

Texts become a few dozen smoothed measures of their characters, words and lines. The
score is the sigmoid of a small two-layer network that minimises the non-negative
unbiased risk: with class prior p, p * loss(positives as 1) + max(0, loss(unlabelled
as 0) - p * loss(positives as 0)); where the bracket turns negative its gradient is
followed uphill, as usual for this risk. Only trusted positives and unlabelled text
are used, no negative labels. The prior is estimated from the two by best-bin
estimation: first networks tell positives from unlabelled text, and on rows that
they have not seen the prior is the least ratio (with its confidence bound) of the
share of unlabelled to the share of positive rows above a score.

At most about ``POSITIVES`` positive and ``UNLABELLED`` unlabelled documents, drawn by
a hash of the id, are measured on the executors; their measures (some 4 MB) are
fitted on the driver. Everything else covers all rows.

Cases: null text counts as empty, empty texts are scored as well; a document with
several labels is positive if all of them are 1; without a positive every score is
0.5; rows that share an id share their label; further columns are not read. Texts
are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playlens.llm.common import small_batches

POSITIVES = 8_000
UNLABELLED = 12_000
HIDDEN = 16
STEPS, BATCH, RATE, DECAY = 1500, 512, 0.01, 1e-4

#: Byte classes whose shares are measured.
CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t", b"\n\r", b".", b",", b"!?",
           b"|", b"#$%&*@^~+=", b"<>[]{}()\\/", b"'\"`", b":;-_", bytes(range(128, 256)))
_CLASS_OF = np.full(256, len(CLASSES), dtype=np.int64)
for _i, _c in enumerate(CLASSES):
    _CLASS_OF[list(_c)] = _i


def measures(text: str | None) -> list:
    """Smoothed measures of a whole text; short texts stay near the typical values."""
    text = text or ""
    raw = text.encode()
    by_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    by_class = np.bincount(_CLASS_OF, by_byte, minlength=len(CLASSES) + 1)
    words, lines = text.split(), [s for s in text.split("\n") if s.strip()]
    n, w, k = len(raw), len(words), len(lines)
    distinct = len(set(words))
    repeats = sum(map(eq, words, words[1:]))
    ends = sum(s.rstrip()[-1] in ".!?:\"')»”" for s in lines)
    seen = by_byte[by_byte > 0] / max(n, 1)
    return [*(by_class / (n + 40)).tolist(),
            np.log1p(n), np.log1p(w), np.log1p(distinct), distinct / (w + 10), repeats / (w + 10),
            (k - len(set(lines))) / (k + 3), np.log1p(n / (k + 1)), ends / (k + 1),
            n / (w + 10), float(-(seen @ np.log(seen))) if n else 0.0]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


@dataclass(frozen=True)
class Network:
    """Scores from standardised measures."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.standard(x) @ self.w1 + self.b1) @ self.w2 + self.b2

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = 7) -> Network:
    """Minimise the non-negative risk; without a prior, tell positives from unlabelled."""
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    mean, scale = both.mean(axis=0), both.std(axis=0) + 1e-6
    p, u = (np.clip((x - mean) / scale, -6, 6) for x in (positive, unlabelled))
    params = [rng.normal(0, 1 / np.sqrt(p.shape[1]), (p.shape[1], HIDDEN)), np.zeros(HIDDEN),
              rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(v) for v in params], [np.zeros_like(v) for v in params]
    for step in range(1, STEPS + 1):
        xp, xu = p[rng.integers(0, len(p), BATCH)], u[rng.integers(0, len(u), BATCH)]
        x = np.concatenate([xp, xu])
        h = np.tanh(x @ params[0] + params[1])
        s = _sigmoid(h @ params[2] + params[3][0])
        sp, su = s[:BATCH], s[BATCH:]
        # Logistic loss: d loss(as 1) / dz = s - 1, d loss(as 0) / dz = s.
        if prior is None:
            dz = np.concatenate([sp - 1, su])
        else:
            negative = -np.log(1 - su + 1e-12).mean() + prior * np.log(1 - sp + 1e-12).mean()
            if negative >= 0:
                dz = np.concatenate([prior * (sp - 1) - prior * sp, su])
            else:
                dz = np.concatenate([prior * sp, -su])
        dz = dz / BATCH
        dh = np.outer(dz, params[2]) * (1 - h * h)
        grads = [x.T @ dh, dh.sum(axis=0), h.T @ dz, np.array([dz.sum()])]
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for v, g, a, b in zip(params, grads, first, second):
            g = g + DECAY * v
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            v -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Network(mean, scale, params[0], params[1], params[2], float(params[3][0]))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, folds: int = 5) -> float:
    """Share of positives in the unlabelled rows by best-bin estimation on
    cross-fitted scores: each row is scored by a network that has not seen it.

    Returned is the lower end of the estimate's confidence interval: with a prior
    that is too high the risk lets bad text pass, one a little low costs nothing.
    """
    if len(positive) < 2 * folds or len(unlabelled) < 2 * folds:
        return 0.5
    scored: tuple = ([], [])
    for fold in range(folds):
        kept = [np.arange(len(x)) % folds != fold for x in (positive, unlabelled)]
        telling = fit(positive[kept[0]], unlabelled[kept[1]], None)
        for to, x, k in zip(scored, (positive, unlabelled), kept):
            to.append(telling.logits(x[~k]))
    sp, su = (np.sort(np.concatenate(x)) for x in scored)
    cuts = np.concatenate([sp, su])
    above_p = 1 - np.searchsorted(sp, cuts, "left") / len(sp)
    above_u = 1 - np.searchsorted(su, cuts, "left") / len(su)
    slack = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(sp)) + 1 / np.sqrt(len(su)))
    usable = above_p > slack
    if not usable.any():
        return 0.5
    bound = np.where(usable, (above_u + slack) / np.maximum(above_p, 1e-9), np.inf)
    best = int(bound.argmin())
    return float(np.clip((above_u[best] - slack) / above_p[best], 0.05, 0.99))


@dataclass(frozen=True)
class Model:
    network: Network | None
    prior: float

    def scores(self, texts: list) -> np.ndarray:
        if self.network is None or not texts:
            return np.full(len(texts), 0.5)
        return _sigmoid(self.network.logits(np.array([measures(t) for t in texts])))

    def score(self, spark: SparkSession, text: Column) -> Column:
        """double from 0 to 1; the model broadcast is a few kB."""
        shared = spark.sparkContext.broadcast(self)
        return F.pandas_udf(lambda texts: pd.Series(shared.value.scores(texts.tolist())), "double")(text)


def _drawn(df: DataFrame, n: int, bound: int, salt: str) -> DataFrame:
    """About ``bound`` of ``n`` rows by a hash of doc_id."""
    limit = int(min(1.0, bound / max(1, n)) * 1_000_000)
    return df.where(F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1_000_000)) < limit)


def _measured(docs: DataFrame) -> np.ndarray:
    """Measures of a bounded sample of documents, in a fixed order."""
    udf = F.pandas_udf(lambda texts: pd.Series([measures(t) for t in texts], dtype=object), "array<double>")
    rows = docs.select("doc_id", udf("text").alias("m")).toPandas()
    rows = sorted((i if i == i and i is not None else -1, *m) for i, m in zip(rows["doc_id"], rows["m"]))
    return np.array([r[1:] for r in rows], dtype=float).reshape(len(rows), len(measures("")))


def train(docs: DataFrame, positives: DataFrame, positive_bound: int = POSITIVES, unlabelled_bound: int = UNLABELLED) -> Model:
    """Learn from documents (doc_id, text) and the ids (doc_id) of trusted positives."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    positives = positives.select("doc_id").where("doc_id is not null").distinct()
    chosen = _drawn(positives, positives.count(), positive_bound, "positive")  # bounded: safe to broadcast
    known = _measured(docs.join(F.broadcast(chosen), "doc_id", "left_semi"))
    web = _measured(_drawn(docs, docs.count(), unlabelled_bound, "unlabelled"))
    if len(known) < 2 or len(web) < 2:
        return Model(None, 0.5)
    rng = np.random.default_rng(11)
    known, web = known[rng.permutation(len(known))], web[rng.permutation(len(web))]
    prior = estimate_prior(known, web)
    return Model(fit(known, web, prior), prior)


def trusted(labels: DataFrame) -> DataFrame:
    """Ids that all their labels mark as good: rows (doc_id, quality)."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("least")).where("least = 1").select("doc_id")
