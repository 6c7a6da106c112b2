"""Quality classifier by positive-unlabelled learning.

Trusted positives are the documents labelled good; the unlabelled set is web text as it comes. Rejected labels are never used. A
small network over measures of style is fitted by minimising the non-negative unbiased risk
``prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])`` with the logistic loss, so its output is the log odds of "good".
The class prior is estimated from the two samples alone: a first classifier of positives against unlabelled gives a score, and the
prior is the smallest ratio of unlabelled to positive mass above a threshold, since no mixture can hold more positives than that.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import internal

SAMPLE = 20_000
FOLDS = 5
HELD_OUT_FOLD = 0
THRESHOLD = 0.3
HIDDEN = 12
FEATURES = 14

_UPPER, _DIGIT = np.zeros(256), np.zeros(256)
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_LETTER = np.zeros(256)
_LETTER[65:91] = _LETTER[97:123] = 1
_LETTER[128:192] = 0.5  # two bytes make one letter of most alphabets
_LETTER[192:] = 0.5
_POINT = np.zeros(256)
_POINT[[ord(c) for c in ".,;:'\"()-?"]] = 1
_BLANK = np.zeros(256)
_BLANK[[9, 10, 11, 12, 13, 32]] = 1
_ODD = np.ones(256) - np.ceil(_LETTER) - _POINT - _BLANK - _DIGIT
_CLASSES = np.stack([_UPPER, _DIGIT, _LETTER, _POINT, _BLANK, _ODD], axis=1)
_BANG = ord("!")


def measures(text: str | None) -> list[float]:
    """Shares of character classes and of repetition over the whole text. All zero for null, empty and blank texts."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    upper, digit, letter, point, blank, odd = (counts @ _CLASSES).tolist()
    size = len(text)
    distinct = len(set(words))
    same = sum([a == b for a, b in pairwise(words)])
    pairs = len(set(pairwise(words)))
    lines = text.split("\n")
    return [
        upper / (letter + 1), digit / size, letter / size, point / size, blank / size, odd / size, float(counts[_BANG]) / size,
        np.log(distinct) / np.log(n + 1), same / n, pairs / max(n - 1, 1), min(size / n, 40.0) / 10, np.log1p(n) / 10,
        len(set(lines)) / len(lines), (counts[124] + counts[123] + counts[125]) / n,
    ]


class Network:
    """One hidden layer of tanh units beside a linear term; plain arrays, so that it travels inside a task closure."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 7) -> None:
        r = np.random.RandomState(seed)
        d = len(mean)
        self.mean, self.scale = mean, scale
        self.p = [r.randn(d, HIDDEN) / np.sqrt(d), np.zeros(HIDDEN), r.randn(HIDDEN) / np.sqrt(HIDDEN), np.zeros(d), np.zeros(1)]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ self.p[0] + self.p[1])
        return z, h, h @ self.p[2] + z @ self.p[3] + self.p[4]

    def gradient(self, z: np.ndarray, h: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        back = g[:, None] * self.p[2] * (1 - h * h)
        return [z.T @ back, back.sum(0), h.T @ g, z.T @ g, np.array([g.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward(x)[2])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = 400, rate: float = 0.02,
        decay: float = 1e-4) -> Network:
    """Adam on the non-negative risk; without a prior, the plain classifier of positives against unlabelled."""
    both = np.concatenate([positive, unlabelled])
    net = Network(both.mean(0), both.std(0) + 1e-6)
    m, v = [np.zeros_like(p) for p in net.p], [np.zeros_like(p) for p in net.p]
    for step in range(1, steps + 1):
        zp, hp, gp = net.forward(positive)
        zu, hu, gu = net.forward(unlabelled)
        sp, su = _sigmoid(gp), _sigmoid(gu)
        if prior is None:
            dp, du = (sp - 1) / len(gp), su / len(gu)
        else:
            excess = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
            # The part of the negatives must not fall below zero: there its gradient is turned round.
            dp, du = (prior * (sp - 1) - prior * sp, su) if excess >= 0 else (prior * sp, -su)
            dp, du = dp / len(gp), du / len(gu)
        grads = [a + b + decay * p for a, b, p in zip(net.gradient(zp, hp, dp), net.gradient(zu, hu, du), net.p, strict=True)]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            net.p[i] = net.p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives in the unlabelled sample: least ratio of the masses above a threshold, down to a tenth of the positives."""
    half_p, half_u = len(positive) // 2, len(unlabelled) // 2
    net = fit(positive[:half_p], unlabelled[:half_u], None)
    p, u = np.sort(net.score(positive[half_p:])), np.sort(net.score(unlabelled[half_u:]))
    cuts = np.quantile(p, np.linspace(0.0, 0.9, 46))
    above_p = 1 - np.searchsorted(p, cuts) / len(p)
    above_u = 1 - np.searchsorted(u, cuts) / len(u)
    noise = np.sqrt(above_u * (1 - above_u) / len(u)) / above_p + np.sqrt(above_p * (1 - above_p) / len(p)) / above_p
    return float(np.clip(np.min(above_u / above_p + noise), 0.02, 0.99))


def fold(doc_id: str | Column, folds: int = FOLDS) -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def bounded(rows: DataFrame, key: str, bound: int, n: int, seed: int) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of ``key``, whatever the size of ``rows``."""
    share = min(1.0, bound / max(n, 1))
    return rows if share >= 1.0 else rows.filter(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int(share * (1 << 30)))


def _measured(rows: DataFrame) -> np.ndarray:
    udf = F.pandas_udf(lambda s: s.map(measures), "array<double>")
    frame = rows.select(udf(F.coalesce("text", F.lit(""))).alias("x")).toPandas()
    return np.array(frame["x"].tolist(), dtype=np.float64).reshape(-1, FEATURES)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, folds: int = FOLDS,
          held_out: int = HELD_OUT_FOLD) -> Network | None:
    """The classifier, from at most about ``sample`` labelled positives and as many unlabelled documents, both outside the held-out
    fold and chosen by a hash of doc_id. Null labels and ids teach nothing. None if there are fewer than 20 of either kind."""
    good = internal(labels, doc_id="doc_id", y=label).filter(F.col("y") == 1).filter(fold("doc_id", folds) != held_out)
    good = bounded(good.select("doc_id").distinct(), "doc_id", sample, good.count(), 11)
    base = internal(docs, doc_id="doc_id", text="text").filter(fold("doc_id", folds) != held_out)
    positive = _measured(base.join(F.broadcast(good), "doc_id", "left_semi"))  # at most about `sample` ids
    unlabelled = _measured(bounded(base, "doc_id", sample, docs.count(), 13))
    if min(len(positive), len(unlabelled)) < 20:
        return None
    return fit(positive, unlabelled, estimate_prior(positive, unlabelled))


def scored(docs: DataFrame, model: Network | None) -> Column:
    """Score column over ``text``: the probability of "good", 0.5 without a model. Null texts count as empty."""
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            x = np.array([measures(t) for t in s], dtype=np.float64).reshape(-1, FEATURES)
            yield pd.Series(model.score(x) if model else np.full(len(s), 0.5))

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(F.coalesce(F.col("text"), F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, folds: int = FOLDS, held_out: int = HELD_OUT_FOLD,
             **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Rows are scored one by one: repeated rows get equal scores, a null doc_id is
    not held out, null and empty texts get the score of an empty text, an empty table gives no rows. Other columns are ignored."""
    model = train(docs, labels, folds=folds, held_out=held_out, **options)
    rows = internal(docs, doc_id="doc_id", text="text")
    out = rows.select("doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), scored(rows, model).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))


