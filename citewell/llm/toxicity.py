"""Toxicity by a factorization machine over hashed terms.

A document is the set of its lower-cased runs of letters and of their stems, hashed into 2^20 buckets. Its log odds are
``b + sum w_i + 1/2 sum_f ((sum v_if)^2 - sum v_if^2)``: additive weights plus a product for every pair of terms, so an insult next to the
mention of a group can weigh more than both alone. Training runs in two steps on a bounded sample: proximal gradient steps with an L1
penalty screen the buckets, then weights and factors of the buckets that stay are fitted together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import internal
from .quality import bounded, fold
from .words import LETTERS, word_hashes

SAMPLE = 16_000
_BLOCK = 1 << 20
FOLDS = 4
HELD_OUT_FOLD = 2
THRESHOLD = 0.3
BITS = 20
FACTORS = 6
ACTIVE = 2048
STEMS = (4, 6)  # bytes of the stems that count as terms too: insults are inflected


def terms(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct buckets of each text. Texts without a letter have none."""
    out: list[np.ndarray] = [np.empty(0, np.int32)] * len(texts)
    for at, group in word_hashes([t.lower() for t in texts], LETTERS, STEMS):
        for i, h in enumerate(group):
            out[at + i] = np.unique((h >> np.uint64(64 - BITS)).astype(np.int32))
    return out


class Rows:
    """Sparse 0/1 rows with sums along both directions, worked on in blocks so that no temporary is as long as the data."""

    def __init__(self, index: np.ndarray, sizes: np.ndarray, width: int) -> None:
        self.index, self.sizes, self.width = index, sizes, width
        ends = np.cumsum(sizes)
        edges = np.searchsorted(ends, np.arange(_BLOCK, (ends[-1] if len(ends) else 0) + _BLOCK, _BLOCK), side="left") + 1
        edges = np.unique(np.concatenate([[0], np.minimum(edges, len(sizes))]))
        self.blocks = [(a, b, int(ends[a] - sizes[a]), int(ends[b - 1])) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]

    @classmethod
    def of(cls, lists: list[np.ndarray], place: np.ndarray, width: int) -> Rows:
        """Rows of the buckets that have a place."""
        found = [p[p >= 0] for p in (place[t] for t in lists)]
        return cls(np.concatenate([*found, np.empty(0, np.int32)]).astype(np.int32), np.array([len(x) for x in found], dtype=np.int64), width)

    def dot(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.sizes))
        for a, b, lo, hi in self.blocks:
            sizes = self.sizes[a:b]
            some = np.flatnonzero(sizes)
            if len(some):
                out[a + some] = np.add.reduceat(w[self.index[lo:hi]], (np.cumsum(sizes) - sizes)[some])
        return out

    def back(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        for a, b, lo, hi in self.blocks:
            out += np.bincount(self.index[lo:hi], weights=np.repeat(g[a:b], self.sizes[a:b]), minlength=self.width)
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


class Machine:
    """Fitted weights of the buckets that count; all others weigh nothing."""

    def __init__(self, bias: float, buckets: np.ndarray, w: np.ndarray, v: np.ndarray) -> None:
        self.bias, self.w, self.v = bias, w, v
        self.place = np.full(1 << BITS, -1, dtype=np.int16)
        self.place[buckets] = np.arange(len(buckets))

    def rows(self, texts: list[str]) -> Rows:
        return Rows.of(terms(texts), self.place, len(self.w))

    def score(self, texts: list[str]) -> np.ndarray:
        return _sigmoid(_odds(self.rows(texts), self.bias, self.w, self.v)[0])


def _odds(x: Rows, b: float, w: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    sums = [x.dot(v[:, f]) for f in range(v.shape[1])]
    z = b + x.dot(w) + 0.5 * (sum(s * s for s in sums) - x.dot((v * v).sum(1)))
    return z, sums


def fit(lists: list[np.ndarray], y: np.ndarray, penalty: float = 2e-3, ridge: float = 2e-5, factor_ridge: float = 2e-2, screen_steps: int = 80, steps: int = 150,
        least_rows: int = 4, seed: int = 5) -> Machine:
    y = y.astype(np.float64)
    seen = np.zeros(1 << BITS, dtype=np.int64)
    for t in lists:
        seen[t] += 1
    kept = np.flatnonzero(seen >= least_rows)
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept))
    x = Rows.of(lists, place, len(kept))
    # Screening: accelerated proximal gradient on columns scaled to unit variance, so that rare terms can speak.
    share = seen[kept] / len(y)
    scale = 1 / np.sqrt(share * (1 - share) + 1e-4)
    rate = y.mean()
    b = np.log(rate / (1 - rate))
    w = back = np.zeros(len(kept))
    size, t = 8.0 / max(1.0, np.sqrt(np.mean(x.sizes)) * 4), 1.0
    for _ in range(screen_steps):
        g = (_sigmoid(b + x.dot(back * scale) - (back * scale * share).sum()) - y) / len(y)
        grad = (x.back(g) - share * g.sum()) * scale
        step = back - size * grad
        new = np.sign(step) * np.maximum(np.abs(step) - size * penalty * 10, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        back, w, t = new + (t - 1) / t_new * (new - w), new, t_new
        b -= 4 * size * g.sum()
    strength = np.abs(w) + 1e-9 * np.abs((x.back(y) - share * y.sum()) * scale)
    best = np.sort(np.argsort(-strength)[:ACTIVE])
    start = w[best] * scale[best]
    place[:] = -1
    place[kept[best]] = np.arange(len(best))
    z = Rows.of(lists, place, len(best))
    r = np.random.RandomState(seed)
    p = [np.array([b - (w * scale * share).sum()]), start, r.randn(len(best), FACTORS) * 0.02]
    m, s = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for step in range(1, steps + 1):
        odds, sums = _odds(z, p[0][0], p[1], p[2])
        g = (_sigmoid(odds) - y) / len(y)
        col = z.back(g)
        gv = np.stack([z.back(g * sums[f]) - p[2][:, f] * col for f in range(FACTORS)], axis=1)
        grads = [np.array([g.sum()]), col + ridge * p[1] + ridge * np.sign(p[1]), gv + factor_ridge * p[2]]
        for i, q in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * q
            s[i] = 0.999 * s[i] + 0.001 * q * q
            p[i] = p[i] - 0.03 * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
    return Machine(float(p[0][0]), kept[best], p[1], p[2])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, folds: int = FOLDS,
          held_out: int = HELD_OUT_FOLD) -> Machine | None:
    """The machine, from at most about ``sample`` labelled documents outside the held-out fold, chosen by a hash of doc_id. Null labels and
    ids teach nothing. None if one class has fewer than 5 rows."""
    known = internal(labels, doc_id="doc_id", y=label).filter(F.col("y").isin(0, 1)).filter(fold("doc_id", folds) != held_out)
    known = bounded(known.groupBy("doc_id").agg(F.max("y").alias("y")), "doc_id", sample, known.count(), 17)
    base = internal(docs, doc_id="doc_id", text="text").join(F.broadcast(known), "doc_id")  # at most about `sample` ids

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = terms(part["text"].fillna("").tolist())
            yield pd.DataFrame({"y": part["y"].astype("int32"), "t": [x.astype("<i4").tobytes() for x in found]})

    rows = base.select("y", "text").mapInPandas(run, "y int, t binary").toPandas()
    y = rows["y"].to_numpy()
    if min((y == 1).sum(), (y == 0).sum()) < 5:
        return None
    return fit([np.frombuffer(x, "<i4") for x in rows["t"]], y)


def scored(model: Machine | None) -> Column:
    """Score column over ``text``; 0 without a model. Null texts count as empty."""
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series(model.score(s.tolist()) if model and len(s) else np.zeros(len(s)))

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(F.coalesce(F.col("text"), F.lit("")))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, folds: int = FOLDS, held_out: int = HELD_OUT_FOLD,
             **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Repeated rows get equal scores, a null doc_id is not held out, null and empty
    texts get the score of an empty text, an empty table gives no rows. Other columns are ignored."""
    model = train(docs, labels, folds=folds, held_out=held_out, **options)
    rows = internal(docs, doc_id="doc_id", text="text")
    out = rows.select("doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), scored(model).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
