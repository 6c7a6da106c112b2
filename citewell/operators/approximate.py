"""Approximate inner-product search over an inverted file of centroid cells.

Centroids are fitted on a bounded sample; every row is put into the cell of its nearest centroid. A query visits its ``probes`` nearest cells. Cells meet
queries by an equi-join on (cell, block): a cell above ``block`` rows is split, so a hot cell is many tasks, and each task returns at most k rows per query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 8192
BLOCK = 20_000


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 1) -> np.ndarray:
    """Lloyd's rounds on unit vectors; an empty cell takes a random row."""
    r = np.random.RandomState(seed)
    centres = sample[r.choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = ~np.isin(np.arange(len(centres)), own)
        sums[empty] = sample[r.choice(len(sample), int(empty.sum()))]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def centroids(vectors: DataFrame, cells: int = 64, sample: int = SAMPLE, embedding: str = "embedding") -> np.ndarray:
    """From about ``sample`` vectors chosen by a hash; the only rows that reach the driver."""
    share = min(1.0, sample / max(vectors.count(), 1))
    chosen = vectors.filter(F.pmod(F.xxhash64(embedding), F.lit(1 << 30)) <= int(share * (1 << 30))).select(embedding).toPandas()
    x = np.array(chosen[embedding].tolist(), dtype=np.float64)
    return fit_centroids(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), cells)


def _nearest(centres: np.ndarray, n: int):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            x = np.array(s.tolist(), dtype=np.float64).reshape(len(s), -1)
            yield pd.Series(list(np.argsort(-(x @ centres.T), axis=1, kind="stable")[:, :n].astype(np.int32)) if len(s) else [])

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<int>")


def inverted_file(vectors: DataFrame, centres: np.ndarray, row_id: str, block: int = BLOCK) -> DataFrame:
    """id, embedding, cell, block: every row in its cell. Null vectors are left out."""
    rows = vectors.filter(F.col("embedding").isNotNull()).select(F.col(row_id).alias("id"), "embedding", F.get(_nearest(centres, 1)("embedding"), 0).alias("cell"))
    blocks = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    return rows.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).select("id", "embedding", "cell", "block", "blocks")


def search(queries: DataFrame, index: DataFrame, centres: np.ndarray, query_id: str, k: int = 10, probes: int = 16) -> DataFrame:
    """qid, id, score, rank: the best k rows among the cells that a query visits."""
    asked = queries.select(F.col(query_id).alias("qid"), "embedding", F.explode(_nearest(centres, probes)("embedding")).alias("cell"))
    spread = index.select("cell", "blocks").distinct()
    asked = asked.join(spread, "cell").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    asked = asked.select("qid", "embedding", "cell", "block").toDF("qid", "q_embedding", "q_cell", "q_block")

    def meet(rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or wanted.empty:
            return pd.DataFrame({"qid": [], "id": [], "score": []})
        x, ids, out = np.stack(rows["embedding"]).astype(np.float64), rows["id"].to_numpy(), []
        for at in range(0, len(wanted), 256):
            part = wanted.iloc[at:at + 256]
            scores = np.stack(part["q_embedding"]).astype(np.float64) @ x.T
            for q, s in zip(part["qid"], scores, strict=True):
                best = np.lexsort((ids, -s))[:k]
                out.append(pd.DataFrame({"qid": q, "id": ids[best], "score": s[best]}))
        return pd.concat(out)

    kind = dict(index.dtypes)["id"]
    found = index.groupBy("cell", "block").cogroup(asked.groupBy("q_cell", "q_block")).applyInPandas(meet, f"qid {dict(asked.dtypes)['qid']}, id {kind}, score double")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
