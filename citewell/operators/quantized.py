"""Approximate inner-product search on product-quantised residuals, re-ranked exactly.

A vector lies in the cell of its nearest centre. What it differs from the centre by is cut into ``parts`` pieces, each replaced by the number of its
nearest codeword: a byte a piece. The inner product of a query with a coded vector is its product with the centre plus one look-up a piece in
a table that the query fills once. Each query keeps its ``shortlist`` best by code; only these full vectors are read, by an equi-join on
ids, and scored exactly. Centres and codewords are fitted on a bounded sample; every vector is coded.

Codes of a cell meet the queries that visit it block by block on both sides, so neither a hot cell nor a cell that all queries visit
lands in one task, and no task returns more than ``shortlist`` rows a query."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = 16_384
CODEWORDS = 256
CODE_BLOCK = 50_000
QUERY_BLOCK = 2_048
_AT_ONCE = 128


def lloyd(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    """``k`` centres (fewer for fewer rows) by squared distance; a centre without rows moves to the row farthest from its own."""
    r = np.random.RandomState(seed)
    centres = x[r.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        gap = (centres ** 2).sum(axis=1)[None, :] - 2 * x @ centres.T
        own = gap.argmin(axis=1)
        count = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        far = np.argsort(-gap[np.arange(len(x)), own] - (x ** 2).sum(axis=1), kind="stable")
        empty = np.flatnonzero(count == 0)
        sums[empty], count[empty] = x[far[:len(empty)]], 1
        centres = sums / count[:, None]
    return centres


@dataclass(frozen=True)
class Quantizer:
    """Cell centres, and per piece of a residual its codewords."""

    centres: np.ndarray
    words: tuple[np.ndarray, ...]
    cuts: tuple[int, ...]

    def pieces(self, x: np.ndarray) -> list[np.ndarray]:
        return np.split(x, self.cuts, axis=1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return ((self.centres ** 2).sum(axis=1)[None, :] - 2 * x @ self.centres.T).argmin(axis=1)

    def codes(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.words)), np.uint8)
        for i, (piece, words) in enumerate(zip(self.pieces(x - self.centres[cells]), self.words, strict=True)):
            out[:, i] = ((words ** 2).sum(axis=1)[None, :] - 2 * piece @ words.T).argmin(axis=1)
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Products of each query piece with each codeword: (queries, pieces, codewords)."""
        out = np.zeros((len(q), len(self.words), CODEWORDS), np.float32)
        for i, (piece, words) in enumerate(zip(self.pieces(q), self.words, strict=True)):
            out[:, i, :len(words)] = piece @ words.T
        return out


def usable(embedding: Column) -> Column:
    """Vectors that can be searched: neither null nor empty, all components finite numbers."""
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return F.coalesce(embedding.isNotNull() & (F.size(embedding) > 0) & ~bad, F.lit(False))


def fit(vectors: DataFrame, cells: int = 64, parts: int = 16, sample: int = SAMPLE, embedding: str = "embedding", seed: int = 1) -> Quantizer | None:
    """Centres and codewords from the ``sample`` vectors with the smallest hashes, the only rows that reach the driver; none without a vector."""
    chosen = vectors.filter(usable(F.col(embedding))).orderBy(F.xxhash64(embedding)).limit(sample).select(embedding).toPandas()
    if chosen.empty:
        return None
    x = np.array(chosen[embedding].tolist(), dtype=np.float64)
    centres = lloyd(x, cells, seed=seed)
    plain = Quantizer(centres, (), ())
    cuts = tuple(int(c) for c in np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1)[1:-1])
    rest = np.split(x - centres[plain.cells(x)], cuts, axis=1)
    return Quantizer(centres, tuple(lloyd(piece, CODEWORDS, seed=seed + i) for i, piece in enumerate(rest)), cuts)


def coded(vectors: DataFrame, model: Quantizer, row_id: str, embedding: str = "embedding", block: int = CODE_BLOCK) -> DataFrame:
    """id, cell, block, blocks, codes: every usable vector as its cell and one byte a piece."""
    kind = dict(vectors.dtypes)[row_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = np.array(part.column(1).to_pylist(), dtype=np.float64)
                cells = model.cells(x)
                codes = [c.tobytes() for c in model.codes(x, cells)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cells.astype(np.int32)), pa.array(codes, pa.binary())],
                                                 names=["id", "cell", "codes"])

    rows = vectors.filter(usable(F.col(embedding))).select(F.col(row_id).alias("id"), F.col(embedding).alias("embedding"))
    rows = rows.mapInArrow(run, f"id {kind}, cell int, codes binary")
    blocks = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    return rows.join(blocks, "cell").select("id", "cell", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "blocks", "codes")


def _visits(model: Quantizer, probes: int):
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            q = np.array(s.tolist(), dtype=np.float64).reshape(len(s), -1)
            best = np.argsort(-(q @ model.centres.T), axis=1, kind="stable")[:, :probes] if len(s) else []
            yield pd.Series([row.astype(np.int32) for row in best])

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<int>")


def shortlists(queries: DataFrame, index: DataFrame, model: Quantizer, query_id: str, shortlist: int, probes: int) -> DataFrame:
    """qid, id, near: the best ``shortlist`` ids of each query by code."""
    asked = queries.filter(usable(F.col("embedding"))).select(F.col(query_id).alias("qid"), "embedding")
    visits = asked.withColumn("cell", F.explode(_visits(model, probes)("embedding")))
    meets = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("qblocks"))
    spread = index.select("cell", "blocks").distinct().join(meets, "cell")
    left = index.join(spread.select("cell", "qblocks"), "cell").withColumn("qblock", F.explode(F.sequence(F.lit(0).cast("long"), F.col("qblocks") - 1)))
    right = visits.join(spread, "cell").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    right = right.withColumn("qblock", F.pmod(F.xxhash64("qid"), F.col("qblocks")))
    left = left.select("cell", "block", "qblock", "id", "codes")
    right = right.select("cell", "block", "qblock", "qid", "embedding").toDF("q_cell", "q_block", "q_qblock", "qid", "embedding")
    kinds = f"qid {dict(asked.dtypes)['qid']}, id {dict(index.dtypes)['id']}, near double"

    def meet(key, rows: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or wanted.empty:
            return pd.DataFrame({"qid": [], "id": [], "near": []})
        rows = rows.sort_values("id")  # equal codes are told apart by id
        place = np.arange(len(rows), dtype=np.int64)
        codes = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1)
        ids, qids, out = rows["id"].to_numpy(), wanted["qid"].to_numpy(), []
        q = np.array(wanted["embedding"].tolist(), dtype=np.float64)
        for at in range(0, len(q), _AT_ONCE):
            part = q[at:at + _AT_ONCE]
            tables = model.tables(part)
            near = np.repeat((part @ model.centres[key[0]]).astype(np.float32)[:, None], len(codes), axis=1)
            for i in range(codes.shape[1]):
                near += tables[:, i, :][:, codes[:, i]]
            keep = min(shortlist, len(codes))
            bits = near.view(np.int32)
            falling = ~(bits ^ ((bits >> 31) & 0x7FFFFFFF))  # integers that ascend as the products fall
            best = np.argpartition((falling.astype(np.int64) << 32) | place, keep - 1, axis=1)[:, :keep]
            out.append(pd.DataFrame({"qid": np.repeat(qids[at:at + _AT_ONCE], keep), "id": ids[best.ravel()],
                                     "near": np.take_along_axis(near, best, axis=1).ravel().astype(np.float64)}))
        return pd.concat(out)

    found = left.groupBy("cell", "block", "qblock").cogroup(right.groupBy("q_cell", "q_block", "q_qblock")).applyInPandas(meet, kinds)
    order = Window.partitionBy("qid").orderBy(F.desc("near"), "id")
    return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= shortlist).drop("r")


def _product(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    return pd.Series(np.round(np.einsum("ij,ij->i", np.array(a.tolist(), np.float64), np.array(b.tolist(), np.float64)), 9) + 0.0)


def search(queries: DataFrame, vectors: DataFrame, index: DataFrame, model: Quantizer, query_id: str, row_id: str, k: int = 10,
           shortlist: int = 64, probes: int = 64) -> DataFrame:
    """qid, id, score, rank: the best ``k`` of each query's shortlist by exact inner product, ties to the smaller id. Queries whose vector
    is null, empty or not finite find nothing, and such vectors are not found; an empty table gives no rows."""
    short = shortlists(queries, index, model, query_id, shortlist, probes)
    full = vectors.select(F.col(row_id).alias("id"), F.col("embedding").alias("v"))
    asked = queries.select(F.col(query_id).alias("qid"), F.col("embedding").alias("q"))
    scored = short.join(full, "id").join(asked, "qid").select("qid", "id", F.pandas_udf(_product, "double")("q", "v").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
