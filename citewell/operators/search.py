"""Hybrid retrieval over tables of questions: sparse and dense top-k, rank fusion, rerank, diversity.

``queries`` below is a table (tenant_id, qid, subquery_no, ...), one row per sub-query. Every join and window
key starts with tenant_id."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewell import params as P
from citewell import session
from citewell.functions import text
from citewell.operators import index, tiles

LIST = ["tenant_id", "qid", "subquery_no"]


def top_k(scored: DataFrame, keys: list[str], k: int, score: str = "score", channel: str | None = None) -> DataFrame:
    """Best ``k`` rows per key with 0-based ``rank``. Spark limits each group before the shuffle
    (WindowGroupLimit), so a hot key sends at most k rows per task."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc("chunk_id"))
    ranked = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    ranked = ranked.withColumn("rank", F.col("rank") - 1)
    return ranked.withColumn("channel", F.lit(channel)) if channel else ranked


# ---- sparse ------------------------------------------------------------------------------------


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct terms of each sub-query; the query side of BM25 weighs each of them 1."""
    return queries.select(*LIST, F.explode(F.array_distinct("terms")).alias("term"))


def matching_postings(chunks: DataFrame, qterms: DataFrame) -> DataFrame:
    """Postings of the terms that some question of the tenant uses, written once because both the document
    frequencies and the scores read them."""
    wanted = qterms.select("tenant_id", "term").distinct()
    post = index.postings(chunks)
    kept = post.join(wanted, ["tenant_id", "term"], "left_semi")
    return session.written(kept, "postings")


def term_weights(qterms: DataFrame, frequency: DataFrame, sizes: DataFrame) -> DataFrame:
    """(sub-query, term) with its inverse document frequency."""
    return (
        qterms.join(frequency, ["tenant_id", "term"])
        .join(sizes, ["tenant_id"])
        .select(*LIST, "term", index.inverse_frequency(F.col("n"), F.col("df")).alias("idf"))
    )


_POSTINGS = 2 << 20  # of a block that a task holds


def best_sparse(rows: DataFrame, weights: DataFrame, k: int, block=tiles.Postings) -> DataFrame:
    """The best ``k`` chunks of each sub-query by the sum of weight * idf over its terms. rows: tenant_id, chunk_id, terms, weights (`index.packed`);
    weights: `term_weights`. Scores are summed where a block of chunks lies (`tiles`), so no row is made for a sub-query and a chunk. Both sides are
    shuffled in a short form (`tiles.shortened`)."""
    asked = weights.groupBy(*LIST).agg(F.collect_list(F.struct("term", "idf")).alias("t"))
    asked = asked.select(*LIST, F.col("t.term").alias("terms"), F.col("t.idf").alias("weights"))
    counts = rows.groupBy("tenant_id").agg(F.ceil(F.sum(F.size("terms")) / _POSTINGS).cast("int").alias("vblocks"), F.lit(1).alias("qblocks"))
    held = tiles.shortened(rows, "terms", "weights", "tenant_id", "chunk_id")
    asked = tiles.shortened(asked, "terms", "weights", *LIST)
    return top_k(tiles.best(held, asked, counts, ["terms", "weights", "places"], block, k, tiles.restored), LIST, k, channel="sparse")


def sparse_search(queries: DataFrame, post: DataFrame, frequency: DataFrame, sizes: DataFrame,
                  k: int = P.DEFAULTS.candidates) -> DataFrame:
    """post: `index.postings`, or `index.packed`, which takes less room."""
    weights = session.written(term_weights(query_terms(queries), frequency, sizes), "weights")
    if "terms" not in post.columns:
        post = post.select("tenant_id", "chunk_id", F.array("term").alias("terms"), F.array("weight").alias("weights"))
    return best_sparse(post, weights, k)


# ---- dense -------------------------------------------------------------------------------------

_DENSE_SCHEMA = "tenant_id string, qid string, subquery_no int, chunk_id string, score double"
_CELLS = 1 << 20  # scores held at once


def _best_of_block(ids: np.ndarray, matrix: np.ndarray, block: pd.DataFrame, qmatrix: np.ndarray, tenant: str,
                   k: int) -> pd.DataFrame:
    """Top-k chunk ids per query of one block of vectors; equal scores are cut by chunk id."""
    scores = np.round(matrix @ qmatrix.T, 9) + 0.0
    out = []
    for j in range(scores.shape[1]):
        column = scores[:, j]
        if len(column) > k:
            floor = np.partition(column, len(column) - k)[len(column) - k]
            rows = np.flatnonzero(column >= floor)
        else:
            rows = np.arange(len(column))
        rows = rows[np.lexsort((ids[rows], -column[rows]))][:k]
        out.append((j, rows, column[rows]))
    where = np.concatenate([np.full(len(r), j) for j, r, _ in out])
    return pd.DataFrame({
        "tenant_id": tenant,
        "qid": block["qid"].to_numpy()[where],
        "subquery_no": block["subquery_no"].to_numpy()[where].astype(np.int32),
        "chunk_id": ids[np.concatenate([r for _, r, _ in out])],
        "score": np.concatenate([s for _, _, s in out]),
    })


def _dense_by_closure(vectors: DataFrame, block: pd.DataFrame, k: int) -> DataFrame:
    """Few queries: their matrix goes to the tasks and the vectors stay where they are."""
    per_tenant = {
        tenant: (rows, np.stack(rows["embedding"].to_numpy()).astype(np.float64))
        for tenant, rows in block.groupby("tenant_id")
    }

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None  # running top-k of the partition, at most k rows per query
        for batch in batches:
            found = [] if best is None else [best]
            for tenant, part in batch.groupby("tenant_id"):
                if tenant in per_tenant:
                    rows, qmatrix = per_tenant[tenant]
                    matrix = np.stack(part["embedding"].to_numpy()).astype(np.float64)
                    step = max(1, _CELLS // len(matrix))
                    for start in range(0, len(rows), step):
                        found.append(_best_of_block(part["chunk_id"].to_numpy(), matrix,
                                                    rows.iloc[start:start + step],
                                                    qmatrix[start:start + step], tenant, k))
            if found:
                merged = pd.concat(found).sort_values(["score", "chunk_id"], ascending=[False, True])
                best = merged.groupby(LIST, sort=False).head(k)
        if best is not None:
            yield best

    return vectors.select("tenant_id", "chunk_id", "embedding").mapInPandas(search, _DENSE_SCHEMA)


_HELD = 20_000  # vectors that a task holds, queries that pass it
_SPREAD = 6  # groups of either side that a tenant is dealt into for more tasks


def _dense_by_shuffle(vectors: DataFrame, queries: DataFrame, k: int, vector_block: int) -> DataFrame:
    """Any number of queries: they pass blocks of vectors (`tiles`). A block is bounded, so neither a hot tenant nor many queries end up in one
    place, and of each query only the best ``k`` of a block are kept."""
    def groups(df: DataFrame, least: int, out: str) -> DataFrame:
        n = F.count(F.lit(1))
        return df.groupBy("tenant_id").agg(F.greatest(F.ceil(n / max(_HELD, least)), F.least(F.lit(_SPREAD), F.ceil(n / least))).cast("int").alias(out))

    qblocks = queries.groupBy("tenant_id").agg(F.least(F.lit(_SPREAD), F.ceil(F.count(F.lit(1)) / _HELD)).cast("int").alias("qblocks"))
    counts = groups(vectors, vector_block, "vblocks").join(qblocks, "tenant_id")
    held = vectors.select("tenant_id", "chunk_id", "embedding")
    return tiles.best(held, queries, counts, ["embedding"], tiles.Vectors, k).select(*LIST, "chunk_id", "score")


def dense_search(queries: DataFrame, vectors: DataFrame, k: int = P.DEFAULTS.candidates, max_closure: int = 4096,
                 vector_block: int = 20_000) -> DataFrame:
    """Exact inner-product top-k per sub-query among the tenant's vectors."""
    wanted = queries.select(F.col("tenant_id"), F.col("qid").cast("string").alias("qid"),
                            F.col("subquery_no").cast("int").alias("subquery_no"), "embedding")
    head = wanted.limit(max_closure + 1).toPandas()
    if len(head) <= max_closure:
        local = _dense_by_closure(vectors, head, k) if len(head) else wanted.sparkSession.createDataFrame([], _DENSE_SCHEMA)
    else:
        local = _dense_by_shuffle(vectors, wanted, k, vector_block)
    return top_k(local, LIST, k, channel="dense")


# ---- fusion, rerank, diversity -----------------------------------------------------------------


def fuse(ranked: DataFrame, k: int = P.DEFAULTS.rrf_k) -> DataFrame:
    """Reciprocal rank fusion over all ranked lists of a question."""
    return ranked.groupBy("tenant_id", "qid", "chunk_id").agg(
        F.round(F.sum(1.0 / (F.lit(k) + F.col("rank") + 1)), 12).alias("rrf")
    )


def coverage(term_sets: Column, chunk_terms: Column) -> Column:
    """Best overlap of the question or one of its sub-queries with the chunk."""
    return F.coalesce(F.array_max(F.transform(term_sets, lambda q: text.overlap_terms(q, chunk_terms))), F.lit(0.0))


def lexical_reranker(candidates: DataFrame) -> DataFrame:
    """candidates: tenant_id, qid, chunk_id, doc_id, rrf, term_sets, content -> ``score`` instead of the last two."""
    best = F.max("rrf").over(Window.partitionBy("tenant_id", "qid"))
    # the terms of a chunk stay where they met the question: only their share is shuffled to the question's other candidates
    covered = candidates.withColumn("_cover", coverage(F.col("term_sets"), F.col("content"))).drop("term_sets", "content")
    return covered.withColumn("score", F.round(0.6 * (F.col("rrf") / best) + 0.4 * F.col("_cover"), 4)).drop("_cover")


def diversify(scored: DataFrame, questions: DataFrame | None = None, s: P.Settings = P.DEFAULTS) -> DataFrame:
    """At most ``max_per_doc`` chunks per document, then the best ``top_k`` (or the question's own top_k).
    Ranking by score and cutting per document first equals a greedy scan in score order."""
    order = [F.desc("score"), F.desc("rrf"), F.asc("chunk_id")]
    per_doc = F.row_number().over(Window.partitionBy("tenant_id", "qid", "doc_id").orderBy(*order))
    kept = scored.withColumn("_d", per_doc).filter(F.col("_d") <= s.max_per_doc).drop("_d")
    position = F.row_number().over(Window.partitionBy("tenant_id", "qid").orderBy(*order))
    kept = kept.withColumn("position", position)
    if questions is not None:
        limits = questions.select("tenant_id", "qid", F.coalesce("top_k", F.lit(s.top_k)).alias("_k"))
        return kept.join(limits, ["tenant_id", "qid"]).filter("position <= _k").drop("_k")
    return kept.filter(F.col("position") <= s.top_k)


def retrieve(questions: DataFrame, queries: DataFrame, tables: dict[str, DataFrame],
             reranker: Callable[[DataFrame], DataFrame] = lexical_reranker, s: P.Settings = P.DEFAULTS) -> DataFrame:
    """questions: tenant_id, qid, top_k, term_sets; queries: LIST + terms + embedding;
    tables: chunks (with ``content``), sizes, vectors, and either postings and frequency or the block tables of `impact`."""
    if "blocks" in tables:
        from citewell.operators import impact

        sparse = impact.every_posting(queries, tables, tables["sizes"], s.candidates)
    else:
        sparse = sparse_search(queries, tables["packed"] if "packed" in tables else tables["postings"], tables["frequency"], tables["sizes"], s.candidates)
    dense = dense_search(queries, tables["vectors"], s.candidates)
    columns = [*LIST, "channel", "chunk_id", "rank"]
    ranked = sparse.withColumn("qid", F.col("qid").cast("string")).select(columns).unionByName(dense.select(columns))
    fused = fuse(ranked, s.rrf_k)
    chunks = tables["chunks"].select("tenant_id", "chunk_id", "doc_id", "content")
    picked = chunks.join(fused.select("tenant_id", "chunk_id").distinct(), ["tenant_id", "chunk_id"], "left_semi")
    asked = fused.join(questions.select("tenant_id", "qid", "term_sets"), ["tenant_id", "qid"])
    candidates = asked.join(picked, ["tenant_id", "chunk_id"])
    return diversify(reranker(candidates), questions, s).select(
        "tenant_id", "qid", "position", "chunk_id", "doc_id", "rrf", "score")
