"""Best chunks of many questions without a row per pair: held blocks that questions stream past.

A tenant's chunks are dealt into blocks by a hash of their id. A task gets a block, keeps it as arrays, and scores against it one question
after the other; only the best ``k`` of each question leave the task. A chunk crosses the shuffle once for each group of questions (one
group, unless a search asks for more), a question once for each block. Memory is a block's, whatever the number of questions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewell import session

PLACE = ["tenant_id", "vblock", "qblock", "asks"]
_FIRST = len(PLACE)  # then chunk_id, qid, subquery_no and what is scored
_CELLS = 1 << 21  # scores held at once
_QUERIES = 1024


def best(held: DataFrame, asked: DataFrame, counts: DataFrame, scored: list[str], block, k: int, read=None) -> DataFrame:
    """held: tenant_id, chunk_id and the columns ``scored``; asked: tenant_id, qid, subquery_no and the same columns; counts: tenant_id, vblocks,
    qblocks. ``block`` makes an empty block with ``add(ids, *scored)``, ``close()`` and ``search(k, *scored)``, which yields (questions, places of their
    chunks in ``ids``, scores); ``read``, if given, makes what it takes out of columns that were shuffled in a shorter form. Rows: tenant_id, qid,
    subquery_no, chunk_id, score. Null tenants meet nobody."""
    kind, qkind = dict(held.dtypes), dict(asked.dtypes)
    counts = session.written(counts, "tile-counts")  # a few rows, known to be few before the chunks are shuffled to meet them
    chunks = (
        held.join(counts, "tenant_id").withColumn("vblock", F.pmod(F.xxhash64("chunk_id"), F.col("vblocks")).cast("int"))
        .withColumn("qblock", F.explode(F.sequence(F.lit(0), F.col("qblocks") - 1)))
        .select(*PLACE[:3], F.lit(False).alias("asks"), "chunk_id", F.lit(None).cast(qkind["qid"]).alias("qid"),
                F.lit(None).cast(qkind["subquery_no"]).alias("subquery_no"), *scored))
    questions = (
        asked.join(counts, "tenant_id").withColumn("qblock", F.pmod(F.xxhash64("qid", "subquery_no"), F.col("qblocks")).cast("int"))
        .withColumn("vblock", F.explode(F.sequence(F.lit(0), F.col("vblocks") - 1)))
        .select(*PLACE[:3], F.lit(True).alias("asks"), F.lit(None).cast(kind["chunk_id"]).alias("chunk_id"), "qid", "subquery_no", *scored))
    rows = chunks.unionByName(questions).repartition(*PLACE[:3]).sortWithinPartitions(*PLACE)
    kinds = dict(rows.dtypes)
    names = ["tenant_id", "qid", "subquery_no", "chunk_id"]
    return rows.mapInArrow(_streamed(block, k, read), ", ".join(f"{c} {kinds[c]}" for c in names) + ", score double")


def _streamed(block, k: int, read=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, current = None, None
        for batch in batches:
            places = list(zip(*(batch.column(i).to_pylist() for i in range(_FIRST)), strict=True))
            start = 0
            for place, same in groupby(places):
                n = sum(1 for _ in same)
                rows, start = batch.slice(start, n), start + n
                if place[:3] != at:
                    at, current, ids, parts = place[:3], block(), None, []
                columns = rows.columns[_FIRST + 3:]
                if read:
                    columns = read(*columns)
                if not place[3]:
                    parts.append(rows.column(_FIRST).take(pa.array(np.arange(n))))  # a copy: a slice would keep the whole batch
                    current.add(*columns)
                    continue
                if parts and ids is None:
                    # smaller ids first: places break ties
                    names = pa.concat_arrays(parts)
                    order = pc.sort_indices(names, sort_keys=[("", "ascending")], null_placement="at_start") if len(names) else pa.array([], pa.uint64())
                    ids = current.close(names.take(order), order.to_numpy())
                if ids is None:
                    continue
                for who, where, scores in current.search(k, *columns):
                    if len(who):
                        asking = pa.array(who)
                        yield pa.RecordBatch.from_arrays([*(rows.column(i).take(asking) for i in (0, _FIRST + 1, _FIRST + 2)), ids.take(pa.array(where)),
                                                          pa.array(scores)], names=["tenant_id", "qid", "subquery_no", "chunk_id", "score"])

    return run


_SEPARATOR = "\n"  # no index term holds white space


def shortened(rows: DataFrame, terms: str, weights: str, *others: str) -> DataFrame:
    """Weighted terms in few bytes: the terms in one string, each different weight once, and for each term the place of its weight (from 1), since
    the weights of a chunk's terms come from small counts. Terms may be null, but hold no line breaks."""
    joined = F.when(F.size(terms) > 0, F.array_join(terms, _SEPARATOR, ""))
    places = F.transform(weights, lambda w: F.array_position(F.col("_different"), w).cast("int"))
    rows = rows.withColumn("_different", F.array_distinct(weights))
    return rows.select(*others, joined.alias("terms"), F.col("_different").alias("weights"), places.alias("places"))


def restored(terms: pa.Array, weights: pa.Array, places: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Terms and weights as lists again."""
    sizes, at = _items(places)
    different, values = _items(weights)
    begin = np.cumsum(different) - different
    values = values.take(pa.array(np.repeat(begin, sizes) + at.to_numpy(zero_copy_only=False) - 1))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return pc.split_pattern(terms, _SEPARATOR), pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), values)


def _items(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Lengths and items of lists; a null list is empty."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(column)


class Postings:
    """Weighted terms of chunks, by term. Rows with one chunk_id are one chunk; what they have of a term adds up."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.rows, self.parts = 0, []

    def add(self, terms: pa.Array, weights: pa.Array) -> None:
        sizes, words = _items(terms)
        coded = pc.dictionary_encode(words)
        own = np.fromiter((self.known.setdefault(t, len(self.known)) for t in coded.dictionary.to_pylist()), np.int32, len(coded.dictionary))
        doc = np.repeat(np.arange(self.rows, self.rows + len(sizes), dtype=np.int32), sizes)
        self.parts.append((own[coded.indices.to_numpy()], doc, np.array(_items(weights)[1].to_numpy(zero_copy_only=False))))
        self.rows += len(sizes)

    def close(self, ids: pa.Array, order: np.ndarray) -> pa.Array:
        coded = pc.dictionary_encode(ids, null_encoding="encode")  # sorted, so codes ascend
        place = np.empty(self.rows, np.int32)
        place[order] = coded.indices.to_numpy()
        self.n = len(coded.dictionary)
        term, doc, weight = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        doc, self.parts = place[doc], []
        by = np.lexsort((doc, term))
        term, doc, weight = term[by], doc[by], weight[by]
        fresh = np.ones(len(term), dtype=bool)
        fresh[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
        if not fresh.all():
            at = np.flatnonzero(fresh)
            term, doc, weight = term[at], doc[at], self.merged(weight, at)
        self.begin = np.searchsorted(term, np.arange(len(self.known) + 1)).tolist()
        self.doc, self.weight, self.total = doc, weight, np.zeros(self.n)
        return coded.dictionary

    def merged(self, weight: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Weights of rows with one chunk_id and term, which begin at ``at``."""
        return np.add.reduceat(weight, at)

    def asked(self, terms: pa.Array, idf: pa.Array) -> Iterator[list[tuple[int, float]]]:
        """Per question its terms that the block holds, with their weights."""
        sizes, words = _items(terms)
        coded = pc.dictionary_encode(words)
        own = np.array([self.known.get(t, -1) for t in coded.dictionary.to_pylist()], np.int32)
        codes, weights = own[coded.indices.to_numpy()].tolist() if len(own) else [], _items(idf)[1].to_pylist()
        end = 0
        for size in sizes.tolist():
            start, end = end, end + size
            yield [(c, w) for c, w in zip(codes[start:end], weights[start:end], strict=True) if c >= 0]

    def search(self, k: int, terms: pa.Array, idf: pa.Array) -> Iterator[tuple]:
        who, where, scores = [], [], []
        for i, words in enumerate(self.asked(terms, idf)):
            if words:
                rows, best = self.ranked(words, k)
                who.append(np.full(len(rows), i))
                where.append(rows)
                scores.append(best)
        if who:
            yield tuple(np.concatenate(x) for x in (who, where, scores))

    def ranked(self, words: list[tuple[int, float]], k: int) -> tuple[np.ndarray, np.ndarray]:
        total, begin = self.total, self.begin
        total.fill(0.0)
        for c, w in words:
            part = slice(begin[c], begin[c + 1])
            total[self.doc[part]] += self.weight[part] * w
        return top(total, k)


def top(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the ``k`` largest positive values, rounded to six digits; equal ones by place."""
    floor = 0.0
    if len(total) > k:
        floor = max(np.partition(total, len(total) - k)[len(total) - k] - 2e-6, 0.0)  # what rounds to the same is among them
    rows = np.flatnonzero(total > floor)
    scores = np.round(total[rows], 6)
    first = np.lexsort((rows, -scores))[:k]
    first = first[scores[first] > 0]
    return rows[first], scores[first]


class Vectors:
    """Vectors of chunks; rows with one chunk_id stay apart."""

    def __init__(self) -> None:
        self.parts: list[np.ndarray] = []

    @staticmethod
    def matrix(column: pa.Array) -> np.ndarray:
        return np.stack(column.to_numpy(zero_copy_only=False)).astype(np.float64)

    def add(self, vectors: pa.Array) -> None:
        self.parts.append(self.matrix(vectors))

    def close(self, ids: pa.Array, order: np.ndarray) -> pa.Array:
        self.vectors, self.parts = np.concatenate(self.parts)[order], []
        return ids

    def search(self, k: int, vectors: pa.Array) -> Iterator[tuple]:
        for start in range(0, len(vectors), _QUERIES):
            who, where, scores = self.nearest(self.matrix(vectors.slice(start, _QUERIES)), k)
            yield who + start, where, scores

    def nearest(self, asked: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, step = len(asked), max(k, _CELLS // len(asked))
        floor = np.full(n, -np.inf)
        who, where, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for start in range(0, len(self.vectors), step):
            tile = self.vectors[start:start + step] @ asked.T
            if not start and len(tile) > k:
                floor = np.partition(tile, len(tile) - k, axis=0)[len(tile) - k] - 2e-9
            row, column = np.nonzero(tile >= floor)
            who, where = np.concatenate([who, column]), np.concatenate([where, row + start])
            scores = np.concatenate([scores, np.round(tile[row, column], 9) + 0.0])
            by = np.lexsort((where, -scores, who))
            who, where, scores = who[by], where[by], scores[by]
            begin = np.searchsorted(who, np.arange(n))
            kept = np.arange(len(who)) - begin[who] < k
            who, where, scores = who[kept], where[kept], scores[kept]
            full = np.bincount(who, minlength=n) == k
            floor[full] = scores[np.searchsorted(who, np.flatnonzero(full), side="right") - 1] - 2e-9
        return who, where, scores
