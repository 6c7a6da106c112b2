import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

from citewell.operators import index, search, tiles

QUERY = "tenant_id string, qid string, subquery_no int, terms array<string>"


def test_blocks_give_the_scores_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(search, "_POSTINGS", 40)  # many blocks
    r = random.Random(5)
    words = [f"w{i}" for i in range(12)]
    docs = [("a" if r.random() < 0.8 else "b", f"c{i % 70}" if i else None, r.choices(words, k=r.randint(1, 9)), 9) for i in range(90)]  # ids repeat or are null
    asked = [(t, f"q{i}", 0, r.choices(words, k=3)) for i in range(8) for t in ("a", "b", "z")] + [("a", "q0", 0, ["w1", "w2"])]  # a repeated question
    chunks = spark.createDataFrame(docs, "tenant_id string, chunk_id string, terms array<string>, dl int")
    queries = spark.createDataFrame(asked, QUERY)
    post = index.postings(chunks)
    sizes, frequency = index.corpus_size(chunks), index.document_frequency(post)
    found = search.sparse_search(queries, index.packed(chunks), frequency, sizes, 4)
    rows = [tuple(x) for x in found.select("tenant_id", "qid", "chunk_id", "rank", "score").collect()]
    again = search.sparse_search(queries, post, frequency, sizes, 4).select("tenant_id", "qid", "chunk_id", "rank", "score")
    assert sorted(map(str, rows)) == sorted(str(tuple(x)) for x in again.collect())
    scores, df, n = defaultdict(float), defaultdict(int), defaultdict(int)
    held = [tuple(x) for x in post.select("tenant_id", "chunk_id", "term", "weight").collect()]
    for t, _, w, _ in held:
        df[t, w] += 1
    for t, *_ in docs:
        n[t] += 1
    for t, q, _, terms in asked:
        for o, c, w, x in held:
            if o == t and w in terms:
                scores[t, q, c] += x * math.log(1 + (n[t] - df[t, w] + 0.5) / (df[t, w] + 0.5))
    want = defaultdict(list)
    for (t, q, c), s in scores.items():
        want[t, q].append((-round(s, 6), c is not None, c or ""))
    assert len(rows) == sum(min(4, len(x)) for x in want.values()) > 60
    for t, q, c, rank, score in rows:
        least, _, name = sorted(want[t, q])[rank]
        assert (name or None) == c and math.isclose(score, -least, abs_tol=2e-6)
    # no row is made for a question and a chunk before its best are known
    assert not any("chunk_id" in line.split("functions=")[0] for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Aggregate(keys" in line)


def test_vectors_in_tiles_keep_ties_in_order(monkeypatch):
    monkeypatch.setattr(tiles, "_CELLS", 64)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(9, 4))
    block = tiles.Vectors()
    block.vectors = np.concatenate([base] * 12)  # copies: equal scores in every tile
    who, where, scores = block.nearest(base[:5], 7)
    exact = np.round(block.vectors @ base[:5].T, 9)
    for q in range(5):
        assert where[who == q].tolist() == np.lexsort((np.arange(108), -exact[:, q]))[:7].tolist()
        assert np.allclose(scores[who == q], np.sort(exact[:, q])[::-1][:7])


def test_weighted_terms_are_shuffled_in_a_short_form(spark):
    r = random.Random(8)
    rows = [("a", f"c{i}", [f"term{j}" for j in range(300)], [round(0.5 + r.randrange(3) / 7, 6) for _ in range(300)]) for i in range(20)]
    rows += [("a", "none", [], []), ("a", "null", None, None), (None, None, ["x", None, "y"], [2.0, 0.25, 2.0])]
    wide = spark.createDataFrame(rows, "tenant_id string, chunk_id string, terms array<string>, weights array<double>")
    short = tiles.shortened(wide, "terms", "weights", "tenant_id", "chunk_id")
    table = short.select("terms", "weights", "places").toArrow().combine_chunks().to_batches()[0]
    assert pa.compute.list_value_length(table.column(1)).to_pylist()[:20] == [3] * 20  # not one weight a term
    # the same from rows that begin inside a batch
    for at in (0, 7, 19):
        terms, weights = tiles.restored(*table.slice(at).columns)
        assert [x or [] for x in terms.to_pylist()] == [[t or "" for t in x[2] or []] for x in rows[at:]]
        assert weights.to_pylist() == [x[3] or [] for x in rows[at:]]
    found = search.best_sparse(wide, spark.createDataFrame([("a", "q", 0, "term3", 1.5), ("a", "q", 0, "term5", 0.1)], "tenant_id string, qid string, subquery_no int, term string, idf double"), 30)
    want = {x[1]: 1.5 * x[3][3] + 0.1 * x[3][5] for x in rows[:20]}
    got = {x.chunk_id: x.score for x in found.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[c], want[c], abs_tol=1e-6) for c in want)
    exchanged = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "MapInArrow" in line]
    assert exchanged and "places" in exchanged[0]
