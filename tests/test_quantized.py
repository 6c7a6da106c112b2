import numpy as np
import pytest
from pyspark.sql import functions as F

from citewell.operators import quantized

VEC = "vec_id long, embedding array<double>"


def vectors(n, dim, seed, structure=0):
    r = np.random.RandomState(seed)
    x = r.randn(n, dim)
    if structure:
        x = r.randn(structure, dim)[np.arange(n) % structure] + 0.3 * x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def exact(x, q, k=10):
    scores = np.round(x @ x[q], 9)
    return np.lexsort((np.arange(len(x)), -scores))[:k]


@pytest.mark.parametrize("structure", [0, 25])
def test_recall_against_brute_force(spark, structure):
    x = vectors(1500, 32, 1, structure)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC).repartition(4)
    model = quantized.fit(df, cells=16)
    index = quantized.coded(df, model, "vec_id", block=200)
    assert index.count() == 1500 and index.groupBy("cell", "block").count().agg(F.max("count")).first()[0] < 300
    asked = df.filter("vec_id % 20 = 0")
    got = {}
    for row in quantized.search(asked, df, index, model, "vec_id", "vec_id", 10, 100, 16).collect():
        got.setdefault(row.qid, {})[row.id] = row.score
    hits = 0
    for q in range(0, 1500, 20):
        best = exact(x, q)
        hits += len(set(best.tolist()) & set(got[q]))
        assert all(abs(s - x[i] @ x[q]) < 1e-8 for i, s in got[q].items())  # scores are exact
    assert hits >= 0.9 * 750


def test_shortlist_of_everything_is_exact_search(spark):
    x = np.concatenate([vectors(150, 10, 2), vectors(1, 10, 3).repeat(60, axis=0)])  # a group of equal vectors: ties by id
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC).repartition(3)
    model = quantized.fit(df, cells=5, parts=4)
    index = quantized.coded(df, model, "vec_id", block=16)
    got = {}
    for row in quantized.search(df.filter("vec_id % 20 = 0"), df, index, model, "vec_id", "vec_id", 10, 1000, 5).collect():
        got.setdefault(row.qid, []).append((row.rank, row.id))
    for q in range(0, 210, 20):
        assert [i for _, i in sorted(got[q])] == exact(x, q).tolist()


def test_equal_codes_are_cut_by_id(spark):
    x = vectors(1, 8, 4).repeat(300, axis=0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VEC).repartition(6)
    model = quantized.fit(df, cells=3)
    rows = quantized.search(df.filter("vec_id = 7"), df, quantized.coded(df, model, "vec_id", block=50), model, "vec_id", "vec_id", 5, 8, 3)
    assert sorted(r.id for r in rows.collect()) == [0, 1, 2, 3, 4]


def test_unusable_vectors_and_empty_tables(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors(50, 6, 5))]
    odd = [(100, None), (101, []), (102, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (103, [float("nan")] * 6), (104, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame(rows + odd, VEC)
    model = quantized.fit(df, cells=4)
    index = quantized.coded(df, model, "vec_id")
    assert sorted(r.id for r in index.collect()) == list(range(50))
    assert {r.qid for r in quantized.search(df, df, index, model, "vec_id", "vec_id", 3, 20, 4).collect()} == set(range(50))
    none = df.limit(0)
    assert quantized.fit(none) is None and quantized.coded(none, model, "vec_id").count() == 0
    assert quantized.search(none, df, index, model, "vec_id", "vec_id").count() == 0
