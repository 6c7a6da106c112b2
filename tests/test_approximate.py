import numpy as np
from pyspark.sql import functions as F

from citewell.operators import approximate
from queries import retrieval


def test_cells_find_the_neighbours_of_structured_vectors(spark):
    r = np.random.RandomState(1)
    base = r.randn(20, 16)
    x = [base[i % 20] + r.randn(16) * 0.2 for i in range(600)]
    rows = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)] + [(1000, None)]
    vec = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    centres = approximate.centroids(vec.filter("embedding is not null"), 20)
    index = approximate.inverted_file(vec, centres, "vec_id", block=16)
    assert index.count() == 600 and index.groupBy("cell", "block").count().agg(F.max("count")).first()[0] < 60
    asked = vec.filter("vec_id % 20 = 0 and embedding is not null")
    got = {}
    for x in approximate.search(asked, index, centres, "vec_id", 10, 4).collect():
        got.setdefault(x.qid, set()).add(x.id)
    m = np.array([v for _, v in rows[:600]])
    hits = sum(len(got[q] & set(np.argsort(-(m @ m[q]), kind="stable")[:10].tolist())) for q in range(0, 600, 20))
    assert hits >= 0.95 * 300


def test_recall_on_the_supplied_vectors(spark):
    found = retrieval.approximate_recall(spark, "/root/testdata/sf0.001").agg(F.sum("exact").alias("exact"), F.sum("found").alias("found")).first()
    assert found.found >= 0.9 * found.exact > 0
