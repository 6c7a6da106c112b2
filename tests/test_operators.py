import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citewell import params as P
from citewell import session
from citewell.operators import graph, index, search, traffic
from citewell.sources import tables

S = P.DEFAULTS
WORDS = [f"w{c}{i}" for c in "abcdef" for i in range(6)]


def test_bm25_equals_brute_force_and_respects_tenants(spark):
    rng = random.Random(2)
    docs = [("t1" if rng.random() < 0.7 else "t2", f"d{i:03}", " ".join(rng.choices(WORDS, k=rng.randint(1, 40)))) for i in range(120)]
    asked = [(t, f"q{i}", 0, rng.choices(WORDS, k=4)) for i, t in enumerate(["t1", "t2"] * 4)]
    terms = index.with_terms(spark.createDataFrame(docs, "tenant_id string, chunk_id string, text string"))
    queries = spark.createDataFrame(asked, "tenant_id string, qid string, subquery_no int, terms array<string>")
    post = index.postings(terms)
    got = {}
    for r in search.sparse_search(queries, post, index.document_frequency(post), index.corpus_size(terms), 5).collect():
        got.setdefault(r.qid, []).append((r["rank"], r.chunk_id))
    for tenant, qid, _, words in asked:
        own = [(c, t.split()) for o, c, t in docs if o == tenant]
        df = Counter(w for _, t in own for w in set(t))
        scores = []
        for c, t in own:
            dl, tf = len(t), Counter(t)
            s = sum(round(tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * dl / 120)), 6) * math.log(1 + (len(own) - df[w] + 0.5) / (df[w] + 0.5)) for w in set(words) if tf[w])
            if s > 0:
                scores.append((-round(s, 6), c))
        assert sorted(got[qid]) == [(i, c) for i, (_, c) in enumerate(sorted(scores)[:5])]


def test_dense_paths_agree_with_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(20, 8))
    vec = [("t1" if i % 3 else "t2", f"c{i:03}", (base[i % 20] / np.linalg.norm(base[i % 20])).tolist()) for i in range(150)]  # many exact copies
    vectors = spark.createDataFrame(vec, "tenant_id string, chunk_id string, embedding array<double>")
    queries = vectors.filter("chunk_id < 'c015'").select("tenant_id", F.col("chunk_id").alias("qid"), F.lit(0).alias("subquery_no"), "embedding")
    near = {tuple(r) for r in search.dense_search(queries, vectors, 4).select("qid", "chunk_id", "rank").collect()}
    far = {tuple(r) for r in search.dense_search(queries, vectors, 4, max_closure=2, vector_block=16).select("qid", "chunk_id", "rank").collect()}
    want = set()
    for t, q, e in vec[:15]:
        scored = sorted((-round(float(np.dot(e, v)), 9), c) for o, c, v in vec if o == t)
        want |= {(q, c, i) for i, (_, c) in enumerate(scored[:4])}
    assert near == far == want


def test_fusion_and_diversity(spark):
    ranked = spark.createDataFrame([("t", "q", c, r) for lst in (["a", "b"], ["b", "c"]) for r, c in enumerate(lst)], "tenant_id string, qid string, chunk_id string, rank int")
    assert search.fuse(ranked).orderBy(F.desc("rrf")).first().chunk_id == "b"
    scored = spark.createDataFrame([("t", "q", f"c{i}", "d1" if i < 4 else f"d{i}", 1.0 - i / 10, 0.0) for i in range(8)], "tenant_id string, qid string, chunk_id string, doc_id string, score double, rrf double")
    assert [r.chunk_id for r in search.diversify(scored).orderBy("position").collect()] == ["c0", "c1", "c4", "c5", "c6"]


def _triples(spark, edges):
    rows = [(t, s, s.lower(), p, o, o.lower(), f"d{i % 3}", f"d{i % 3}#{i}") for i, (t, s, p, o) in enumerate(edges)]
    return spark.createDataFrame(rows, "tenant_id string, subject string, subject_norm string, predicate string, object string, object_norm string, doc_id string, chunk_id string")


@pytest.mark.parametrize("hops, limit", [(1, 100), (2, 6), (3, 8), (3, 1000)])
def test_neighborhood_equals_breadth_first_search(spark, hops, limit):
    rng = random.Random(hops * 31 + limit)
    nodes = [f"N{i}" for i in range(30)]
    edges = [("t1", "N0" if rng.random() < 0.3 else rng.choice(nodes), rng.choice(["uses", "calls"]), rng.choice(nodes)) for _ in range(60)] + [("t2", "N1", "uses", "N2")]
    seeds = [("t1", f"q{i}", f"n{i}") for i in range(8)]
    got = {}
    for r in graph.neighborhood(spark.createDataFrame(seeds, "tenant_id string, qid string, node string"), _triples(spark, edges), hops, limit).collect():
        got.setdefault(r.qid, []).append((r.position, r.depth, r.subject, r.predicate, r.object))
    own = {e[1:] for e in edges if e[0] == "t1"}
    for _, qid, seed in seeds:
        depth, frontier = {seed: 0}, {seed}
        for level in range(1, hops):
            frontier = {b for s, _, o in own for a, b in ((s.lower(), o.lower()), (o.lower(), s.lower())) if a in frontier} - set(depth)
            depth.update(dict.fromkeys(frontier, level))
        facts = sorted((min(depth[n.lower()] for n in (s, o) if n.lower() in depth), s, p, o) for s, p, o in own if s.lower() in depth or o.lower() in depth)
        assert sorted(got.get(qid, [])) == [(i + 1, *f) for i, f in enumerate(facts[:limit])]


def test_mentions_equal_the_regex(spark):
    names = ["payments api", "api", "c++", ".net core", "at&t", "日本語", "x-1", "team o'neil", "a\\eb", "sev-1", "api gateway", "...", "q", "café team"]
    texts = ["the Payments API  calls", "payments apis", "we use C++ and asp.net core", "plain .net core!", "AT&T's sev-1 x-12", "x-1.", "日本語だ", "a日本語", "api-gateway", "api gateway", "a\\eb", "wait...", "see...x", "the café team"]
    q = spark.createDataFrame([("t", str(i), t) for i, t in enumerate(texts)], "tenant_id string, qid string, text string")
    n = spark.createDataFrame([("t", x) for x in names] + [("u", "plain")], "tenant_id string, name string")
    got = {(r.qid, r.name) for r in graph.mentions(q, n).collect()}
    norm = lambda t: re.sub(r"\s+", " ", t.strip().lower())
    want = {(str(i), x) for i, t in enumerate(texts) for x in names if len(x) >= 3 and re.search(rf"(?<![a-z0-9]){re.escape(x)}(?![a-z0-9])", norm(t))}
    assert got == want


def test_linking_drops_contained_names(spark):
    t = _triples(spark, [("t1", "Payments API", "uses", "API"), ("t2", "Other API", "uses", "X1Y")])
    q = spark.createDataFrame([("t1", "1", "who runs the payments api?"), ("t2", "2", "who runs the payments api?")], "tenant_id string, qid string, text string")
    assert [(r.qid, r.linked) for r in graph.link_entities(q, graph.entity_names(t)).collect()] == [("1", ["payments api"])]


def test_explorer_clamps_hops_and_misses(spark):
    t = _triples(spark, [("t", f"N{i}", "uses", f"N{i + 1}") for i in range(6)])
    rows = graph.explore(spark.createDataFrame([("t", " n0 "), ("t", "zzz"), ("u", "N0")], "tenant_id string, entity string"), t, 9).collect()
    assert [(r.entity, r.subject) for r in rows] == [("n0", "N0"), ("n0", "N1"), ("n0", "N2")]


@pytest.mark.parametrize("max_fold", [1000, 2])
def test_cache_outcomes_equal_a_loop(spark, max_fold):
    rng = random.Random(max_fold)
    rows = sorted((rng.choice("ab"), rng.randrange(0, 4000), i, rng.random() < 0.7) for i in range(300))
    rows += [("z", 0, 900, True), ("z", 300, 901, True), ("z", 301, 902, True), ("z", 301, 903, True)]
    df = spark.createDataFrame([(k, t, i, c) for k, t, i, c in rows], "cache_key string, s long, id long, cacheable boolean").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.id: r.hit for r in traffic.cache_outcomes(df, "id", 300, max_fold).collect()}
    stored, want = {}, {}
    for k, t, i, c in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        want[i] = k in stored and t - stored[k] <= 300
        if not want[i] and c:
            stored[k] = t
    assert got == want


def test_rate_limit_passes_the_first_requests_of_a_minute(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([0, 1, 2, 59, 60, 61, 125])], "id long, s long").select("id", F.timestamp_seconds("s").alias("ts"), F.lit("t").alias("tenant_id"), F.lit("k").alias("key_id"))
    assert {r.id: r.allowed for r in traffic.rate_limit(df, "id", 2).collect()} == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 6: True}


def test_order_statistics_with_ties_and_one_value(spark):
    rng = random.Random(5)
    rows = [("a", float(rng.randrange(40))) for _ in range(501)] + [("b", 7.0)] * 9 + [("c", 1.0), ("c", 2.0)]
    got = {r.k: (r.p50, r.p95) for r in traffic.latency_quantiles(spark.createDataFrame(rows, "k string, latency_ms double"), ["k"]).collect()}
    for key in "abc":
        v = sorted(x for k, x in rows if k == key)
        assert got[key] == (float(np.median(v)), v[int(0.95 * (len(v) - 1))])


def test_triple_insert_ignores_known_keys(spark):
    t = _triples(spark, [("t", "A", "uses", "B"), ("t", "C", "uses", "D")])
    assert tables.new_triples(t.filter("subject = 'A'"), t.unionByName(t)).select("subject").collect() == [("C",)]
