"""Importance resampling against a plain version and its SQL."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import pytest
from citewell.llm import q_resampling, resampling
from pyspark.sql import functions as F

DOC = "doc_id long, text string"


def plain_features(text, longest):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)
    return words, [" ".join(words[i:i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, percent=10, least=20, buckets=10_000, longest=1, seed=2024):
    def totals(texts):
        out = [0] * buckets
        for t in texts:
            for f in plain_features(t, longest)[1]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = totals(x for _, x in docs), totals(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for d, text in docs:
        words, found = plain_features(text, longest)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[:len(able) * percent // 100]):
        r[5] = i + 1
    return sorted(map(str, map(tuple, rows)))


def corpus(seed, n):
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("ha", "Ke", "É", "漢", "9") for b in ("", "lo", "_x", "-y", "!")]
    return [(i, " ".join(r.choice(words) for _ in range(r.choice([3, 19, 20, 25, 60])))) for i in r.sample(range(-50, 5000), n)]


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (3, 35)])
def test_against_the_plain_version(spark, longest, percent):
    docs = [*corpus(longest, 400), (9000, None), (9001, ""), (9002, " . \n"), (None, "word " * 30), (9003, "long " * 60_000)]
    target = ["ha lo ha", None, "", "É 漢lo 9 9 9"]
    df = spark.createDataFrame(docs, DOC).repartition(7)
    for c in ("score", "weight", "row", "later", "rank", "n", "at", "n_words", "all", "part"):
        df = df.withColumn(c, F.lit("clash"))
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, longest=longest)
    assert sorted(str(tuple(x)) for x in got.collect()) == plain(docs, target, percent, longest=longest)


def test_slices_and_memory_change_nothing(monkeypatch):
    text = " ".join(random.Random(2).choice(["ab", "Cd", "é", "x9"]) for _ in range(3000))
    whole = [x.tolist() if hasattr(x, "tolist") else x for x in resampling.Features(97, 3)(text)]
    monkeypatch.setattr(resampling, "SLICE", 11)
    monkeypatch.setattr(resampling, "MEMORY", 2)
    assert [x.tolist() if hasattr(x, "tolist") else x for x in resampling.Features(97, 3)(text)] == whole


def test_cutoff_is_exact_with_ties(spark):
    r = random.Random(7)
    rows = [(r.choice([5, 5, 5, 7, 1, -3, r.randint(-99, 99)]), int(r.random() < 0.1), r.randint(0, 9), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "score long, later long, doc_id long, row long").repartition(6)
    order = sorted((-s, *x) for s, *x in rows)
    for k in (1, 2, 700, 1000, 1999, 2000):
        assert resampling.cutoff(df, k) == order[k - 1]
    assert resampling.cutoff(df, 0) is None and resampling.cutoff(df, 2001) is None


def test_passes_discard_a_quarter(spark, monkeypatch):
    passes = []
    one = resampling._medians
    monkeypatch.setattr(resampling, "_medians", lambda *a: passes.append(a) or one(*a))
    rows = spark.range(0, 20_000, 1, 9).select((F.xxhash64("id") % 1_000_000).alias("score"), F.lit(0).cast("long").alias("later"), F.col("id").alias("doc_id"),
                                               F.col("id").alias("row"))
    assert resampling.cutoff(rows, 2000) is not None
    assert len(passes) <= 2 + math.log(20_000) / math.log(4 / 3)


def test_empty_tables_and_nothing_drawn(spark):
    none, one = spark.createDataFrame([], DOC), spark.createDataFrame([(1, "a b")], DOC)
    assert resampling.resample(none, none).collect() == []
    assert [tuple(x)[3:] for x in resampling.resample(one, none).select("doc_id", "n_words", "n_features", "rank").collect()] == [(None,)]


def test_repeated_rows_are_told_apart(spark):
    docs = [(1, "word " * 25)] * 40
    got = resampling.resample(spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame([("word",)], "text string"))
    assert sorted(x.rank for x in got.collect() if x.rank) == [1, 2, 3, 4]


def test_oracle_agrees_with_the_plain_version():
    docs, target = [*corpus(5, 200), (9000, None), (9001, "")], ["ha lo ha", None, "É 漢lo 9"]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?)", [(t,) for t in target])
    got = con.execute(q_resampling.SQL).fetchall()
    want = plain(docs, target)
    strip = lambda x: str(tuple(v for i, v in enumerate(eval(x)) if i != 1))  # noqa: E731  no n_words in the query
    assert sorted(str(tuple(x)) for x in got) == sorted(map(strip, want))
