"""The registered queries on the smallest tables, and the pipeline's stages one by one."""

import random

import corpus_pipeline
from citewell.llm import mixing, quality
from citewell.llm.common import table
from citewell.llm.queries import registry
from pyspark.sql import Row
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
NAMES = {f"op{n}" for n in range(1, 14)}


def test_registry_has_every_operator():
    assert {name.split("_")[0] for name in registry()} == NAMES


def test_stages(spark):
    docs = start = table(spark, DATA, "documents")
    counts, words = [start.count()], F.sum(mixing.word_count(F.col("text")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, DATA)
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        assert docs.columns == start.columns and docs.schema == start.schema
        counts.append(docs.count())
        if name == "quality classifier":
            model = quality.train(before, table(spark, DATA, "labels"))
            scored = before.withColumn("score", quality.scored(before, model))
            assert docs.count() == scored.filter("score >= 0.3").count()
            labels = table(spark, DATA, "labels")
            good = labels.filter("quality = 1").join(before, "doc_id").count()
            assert docs.join(labels.filter("quality = 1"), "doc_id").count() >= 0.97 * good
        if name == "near-dedup":
            assert docs.select("text").distinct().count() == docs.count() - docs.filter("text = ''").count() + (docs.filter("text = ''").count() > 0)
        if name == "mixing":
            goal = mixing.mix(before).groupBy("source").agg(F.sum("taken").alias("goal"))
            got = docs.groupBy("source").agg(words.alias("got"))
            assert goal.join(got, "source").filter("goal <> got").count() == 0
    pieces = corpus_pipeline.packed(spark, docs, DATA)
    per = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert all(r.n == 2048 or r.sequence_id == len(per) - 1 for r in per)
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0


def test_run(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_near_duplicates_go_by_row(spark):
    r = random.Random(31)
    one, two, three, four = (" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    rows = [(1, one), (2, one), (2, two), (3, three), (3, three), (None, four), (None, four), (None, one), (4, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.without_near_duplicates(spark, docs, DATA).collect()
    assert sorted(map(str, left)) == sorted(str(Row(doc_id=d, text=t)) for d, t in [(1, one), (2, two), (3, three), (None, four), (4, None), (4, "")])


def test_columns_named_like_the_operators_own(spark):
    """Columns that clash travel with their row, and change nothing."""
    names = ["__row", "__d", "__h", "__ranges", "__starts", "__c", "__removed", "__size", "__words", "__quality", "further"]
    docs = table(spark, DATA, "documents").filter("doc_id < 40")
    own = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names])
    for name, stage in corpus_pipeline.STAGES:
        if name == "quality classifier":
            continue  # fitting takes long; not tested here
        got, want = stage(spark, own, DATA), stage(spark, docs, DATA)
        if name == "packing":
            assert got.columns == want.columns and got.count() == want.count()
            continue
        rows = got.collect()
        assert got.columns == own.columns and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names)
        assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in want.collect())
        assert stage(spark, own.limit(0), DATA).count() == 0
