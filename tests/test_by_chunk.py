import random
import re

from pyspark.sql import functions as F

from citewell import params as P
from citewell import session
from citewell.functions import identity, text, triples
from citewell.operators import index
from citewell.sources import tables
from citewell.streaming import ingest as continuous

DOCUMENT = "tenant_id string, doc_id string, title string, text string, source string, metadata map<string,string>"


def test_rows_by_chunk_are_the_postings(spark):
    r = random.Random(2)
    rows = [("a" if i % 3 else None, f"c{i}", r.choices([f"w{j}" for j in range(12)], k=i), max(i, 1)) for i in range(40)] + [("a", "none", None, 1)]
    chunks = spark.createDataFrame(rows, "tenant_id string, chunk_id string, terms array<string>, dl int")
    plain, held = index.postings(chunks), index.by_chunk(chunks)
    again = index.unpacked(held)
    assert again.columns == plain.columns and held.count() == 39
    assert sorted(map(str, again.collect())) == sorted(map(str, plain.collect()))


def test_a_text_and_its_head_are_cut_into_tokens_apart(spark):
    texts = ["The Gateway-2 runs x_y.", "e​́tude café Ortes", "", "the of and", "ﬁne Ⅰ prints", "-a b-", "tail"]
    rows = [("t", f"c{i}", title, section, x) for i, (title, section, x) in enumerate(
        (t, s, x) for x in texts for t in ("Doc ﬁve", "the", "", "end-", None) for s in ("Se​ction", None))]
    chunks = spark.createDataFrame(rows, "tenant_id string, chunk_id string, title string, section string, text string")
    whole = identity.embedding_text(F.col("title"), F.col("section"), F.col("text"))
    want = index.with_terms(text.with_normalized(chunks.withColumn("_embed", whole), "_embed"), "_embed").withColumn("body_terms", text.content_terms(F.col("text")))
    got = index.with_headed_terms(chunks, identity.embedding_head(F.col("title"), F.col("section")))
    names = ["chunk_id", "content", "terms", "dl", "body_terms"]
    assert sorted(map(str, got.select(names).collect())) == sorted(map(str, want.select(names).collect()))


def test_live_postings_are_one_row_a_chunk(spark, tmp_path):
    docs = spark.createDataFrame([("t", f"d{i}", "T", f"Gateway {i} forwards many requests of gateway {i} to the archive.", "d", {}) for i in range(5)], DOCUMENT)
    root = str(tmp_path / "live")
    continuous.ingest_batch(docs, root, buckets=2)
    continuous.ingest_batch(docs.filter("doc_id = 'd1'"), root, buckets=2)
    live = continuous.live_tables(spark, root)
    assert spark.read.parquet(f"{root}/postings").count() == live["packed"].count() == 5
    terms = live["postings"].groupBy("term").agg(F.count("*").alias("df"), F.max("tf").alias("tf"))
    assert {(x.term, x.df) for x in terms.collect()} == {(x.term, x.df) for x in live["frequency"].collect()}
    assert terms.filter("term = 'gateway'").first().tf == 2


def test_texts_are_read_once_for_the_documents_that_they_replace(spark, tmp_path, monkeypatch):
    names, written = [], session.written
    monkeypatch.setattr(session, "written", lambda df, name, *a: names.append(name) or written(df, name, *a))
    docs = spark.createDataFrame([("t", f"d{i}", "T", f"Gateway {i} is owned by Team Blue.", "d", {}) for i in range(4)], DOCUMENT)
    asked, upsert = [], tables.upsert_table
    monkeypatch.setattr(tables, "upsert_table", lambda path, batch, documents, *a: asked.append(documents) or upsert(path, batch, documents, *a))
    continuous.ingest_batch(docs, str(tmp_path / "live"), buckets=2)
    assert "keys" not in names  # nothing to replace
    asked.clear()
    continuous.ingest_batch(docs.filter("doc_id > 'd1'"), str(tmp_path / "live"), buckets=2)
    assert len(asked) == len(continuous.STORED) and names.count("keys") == 1
    for df in asked:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "keys-" in str(df.inputFiles()) and "text" not in plan
    assert spark.read.parquet(str(tmp_path / "live" / "chunks")).count() == 4


def test_only_texts_with_a_word_of_a_relation_are_cut(spark):
    r = random.Random(9)
    words = ["Gateway", "Cold Vault", "Team Blue", "is  owned\nby", "depends on", "uses", "calls", "parts of", "runs", "the", "Mail Relay."]
    texts = [" ".join(r.choices(words, k=9)) for _ in range(60)] + ["Nothing here. Only prose.", None, "# Gateway uses Redis\n"]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", triples.extracted(F.col("t")).alias("e"))
    got = {x.i: [tuple(e) for e in x.e] for x in found.collect()}
    heading, space, boundary = re.compile(r"^\s*#{1,6}\s.*$", re.M), re.compile(r"\s+"), re.compile(P.SENTENCE_BOUNDARY)
    for i, t in enumerate(texts):
        sentences = boundary.split(space.sub(" ", heading.sub("\n", t or "")).strip())
        assert got[i] == list(dict.fromkeys(x for s in sentences for x in triples.sentence_triples(s))), t
    assert any(got.values()) and "Contains(t" in found._jdf.queryExecution().analyzed().toString().replace("contains(", "Contains(").replace("(t#", "(t")
