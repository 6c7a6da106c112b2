import hashlib
import re
import unicodedata
import uuid
from collections import Counter

from pyspark.sql import functions as F

from citewell import params as P
from citewell.functions import chunking, identity, text, triples
from citewell.operators import index

TRICKY = ["plain ascii", "café", "café", "Ｆｕｌｌ width", "zero​width﻿", "ﬁligature", "x²", "日本", "한", "", " nbsp"]


def test_stable_class_holds_only_stable_characters():
    stable = re.compile(f"[{text.NFKC_STABLE}]")
    for code in range(0x10000):
        char = chr(code)
        if not 0xD800 <= code < 0xE000 and stable.match(char):
            assert unicodedata.normalize("NFKC", char) == char and not unicodedata.combining(char), hex(code)


def test_normalize_equals_unicodedata(spark):
    rows = text.with_normalized(spark.createDataFrame([(t,) for t in TRICKY], "raw string"), "raw", "n").collect()
    drop = dict.fromkeys(map(ord, P.ZERO_WIDTH))
    assert {r.raw: r.n for r in rows} == {t: unicodedata.normalize("NFKC", t).translate(drop) for t in TRICKY}


def test_term_counts_equal_a_counter(spark):
    docs = ["run runs running run", "the of", "", "a-b a_b A-B policies policy"]
    rows = index.with_terms(spark.createDataFrame([(d,) for d in docs], "text string")).select("terms", text.term_counts(F.col("terms")).alias("c")).collect()
    for r in rows:
        assert {x.term: x.tf for x in r.c} == Counter(r.terms)
    assert sorted(map(tuple, (r.terms for r in rows))) == sorted([("run", "runs", "runn", "run"), ("the", "of"), (), ("a-b", "a_b", "a-b", "policy", "policy")])


def test_sentences_and_overlap(spark):
    row = spark.createDataFrame([("One  two. Three!\n(Four) five? six. 7 eight.",)], "t string").select(
        text.sentences(F.col("t")).alias("s"), text.overlap(F.lit("one nine"), F.col("t")).alias("o"), text.overlap(F.lit("the"), F.col("t")).alias("z")).first()
    assert row.s == ["One two.", "Three!", "(Four) five? six.", "7 eight."]
    assert row.o == 0.5 and row.z == 0.0


def test_identities(spark):
    row = spark.createDataFrame([("t1", "d", "body")], "a string, d string, b string").select(
        identity.chunk_id(F.col("d"), F.lit(3), F.col("b")).alias("c"), identity.point_id(F.col("a"), F.lit("d#3")).alias("p")).first()
    assert row.c == "d#3-" + hashlib.sha256(b"body").hexdigest()[:12]
    assert row.p == str(uuid.uuid5(uuid.UUID(P.POINT_NAMESPACE), "t1:d#3"))


def test_embedding_follows_shared_words(spark):
    docs = ["payments api latency slo", "latency objective of payments api", "vacation policy for weekends"]
    for mode in ("md5", "blake2b"):
        df = index.with_terms(spark.createDataFrame(list(enumerate(docs)), "i int, text string"))
        v = {r.i: r.e for r in df.select("i", identity.hash_embedding(F.col("content"), 256, mode).alias("e")).collect()}
        dot = lambda a, b: sum(x * y for x, y in zip(v[a], v[b]))
        assert dot(0, 1) > dot(0, 2) and abs(dot(0, 0) - 1) < 1e-9


def test_windows_keep_sections_and_bounds(spark):
    body = "# Title\n\n## Alpha\n\n" + "word " * 400 + "\n\nnext paragraph\n\n## Empty\n\n## Beta\r\n\r\nshort body"
    rows = chunking.with_windows(spark.createDataFrame([(body,), ("  lead\n\n tail ",), (" \n ",)], "text string"), "text", "w", 500, 80).collect()
    long, plain, blank = (next(r.w for r in rows if r.text == t) for t in (body, "  lead\n\n tail ", " \n "))
    assert {x.section for x in long} == {"Alpha", "Beta"} and all(len(x.text) <= 580 for x in long)
    assert long[-1].text == "short body" and "next paragraph" in long[-2].text
    assert [(x.section, x.text) for x in plain] == [(None, "lead\n\ntail")] and blank == []


def test_next_window_starts_with_the_end_of_the_last_one():
    windows = chunking.pack_windows("\n\n".join(f"paragraph number {i} " + "x" * 60 for i in range(12)), 200, 40)
    assert len(windows) > 3
    for before, after in zip(windows, windows[1:]):
        carried = after.split("\n\n")[0]
        assert before.endswith(carried) and len(carried) <= 40


def test_triples(spark):
    said = ("Billing Hub stores data in Cold Vault and is owned by Team Kestrel. The Orders API depends on Billing Hub, Rate Guard, and Mail Relay. "
            "\n# Foo uses Bar\nGateway, which uses Redis. lowercase uses Nothing. Loop calls Loop.")
    rows = spark.createDataFrame([(said,)], "text string").select(F.inline(triples.extracted(F.col("text")))).collect()
    assert [tuple(r) for r in rows] == [
        ("Billing Hub", "stores data in", "Cold Vault"), ("Billing Hub", "owned by", "Team Kestrel"), ("Orders API", "depends on", "Billing Hub"),
        ("Orders API", "depends on", "Rate Guard"), ("Orders API", "depends on", "Mail Relay"), ("Gateway", "uses", "Redis")]
