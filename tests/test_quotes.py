import random

import duckdb
import pytest
from pyspark.sql import functions as F

from citewell.operators import quotes
from queries import retrieval


@pytest.mark.parametrize("step", [1 << 20, 50])
def test_every_text_that_holds_a_passage_is_found(spark, monkeypatch, step):
    r = random.Random(3)
    text = lambda n: "".join(r.choices("ab é.", [8, 4, 2, 1, 1], k=n))
    texts = [(f"d{i % 50}", text(r.choice((0, 1, 5, 40, 300)))) for i in range(60)] + [("none", None), (None, text(40))]
    items = [(f"q{i}", held[at:at + n]) for i, n in enumerate((1, 1, 2, 3, 5, 7, 9, 14, 15, 16, 30, 31, 40, 62, 63, 64, 90, 200, 300)) for held in [r.choice(texts[:60])[1]]
             for at in [r.randint(0, max(len(held) - n, 0))]] + [("empty", ""), ("null", None), (None, "a"), ("q0", "aa"), ("absent", "xyz")]
    want = {(q, c) for q, p in items for c, t in texts if None not in (q, c, p, t) and p in t}
    asked, held = spark.createDataFrame(items, "qid string, passage string"), spark.createDataFrame(texts, "chunk_id string, text string")
    for data in (t.encode() for _, t in texts[:60]):  # a text has the marks of all that it holds
        monkeypatch.setattr(quotes, "_STEP", step)
        found = set(quotes.text_marks(data, [4]).tolist())
        assert all(found >= set(quotes.text_marks(data[i:i + 7], [4]).tolist()) for i in range(len(data) - 6))
    got = [tuple(x) for x in quotes.pairs(asked, held).collect()]
    assert set(got) == want and len(got) == len(want) > 300
    only = [("q1", "a longer passage, of sixty-three bytes or more, that no text begins with")]
    one = quotes.pairs(spark.createDataFrame(only, "qid string, passage string"), spark.createDataFrame([("c", f"Mega{only[0][1]}s"), ("d", only[0][1][:-1])], "chunk_id string, text string"))
    assert [tuple(x) for x in one.collect()] == [("q1", "c")]


def test_passages_are_found_inside_words_and_when_short(spark, tmp_path):
    passages = ["Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi", "Storage quota", "ﬁne print of the ﬁrst contract", "nowhere to be seen"]
    texts = [f"pre{passages[0]}an rest", "Our Storage quotas are low", f"All the {passages[2]}.", "something else entirely"]
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = retrieval.bm25_quality(spark, str(tmp_path)).select("items", F.round("hit_rate", 6), F.round("mrr", 6)).collect()[0]
    want = con.execute(retrieval.QUALITY).fetchall()[0]
    assert got[0] == want[0] == 3
    assert abs(got[1] - want[1]) < 1e-6
