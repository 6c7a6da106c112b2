import pytest
from pyspark.sql import functions as F

from citewell.operators import impact, index
from citewell.plans import answer, ingest
from citewell.sources import layout

TEXTS = [f"The {a} service is owned by Team {b}. It depends on {c} Hub and pages the {a} desk within {n} minutes."
         for n, (a, b, c) in enumerate([("Orders", "Kestrel", "Billing"), ("Rates", "Plover", "Orders"), ("Parcels", "Heron", "Rates"), ("Leave", "Wren", "Parcels")], 5)]


@pytest.fixture(scope="module")
def plain(spark):
    rows = [(t, f"doc{i}", f"Title {i}", TEXTS[i % 4] + f" Note {i}.", None, {}) for i in range(24) for t in ("a", "b")]
    return ingest.ingest(spark.createDataFrame(rows, "tenant_id string, doc_id string, title string, text string, source string, metadata map<string,string>"))


@pytest.fixture(scope="module")
def stored(plain):
    return layout.searchable(plain, buckets=6)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges_above_stored(df):
    """(bucketed scans, those of them that an exchange stands above before the first join)."""
    path, scans, moved = [], 0, 0
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-*(0123456789)"))
        path = [(d, x) for d, x in path if d < depth] + [(depth, line)]
        if "citewell_" in line and "Scan parquet" in line:
            scans += 1
            between = []
            for _, x in reversed(path[:-1]):
                if "Join" in x:
                    break
                between.append(x)
            moved += any("Exchange" in x for x in between)
    return scans, moved


def test_stored_sides_do_not_move(spark, stored, no_broadcast):
    asked = spark.createDataFrame([("a", "q", 0, ["order", "team", "hub"])], "tenant_id string, qid string, subquery_no int, terms array<string>")
    terms, cuts = impact.planned(asked, stored, stored["sizes"], 3)
    found = impact.found_chunks(cuts, stored)
    for df, least in ((found, 2), (impact.full_scores(found, terms, stored["forward"]), 3), (impact.weighed_terms(asked, stored, stored["sizes"]), 1)):
        scans, moved = exchanges_above_stored(df)
        assert scans >= least and moved == 0, df._jdf.queryExecution().executedPlan().toString()
    hits = spark.createDataFrame([("a", stored["body"].first().chunk_id, "q", 1)], "tenant_id string, chunk_id string, qid string, ref int")
    assert exchanges_above_stored(answer.with_text(hits, stored)) == (1, 0)


def test_the_check_sees_an_exchange(spark, plain, stored, no_broadcast):
    wrong = stored["body"].join(plain["terms"].select("tenant_id", "doc_id").distinct(), ["tenant_id", "doc_id"])
    assert exchanges_above_stored(wrong) == (1, 1)


def test_answers_are_the_same(spark, plain, stored):
    rows = [("a", f"q{i}", q, None) for i, q in enumerate(["Which team owns the Orders service?", "Who owns Rates and what does Parcels depend on?", "What is tungsten?"])]
    asked = spark.createDataFrame(rows, "tenant_id string, qid string, question string, top_k int")
    want, got = ({r.qid: r for r in answer.answer(asked, t).drop("trace", "latency_ms").collect()} for t in (plain, stored))
    assert got == want and any(r.citations for r in got.values())


def test_reopened_tables_hold_the_same_rows(spark, plain, tmp_path):
    body = plain["body"]
    path = str(tmp_path / "body")
    kept = layout.bucketed(body, "body", layout.CHUNK, 5, path)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in body.schema.fields)
    again = layout.attached(spark, path, ddl, layout.CHUNK, 5)
    key = lambda df: sorted(map(str, df.select(body.columns).collect()))
    assert key(kept) == key(again) == key(body)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert exchanges_above_stored(again.join(body.select(*layout.CHUNK, F.lit(1).alias("x")), list(layout.CHUNK))) == (1, 0)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_every_posting_and_pruned_search_agree(spark, stored, plain):
    asked = spark.createDataFrame([("a", "q", 0, ["order", "team", "hub"]), ("b", "r", 1, ["parcel", "minut"])],
                                  "tenant_id string, qid string, subquery_no int, terms array<string>")
    rows = lambda df: sorted(map(str, df.select("tenant_id", "qid", "chunk_id", "rank", "score").collect()))
    assert rows(impact.every_posting(asked, stored, stored["sizes"], 4)) == rows(impact.top_chunks(asked, stored, stored["sizes"], 4)) != []
    assert index.corpus_size(plain["terms"]).count() == 2
