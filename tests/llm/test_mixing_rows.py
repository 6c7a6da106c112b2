"""The mixed table goes by row, and slices are bounded by bytes."""

import collections
import re

import pyarrow as pa
from citewell.llm import common, mixing
from pyspark.sql import functions as F


def test_rows_without_ids_and_equal_rows_are_mixed_one_by_one(spark):
    text = lambda i, n: "\n".join(f"w{i}-{j} x" for j in range(n // 2))
    rows = [(None, text(i, 100), "a") for i in range(50)] + [(7, text(7, 40), "b")] * 30 + [(8, text(i, 60), "b") for i in range(30)]
    rows += [(9, None, "b"), (None, "", None), (10, text(10, 20), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for c in ("size", "taken", "row", "words", "mix_row", "c0", "key"):
        docs = docs.withColumn(c, F.lit("clash"))
    got = mixing.mixed_documents(docs, share=0.5).collect()
    assert got[0].__fields__ == docs.columns
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    held = {t for _, t, _ in rows}
    whole = collections.Counter(r.source for r in got if r.text in held and count(r.text))
    cut = [r for r in got if r.text not in held]
    assert len(cut) <= 3 and all(any(t and t.startswith(r.text) for t in held) for r in cut)  # one border a source; line breaks stay
    assert 0 < whole["a"] < 50 and 0 < whole["b"] < 60
    goal = {r.source: r.target for r in mixing.mix(docs, share=0.5).select("source", "target").distinct().collect()}
    words = collections.Counter()
    for r in got:
        words[r.source] += count(r.text)
    assert all(abs(words[s] - t) <= 1 for s, t in goal.items())


def test_slices_are_bounded_by_rows_and_bytes():
    texts = ["x" * n for n in (1, 50, 3, 200, 0, 7, 7, 7)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array(texts), pa.array([[1] * (i % 3) for i in range(9)])], names=["i", "t", "l"])
    parts = list(common.slices(batch, 3, 64))
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()
    assert all(p.num_rows == 1 or (p.num_rows <= 3 and sum(len(t or "") for t in p.column(1).to_pylist()[:-1]) < 64) for p in parts)
    assert list(common.slices(batch.slice(0, 0), 3)) == [] and [p.num_rows for p in common.slices(batch, 100)] == [9]
