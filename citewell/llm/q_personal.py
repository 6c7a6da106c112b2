from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .personal import KINDS, personal_data, train


def _joined(spans: Column) -> Column:
    place = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), place[s["kind"]].alias("k"), s["kind"].alias("n"), s["end"].alias("e"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["n"], s["a"].cast("string"), s["e"].cast("string"))), ",")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of all documents: base counts, a digest of the base spans, and all spans."""
    docs = table(spark, sf_dir, "documents")
    found = personal_data(docs, field=train(docs))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"),
                        F.size("added").cast("long").alias("n_added"))


QUERIES = {"op6_personal_data": (op6_personal_data, None)}
