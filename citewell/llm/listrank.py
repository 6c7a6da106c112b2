"""Ranks in a linked list whose elements lie anywhere: random-mate contraction.

In each round every element tosses a coin by a hash of its id and the round. An element that shows heads and whose predecessor shows
tails is taken out; the predecessor inherits its successor and adds its step. No two neighbours go at once, so one equi-join on ids,
which are unique, does a round, and a quarter of the list goes. All rounds together move about four times the list, where pointer
jumping would move it whole once per doubling. Of the list that is left, at most ``LEFT`` elements at any size of the input, one
task adds up the steps; then the rounds are undone: who was taken out stands one step behind its predecessor."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

LEFT = 8192


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    after = {i: (n, w) for batch in batches for i, n, w in zip(*(c.to_pylist() for c in batch.columns), strict=True)}
    followed = {n for n, _ in after.values()}
    at, rank, ids, ranks = next((i for i in after if i not in followed), None), 0, [], []
    while at is not None:
        ids.append(at)
        ranks.append(rank)
        at, step = after[at]
        rank += step
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ranks, pa.int64())], names=["id", "rank"])


def list_ranks(links: DataFrame, name: str = "list", left: int = LEFT) -> DataFrame:
    """(id, rank): how many elements of the list come before ``id``. ``links`` holds (id, next), longs, the last element's next null; the
    ids form one list. An empty table gives no rows."""
    now, undo, k = written(links.select("id", "next", F.lit(1).cast("long").alias("step")), f"{name}-links"), [], 0
    while now.count() > left:
        heads = F.xxhash64("id", F.lit(k)).bitwiseAND(F.lit(1)) == 1
        met = now.filter(~heads).join(now.filter(heads).toDF("g_id", "g_next", "g_step"), F.col("next") == F.col("g_id"), "full_outer")
        met = written(met, f"{name}-round-{k}")
        undo.append(met.filter("id is not null and g_id is not null").select(
            F.col("g_id").alias("id"), F.col("id").alias("before"), "step"))
        alone, stays = F.col("g_id").isNull(), F.col("id").isNull()
        now = met.select(F.coalesce("id", "g_id").alias("id"), F.when(alone, F.col("next")).otherwise(F.col("g_next")).alias("next"),
                         F.when(alone, F.col("step")).when(stays, F.col("g_step")).otherwise(F.col("step") + F.col("g_step")).alias("step"))
        k += 1
    ranks = written(now.coalesce(1).mapInArrow(_walk, "id long, rank long"), f"{name}-rest")
    for k, gone in reversed(list(enumerate(undo))):
        behind = gone.join(ranks.toDF("before", "at"), "before").select("id", (F.col("at") + F.col("step")).alias("rank"))
        ranks = written(ranks.unionByName(behind), f"{name}-ranks-{k}")
    return ranks
