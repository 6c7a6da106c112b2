"""Which texts hold which passages as a whole: an equi join on marks, then the exact test.

The mark of a passage is the least hash among its first ``w`` windows of ``w`` bytes. A text has the least hash of any ``w`` windows in a row, so it
has the mark of every passage in it, wherever that begins and ends. ``w`` goes by the passage's length, so that long passages meet few texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTHS = (32, 16, 8, 4, 2, 1)  # for passages of 2 w - 1 bytes or more
_STEP = 1 << 20  # bytes of a text that are hashed at once
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _least(data: np.ndarray, width: int) -> np.ndarray:
    """The least hash of any ``width`` windows of ``width`` bytes in a row."""
    h, step, base = data.astype(np.uint64), 1, _BASE
    while step < width:
        h, step, base = h[:-step] * np.uint64(base) + h[step:], 2 * step, base * base % (1 << 64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(_MIX)
    h ^= h >> np.uint64(32)
    step = 1
    while step < width:
        h, step = np.minimum(h[:-step], h[step:]), 2 * step
    return h


def text_marks(data: bytes, widths: list[int]) -> np.ndarray:
    """The distinct marks of all passages of these widths that the text may hold."""
    held, out = np.frombuffer(data, np.uint8), [np.empty(0, np.uint64)]
    for w in widths:
        out += [np.unique(_least(held[i:i + _STEP + 2 * w - 2], w)) for i in range(0, len(held) - 2 * w + 2, _STEP)]
    return np.unique(np.concatenate(out))


def _marked(widths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_marks(data, widths) for data in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, found)])
            marks = np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(marks))], names=["id", "marks"])

    return run


def _marks(rows: DataFrame, key: str, column: str, widths: list[int]) -> DataFrame:
    """The key and one of the marks of a row."""
    kind = dict(rows.dtypes)[key]
    held = rows.filter(F.col(column).isNotNull()).select(F.col(key).alias("id"), F.col(column).cast("binary").alias("data"))
    return held.mapInArrow(_marked(widths), f"id {kind}, marks array<bigint>").select(F.col("id").alias(key), F.explode("marks").alias("mark"))


def pairs(items: DataFrame, texts: DataFrame) -> DataFrame:
    """items: qid, passage; texts: chunk_id, text. Distinct qid, chunk_id of the texts that hold the passage. Null keys meet nobody; an empty passage
    is in every text."""
    items, texts = items.select("qid", "passage"), texts.select("chunk_id", "text")
    long = F.octet_length("passage")
    width = F.coalesce(*[F.when(long >= 2 * w - 1, F.lit(w)) for w in WIDTHS])
    sized = items.withColumn("width", width)
    used = sorted(r.width for r in sized.select("width").distinct().collect() if r.width)
    first = [_marks(sized.filter(F.col("width") == w).select("qid", F.substring(F.col("passage").cast("binary"), 1, 2 * w - 1).alias("lead")), "qid", "lead", [w]) for w in used]
    near = items.filter(long == 0).select("qid").crossJoin(texts.filter("text is not null").select("chunk_id"))
    if used:
        lead = first[0]
        for more in first[1:]:
            lead = lead.unionByName(more)
        near = near.unionByName(_marks(texts, "chunk_id", "text", used).join(lead, "mark").select("qid", "chunk_id"))
    # the texts come last, once for each pair that shares a mark
    held = near.distinct().join(texts, "chunk_id").join(items, "qid").filter(F.contains("text", F.col("passage")))
    return held.select("qid", "chunk_id").distinct()
