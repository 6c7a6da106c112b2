"""Ranks and running totals within groups of any size.

Rows are sorted over all tasks by range, numbered and summed inside each task as they stream by, and written. Only a group that
runs on from one task into the next needs anything from another task; the first group of a task is the only one that can, so what
is carried over is at most one row per task, whatever the groups are. A group with a third of all rows is spread over its range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written


def _scan(new: np.ndarray, values: np.ndarray, before: int, sums: bool) -> np.ndarray:
    """Running sum or exclusive or of ``values``, begun anew where ``new``; ``before`` is what the first group brings along."""
    at = np.arange(len(values))
    first = np.maximum.accumulate(np.where(new, at, 0))
    with np.errstate(over="ignore"):
        run = np.cumsum(values) if sums else np.bitwise_xor.accumulate(values)
        held = np.concatenate([np.zeros(1, np.int64), run])[first]
        run = run - held if sums else run ^ held
        going_on = np.cumsum(new) == 0
        return np.where(going_on, run + before if sums else run ^ before, run)


def scanned(df: DataFrame, group: str, order: list[str | Column], name: str, sums: tuple[str, ...] = (), xors: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with rank (1, 2, ... within ``group`` in ``order``) and run_<c> for each column of ``sums`` (running sum) and ``xors`` (running
    exclusive or), the row itself included. ``group`` and the scanned columns are longs without nulls; rows equal in ``order`` come in
    any order. An empty table gives no rows."""
    runs = [*sums, *xors]
    fields = [*df.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("rank", T.LongType())]
    fields += [T.StructField(f"run_{c}", T.LongType()) for c in runs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, held = TaskContext.get().partitionId(), None, dict.fromkeys(["rank", *runs], 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(batch.schema.get_field_index(group)).to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.empty(len(key), dtype=bool)
            new[0], new[1:] = last is None or key[0] != last, key[1:] != key[:-1]
            columns = {"rank": _scan(new, np.ones(len(key), np.int64), held["rank"], True)}
            for c in runs:
                values = batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64)
                columns[c] = _scan(new, values, held[c], c in sums)
            last, held = key[-1], {c: v[-1] for c, v in columns.items()}
            arrays = [*batch.columns, pa.array(np.full(len(key), part, np.int32)), *[pa.array(v) for v in columns.values()]]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    ordered = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    local = written(ordered.mapInArrow(run, T.StructType(fields)), name)
    values = ["rank", *[f"run_{c}" for c in runs]]
    ends = local.groupBy("part").agg(F.min(group).alias("first"), F.max(F.struct(group, *values)).alias("last")).orderBy("part").collect()
    carried, open_group, held = [], None, [0] * len(values)
    for e in ends:  # a row per task
        if e["first"] == open_group:
            carried.append((e["part"], open_group, *held))
        else:
            held = [0] * len(values)
        own = [e["last"][v] for v in values]
        if e["last"][group] == open_group:
            own = [a ^ b if v in {f"run_{c}" for c in xors} else a + b for v, a, b in zip(values, own, held, strict=True)]
        open_group, held = e["last"][group], own
    schema = "__part int, __group long, " + ", ".join(f"__{v} long" for v in values)
    carry = F.broadcast(df.sparkSession.createDataFrame(carried, schema))  # at most one row per task
    met = local.join(carry, (F.col("part") == F.col("__part")) & (F.col(group) == F.col("__group")), "left")
    whole = {v: F.coalesce(F.col(f"__{v}"), F.lit(0).cast("long")) for v in values}
    xored = {f"run_{c}" for c in xors}
    return met.select(*[F.col(f"`{c}`") for c in df.columns],
                      *[(F.col(v).bitwiseXOR(whole[v]) if v in xored else F.col(v) + whole[v]).alias(v) for v in values])
