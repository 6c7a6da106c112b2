"""Shared pieces: written cuts in the shared folder, row keys, distributed prefix sums, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from citewell.session import ship_package, work_dir

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS = 1024


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python workers in batches of BATCH_ROWS rows, unless the session has a limit of its own: ten times as many, Spark's
    default, hold several copies of them outside the heap at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


_CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
_HASH_JOINS = {"spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB"}


def written(df: DataFrame, name: str, hash_joins: bool = False) -> DataFrame:
    """Cut the lineage: computed once, kept in the folder that all executors share, read back column-pruned. What the job shuffled on the way is
    removed once the table is complete. With ``hash_joins`` a shuffled join hashes its smaller side instead of sorting both, if no partition of
    that side, as measured when it is written, is over 64 MB."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{work_dir(spark)}/citewell-llm/{name}-{uuid.uuid4().hex}"
    settings = _CLEANUP | _HASH_JOINS if hash_joins else _CLEANUP
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*cuts: DataFrame) -> None:
    """Delete the tables of ``written`` that nothing reads any more."""
    for cut in cuts:
        spark = cut.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(cut.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


HOT_KEYS = 1000


def split_hot(keys: DataFrame, *on: str) -> tuple[DataFrame, DataFrame]:
    """``keys``, a written table with one row a key and in ``n`` how many rows have it, as the keys of more than one in HOT_KEYS of these rows, fewer
    than HOT_KEYS by that, and all others. Both without ``n``, or with all columns if ``on`` is empty."""
    total = keys.agg(F.sum("n").alias("n")).first()["n"] or 0
    hot = F.col("n") * HOT_KEYS > total
    columns = on or keys.columns
    return keys.filter(hot).select(*columns), keys.filter(~hot).select(*columns)


def meeting(rows: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the columns of their row in ``keys`` (as in `split_hot`): hot keys are broadcast, so no task of the shuffled rest gets one."""
    few, many = split_hot(keys)
    rest = rows.join(F.broadcast(few.select(*on)), on, "left_anti").join(many, on)
    return rows.join(F.broadcast(few), on).unionByName(rest)


def internal(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under names of our own: further columns of the input never clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def slices(batch: pa.RecordBatch, rows: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``rows`` rows, cut earlier where their texts and lists reach ``most`` bytes; a row is never split."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(c.type):
            size += 8 * pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(size), 0
    while at < batch.num_rows:
        full = int(np.searchsorted(total, (total[at - 1] if at else 0) + most)) + 1
        end = max(at + 1, min(at + rows, full, batch.num_rows))
        yield batch.slice(at, end - at)
        at = end


def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, component): the smallest id that each end of the ``a``-``b`` edges reaches. Ids without an edge are absent.

    Every round maps each id to its smallest neighbour, then contracts the edges by that map, so at least half of the
    remaining ids vanish per round. Joins are equi-joins on ids and the minimum is pre-aggregated, so a hub is not
    gathered in one task. Only a count of remaining edges reaches the driver."""
    edges = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                    .distinct(), f"{name}-edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id"))
    while not edges.isEmpty():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("parent"))
                         .withColumnRenamed("a", "of"), f"{name}-parents")
        labels = labels.join(parent, F.col("component") == F.col("of"), "left").select(
            "id", F.coalesce("parent", "component").alias("component"))
        labels = written(labels, f"{name}-labels")
        left = parent.select(F.col("of").alias("a"), F.col("parent").alias("pa"))
        right = parent.select(F.col("of").alias("b"), F.col("parent").alias("pb"))
        moved = edges.join(left, "a").join(right, "b").filter("pa <> pb")
        edges = written(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(),
                        f"{name}-edges")
    return labels


def running_total(df: DataFrame, group: list[str], order: list[str], amount: str, out: str) -> DataFrame:
    """Exclusive running sum of ``amount`` within ``group``. For small summary tables (a row for each part or bucket)."""
    window = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(amount).over(window), F.lit(0).cast("long")))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
