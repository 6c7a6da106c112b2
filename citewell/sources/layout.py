"""Index tables laid out for the joins that read them.

A stored table is hashed into buckets by the keys that searches join on. A batch of questions then moves only its own rows: its side is
shuffled to the buckets, the stored side is read where it lies. Keys that one value could dominate are not used: postings go by
(tenant, term, slice), where a slice is bounded, texts and weights by (tenant, chunk)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from citewell import params as P
from citewell import session
from citewell.operators import impact

CHUNK = ("tenant_id", "chunk_id")
TERM = ("tenant_id", "term")
KEYS = {"blocks": (*TERM, "slice"), "slices": TERM, "term_stats": TERM, "forward": CHUNK, "body": CHUNK, "chunks": CHUNK}


def _columns(names: tuple[str, ...]) -> str:
    return ", ".join(f"`{n}`" for n in names)


def attached(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], buckets: int) -> DataFrame:
    """A table that `bucketed` wrote earlier, maybe in another session, under a name of this session."""
    name = f"citewell_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({_columns(keys)}) SORTED BY ({_columns(keys)}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def bucketed(df: DataFrame, name: str, keys: tuple[str, ...], buckets: int, path: str | None = None) -> DataFrame:
    """``df`` written as one sorted file a bucket, under ``path`` (default: a new one in the shared folder), and read back as a table whose joins on
    ``keys`` need no exchange."""
    spark, path = df.sparkSession, path or session.new_path(df.sparkSession, name)
    writer = df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).format("parquet")
    writer.saveAsTable(table := f"citewell_{uuid.uuid4().hex}")
    return spark.table(table)


def searchable(tables: dict[str, DataFrame], s: P.Settings = P.DEFAULTS, buckets: int | None = None) -> dict[str, DataFrame]:
    """The tables of `ingest.ingest` as searches want them: posting blocks, and what searches join stored by bucket."""
    sizes = session.written(tables["sizes"], "sizes")
    return co_located({**tables, "sizes": sizes, **impact.build(tables["postings"], sizes, s)}, buckets)


def co_located(tables: dict[str, DataFrame], buckets: int | None = None) -> dict[str, DataFrame]:
    """``tables`` with all those of KEYS stored by bucket (default: as many as there are shuffle partitions)."""
    spark = next(iter(tables.values())).sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return {name: bucketed(df, name, KEYS[name], buckets) if name in KEYS else df for name, df in tables.items()}
