"""Session helpers: builder and written cuts of the lineage.

Joins carry no hints: adaptive execution broadcasts a side by its measured bytes and splits skewed partitions."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution. The number of shuffle partitions is the caller's; without one, Spark's own holds."""
    builder = (
        SparkSession.builder.master(master)
        .appName("citewell")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship_package(spark)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> SparkSession:
    """Makes this package importable in the Python workers, wherever they run."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="citewell-")) / "citewell_package.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(root.rglob("*.py")):
                z.write(source, source.relative_to(root.parent))
        context.addPyFile(str(archive))
        _shipped.add(context.applicationId)
    return spark


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster. Only a local master may do without one and then gets a local folder."""
    configured = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", ""
    )
    if not configured:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="citewell-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/citewell/{name}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Cut the lineage with a written table: what several later steps read is computed once, column-pruned on
    each read, and survives the loss of executors. What was shuffled on the way is removed once the table is complete."""
    path = new_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists").option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
