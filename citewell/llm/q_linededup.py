from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .linededup import dedup_lines


def op10_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the runs of lines that an earlier document (or an earlier place) already has."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("__removed").alias("lines_removed"), F.col("__words_removed").alias("words_removed"),
                      F.col("__removed_lines").alias("removed_lines"))


QUERIES = {"op10_dedup_lines": (op10_dedup_lines, None)}
