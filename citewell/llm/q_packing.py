from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .packing import pack


def op7_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 2048 tokens, sources mixed in every sequence by their token shares."""
    return pack(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


QUERIES = {"op7_pack_documents": (op7_pack_documents, None)}
