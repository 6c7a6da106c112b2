from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .fingerprints import compare_with_next


def op9_fingerprint_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are."""
    return compare_with_next(table(spark, sf_dir, "documents"))


QUERIES = {"op9_fingerprint_documents": (op9_fingerprint_documents, None)}
