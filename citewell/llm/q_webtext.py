from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .webtext import extract


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op3_main_text": (op3_main_text, None)}
