from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .quality import classify


def op5_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its quality score, learned from positives and unlabelled text."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op5_quality_scores": (op5_quality_scores, None)}
