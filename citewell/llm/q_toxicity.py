from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .toxicity import classify


def op4_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its toxicity score from a factorization machine."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op4_toxicity_scores": (op4_toxicity_scores, None)}
