from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bestfit import pack_best_fit
from .common import table


def op12_pack_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in as few sequences of 2048 tokens as best-fit finds; only longer documents are cut."""
    return pack_best_fit(table(spark, sf_dir, "documents"), with_ids=False).drop("ids")


QUERIES = {"op12_pack_best_fit": (op12_pack_best_fit, None)}
