"""Guardrail events of the three stages, counted from what the plans return: input and output from answers, ingest from screened chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell.operators import traffic

# FIXED VALUES: event types of block reasons and of output flags
INPUT_TYPES = {"prompt_injection": "prompt_injection", "harmful_content": "harmful"}
OUTPUT_TYPES = {"system_prompt_leak": "prompt_leak", "invalid_citations_removed": "invalid_citation", "suspicious_output": "suspicious"}


def _named(values: Column, names: dict[str, str]) -> Column:
    known = F.filter(values, lambda v: v.isin(*names))
    return F.transform(known, lambda v: F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), v))


def _pii(kinds: Column) -> Column:
    return F.transform(kinds, lambda k: F.concat(F.lit("pii_"), F.lower(k)))


def input_events(checked: DataFrame) -> DataFrame:
    """checked: questions after the input check -> (tenant_id, stage, type), one row per event."""
    reason = F.when(F.col("block_reason").isNotNull(), F.array("block_reason")).otherwise(F.array().cast("array<string>"))
    kinds = F.concat(_pii(F.col("pii_types")), _named(reason, INPUT_TYPES))
    return checked.select("tenant_id", F.lit("input").alias("stage"), F.explode(kinds).alias("type"))


def output_events(checked: DataFrame) -> DataFrame:
    """checked: answers after the output check, with output_pii and output_flags."""
    kinds = F.concat(_pii(F.col("output_pii")), _named(F.col("output_flags"), OUTPUT_TYPES))
    return checked.select("tenant_id", F.lit("output").alias("stage"), F.explode(kinds).alias("type"))


def ingest_events(screened: DataFrame) -> DataFrame:
    """screened: chunks of the ingest plan; every quarantined one is an event."""
    return screened.filter("quarantined").select("tenant_id", F.lit("ingest").alias("stage"), F.lit("indirect_injection").alias("type"))


def counted(*events: DataFrame) -> DataFrame:
    rows = events[0]
    for more in events[1:]:
        rows = rows.unionByName(more)
    return traffic.counters(rows, "tenant_id", "stage", "type")
