from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .mixing import mix


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words that a mix by source weights takes of it."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    coalesce(greatest(0.05::DOUBLE, 1.0::DOUBLE
      - 3.0::DOUBLE * (len(regexp_extract_all(text, '[!-@\[-`{-~]'))::DOUBLE / greatest(length(text), 1))
      - len(regexp_extract_all(text, '[A-Z]'))::DOUBLE / greatest(length(text), 1)), 0.05::DOUBLE) AS weight,
    (('0x' || md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null'))[1:12])::BIGINT::DOUBLE + 1.0) / 281474976710656.0::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / weight AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
r AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0.0)) /
        (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS level
      FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, greatest(least(cap, coalesce(weight * (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio), cap)), 0.0) AS target FROM l),
g AS (SELECT source, source_size, target,
        CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (SELECT k.doc_id, k.size, g.source_size, g.target, g.epochs, round(g.target)::BIGINT - g.epochs * g.source_size AS budget,
        coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST, k.size
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (epochs * size + least(size, greatest(0, budget - before)))::BIGINT AS taken
FROM p
"""

QUERIES = {"op1_mix_sources": (op1_mix_sources, SQL)}
