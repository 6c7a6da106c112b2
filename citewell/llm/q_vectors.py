from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .vectors import near_vectors


def op8_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.9."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS len FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
      WHERE a.len > 0 AND b.len > 0 AND list_inner_product(a.e, b.e) / (a.len * b.len) >= 0.9),
r AS (SELECT vec_id AS id, vec_id AS at FROM v UNION SELECT r.id, l.b FROM r JOIN l ON r.at = l.a)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id)::BIGINT AS n_links, min(r.at)::BIGINT AS component_id,
  v.vec_id = min(r.at) AS kept
FROM v JOIN r ON r.id = v.vec_id GROUP BY v.vec_id
"""

QUERIES = {"op8_near_vectors": (op8_near_vectors, SQL)}
