from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .neardup import near_duplicates


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents on two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
l AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS id, doc_id AS at FROM s UNION SELECT r.id, l.b FROM r JOIN l ON r.at = l.a)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, min(r.at)::BIGINT AS component_id, s.doc_id = min(r.at) AS kept
FROM s JOIN r ON r.id = s.doc_id GROUP BY s.doc_id, s.sh
"""

QUERIES = {"op2_near_duplicates": (op2_near_duplicates, SQL)}
