from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .sqlcrc import crc_table, crc32
from .trie import prefix_trie, shared_heads


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, rebuilt on shared heads, as a trie with the leaves and savings of every subtree."""
    return prefix_trie(table(spark, sf_dir, "conversations"), rebuild=shared_heads)


SQL = rf"""
WITH RECURSIVE {crc_table()},
c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
        {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t
      FROM conversations WHERE conv_id IS NOT NULL),
g AS (SELECT conv_id, list(t ORDER BY pos) AS own FROM c GROUP BY conv_id),
h AS (SELECT g.conv_id, g.own, b.own AS base, {crc32("encode(g.conv_id::VARCHAR)")} % 4 AS h
      FROM g CROSS JOIN crc_list LEFT JOIN g b ON b.conv_id = g.conv_id - g.conv_id % 20),
r AS (SELECT conv_id, list_concat(coalesce(base, [])[1:h::INT], own[h::INT + 1:]) AS turns FROM h),
p AS (SELECT conv_id, d, turns[1:d] AS prefix, len(turns) = d AS ends FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM r)),
n AS (SELECT d, prefix, min(conv_id) AS id, count(*) AS n_convs,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS sha FROM p GROUP BY d, prefix),
q AS (SELECT n.*, a.id AS parent FROM n LEFT JOIN n a ON a.d = n.d - 1 AND a.prefix = n.prefix[1:(n.d - 1)]),
k AS (SELECT q.*, (SELECT count(*) FROM q x WHERE x.parent = q.id AND x.d = q.d + 1) AS n_children,
        CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(prefix[d].text, '[^\x20\x09-\x0D]+')) END AS saved FROM q),
u AS (SELECT id AS top, d AS top_d, id, d FROM k UNION ALL SELECT u.top, u.top_d, k.id, k.d FROM u JOIN k ON k.parent = u.id AND k.d = u.d + 1),
s AS (SELECT top, top_d, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
      FROM u JOIN k USING (id, d) GROUP BY ALL)
SELECT k.id AS conv_id, k.d::BIGINT AS depth, k.parent AS parent_conv_id, k.n_convs::BIGINT AS n_convs, k.n_children::BIGINT AS n_children,
  s.n_leaves, s.saved_tokens, k.sha AS ends_sha256
FROM k JOIN s ON s.top = k.id AND s.top_d = k.d
"""

QUERIES = {"op11_prefix_trie": (op11_prefix_trie, SQL)}
