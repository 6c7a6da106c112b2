from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .resampling import resample
from .sqlcrc import crc32, crc_table


def op13_resample_to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their score towards the benchmark's word distribution, a tenth of them drawn and ranked."""
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def _words(c: str) -> str:
    return rf"regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


SQL = rf"""
WITH RECURSIVE {crc_table()},
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_words('text')}, []) AS w FROM documents),
dw AS (SELECT r, unnest(w) AS w FROM d),
bw AS (SELECT unnest(coalesce({_words('text')}, [])) AS w FROM benchmark),
v AS (SELECT w, {crc32('encode(w)')} % 10000 AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw) CROSS JOIN crc_list),
s AS (SELECT b, count(*) AS n FROM dw JOIN v USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM bw JOIN v USING (w) GROUP BY b),
g AS (SELECT x.b, floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + 10000))
        / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000))))::BIGINT AS gain
      FROM (SELECT range AS b FROM range(10000)) x LEFT JOIN s ON s.b = x.b LEFT JOIN t ON t.b = x.b),
m AS (SELECT r, sum(gain)::BIGINT AS total FROM dw JOIN v USING (w) JOIN g USING (b) GROUP BY r),
k AS (SELECT d.r, doc_id, len(w)::BIGINT AS n_features,
        CASE WHEN len(w) > 0 THEN (total - ((total % len(w)) + len(w)) % len(w)) // len(w) ELSE 0 END AS weight,
        ('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h
      FROM d LEFT JOIN m ON m.r = d.r),
c AS (SELECT *, (weight + floor(-1000 * ln(-ln((h::DOUBLE + 0.5) / 4294967296.0::DOUBLE))))::BIGINT AS score FROM k),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM c WHERE n_features >= 20)
SELECT c.doc_id, c.n_features, c.weight::BIGINT AS weight, c.score, CASE WHEN o.place <= 10 * o.n // 100 THEN o.place END::BIGINT AS rank
FROM c LEFT JOIN o USING (r)
"""

QUERIES = {"op13_resample_to_target": (op13_resample_to_target, SQL)}
