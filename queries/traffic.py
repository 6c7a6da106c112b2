"""Request-log analytics over the events table, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from citewell import params as P
from citewell import schemas
from citewell.operators import traffic
from citewell.streaming import traffic as streaming
from citewell.session import ship_package

DAY = 86_400


def as_requests(events):
    return events.select(
        "event_id", "ts", F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"),
        F.concat(F.lit("k"), (F.col("user_id") % 2).cast("string")).alias("key_id"),
        F.concat(F.col("user_id").cast("string"), F.col("event_type")).alias("cache_key"), F.col("event_type").alias("route"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("value").alias("latency_ms"),
        (F.col("value") > 20).alias("cacheable"))


def _events(spark, d):
    """With the explicit schema the stored times are instants, whatever the session time zone is."""
    ship_package(spark)
    return spark.read.schema(schemas.EVENT).parquet(f"{d}/events.parquet")


def requests(spark, d):
    return as_requests(_events(spark, d))


def request_stream(spark, d):
    ship_package(spark)
    return as_requests(streaming.file_stream(spark, d, schemas.EVENT, "events.parquet"))


REQUESTS = """(SELECT event_id, ts, epoch_us(ts) AS t, epoch_us(ts) // 60000000 AS minute, 't' || (user_id % 5) AS tenant_id, 'k' || (user_id % 2) AS key_id, user_id || event_type AS cache_key,
event_type AS route, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status, value AS latency_ms, value > 20 AS cacheable FROM events)"""


def rate_limit(spark, d):
    return traffic.rate_limit(requests(spark, d), "event_id", 1).select("event_id", "tenant_id", "key_id", "minute", "allowed")


RATE = f"""SELECT event_id, tenant_id, key_id, minute, row_number() OVER (PARTITION BY tenant_id, key_id, minute ORDER BY ts, event_id) <= 1 AS allowed FROM {REQUESTS}"""


def rate_limit_stream(spark, d):
    return streaming.run_available(streaming.rate_verdicts(request_stream(spark, d), "event_id", 1), "verdicts", "append")


def request_counts_stream(spark, d):
    return streaming.run_available(streaming.request_counts(request_stream(spark, d)), "counts", "update", ["tenant_id", "key_id", "minute"])


COUNTS = f"SELECT tenant_id, key_id, minute, count(*)::BIGINT AS requests FROM {REQUESTS} GROUP BY ALL"


def answer_cache(spark, d):
    return traffic.cache_outcomes(requests(spark, d), "event_id", DAY).select("event_id", "cache_key", "hit")


def answer_cache_chained(spark, d):
    """The same through the path for very large keys."""
    return traffic.cache_outcomes(requests(spark, d), "event_id", DAY, max_fold=3).select("event_id", "cache_key", "hit")


def answer_cache_stream(spark, d):
    return streaming.run_available(streaming.cache_verdicts(request_stream(spark, d), "event_id", DAY), "cached", "append")


CACHE = f"""WITH RECURSIVE r AS (SELECT * FROM {REQUESTS}), ok AS (SELECT cache_key, t, min(event_id) AS id FROM r WHERE cacheable GROUP BY ALL),
st AS (SELECT cache_key, min(t) AS t FROM ok GROUP BY ALL UNION ALL
 SELECT s.cache_key, min(ok.t) FROM st s JOIN ok ON ok.cache_key = s.cache_key AND ok.t > s.t + {DAY}000000 GROUP BY s.cache_key),
stores AS (SELECT cache_key, t, id FROM st JOIN ok USING (cache_key, t))
SELECT event_id, cache_key, EXISTS (SELECT 1 FROM stores s WHERE s.cache_key = r.cache_key AND (s.t < r.t OR (s.t = r.t AND s.id < r.event_id)) AND r.t - s.t <= {DAY}000000) AS hit FROM r"""


def error_rate(spark, d):
    a = traffic.error_rate_alert(requests(spark, d), F.col("status") >= 500, threshold=0.5, hold=4)
    return a.select("minute", "errors", "total", "rate", "firing")


def error_rate_stream(spark, d):
    rows = streaming.run_available(streaming.error_rates(request_stream(spark, d), F.col("status") >= 500), "rates", "update", ["minute"])
    return traffic.sustained(rows.withColumn("breach", F.col("errors") / F.col("total") > 0.5), 4).select("minute", "errors", "total", "rate", "firing")


def model_errors(spark, d):
    """Share of failed model calls, here: purchases with a value under 5."""
    calls = requests(spark, d).filter("route in ('purchase', 'click')")
    a = traffic.error_rate_alert(calls, F.col("latency_ms") < 5, threshold=0.1, hold=5)
    return a.select("minute", "errors", "total", "firing")


def _sliding_sql(aggregates: str, totals: list[str], width: int, source: str = REQUESTS) -> str:
    return f"""m AS (SELECT minute, {aggregates} FROM {source} q GROUP BY minute),
w AS (SELECT m.minute + g.i AS minute, {', '.join(f'sum({t})::BIGINT AS {t}' for t in totals)} FROM m, generate_series(0, {width - 1}) AS g(i) GROUP BY 1)"""


def _sustained_sql(hold: int) -> str:
    return f"""c AS (SELECT *, CASE WHEN lag(minute) OVER o IS DISTINCT FROM minute - 1 OR lag(breach) OVER o IS DISTINCT FROM breach THEN 1 ELSE 0 END AS ch FROM b WINDOW o AS (ORDER BY minute)),
u AS (SELECT *, sum(ch) OVER (ORDER BY minute) AS run FROM c), f AS (SELECT *, breach AND minute - min(minute) OVER (PARTITION BY run) >= {hold} AS firing FROM u)"""


ERRORS = f"""WITH {_sliding_sql("count_if(status >= 500) AS errors, count(*) AS total", ['errors', 'total'], 5)},
b AS (SELECT *, errors::DOUBLE / total > 0.5 AS breach FROM w), {_sustained_sql(4)}
SELECT minute, errors, total, round(errors::DOUBLE / total, 6) AS rate, firing FROM f"""
_CALLS = f"(SELECT * FROM {REQUESTS} q0 WHERE route IN ('purchase', 'click'))"
MODEL = f"""WITH {_sliding_sql("count_if(latency_ms < 5) AS errors, count(*) AS total", ['errors', 'total'], 5, _CALLS)},
b AS (SELECT *, errors::DOUBLE / total > 0.1 AS breach FROM w), {_sustained_sql(5)} SELECT minute, errors, total, firing FROM f"""


def spike(spark, d):
    return traffic.spike_alert(requests(spark, d), F.col("status") >= 500, threshold=2)


def spike_stream(spark, d):
    return streaming.run_available(streaming.spikes(request_stream(spark, d), F.col("status") >= 500, 2), "spikes", "update", ["minute"])


SPIKE = f"""WITH {_sliding_sql("count_if(status >= 500) AS n", ['n'], 15)} SELECT minute, n, n > 2 AS firing FROM w"""


def latency_p95(spark, d):
    a = traffic.latency_alert(requests(spark, d), F.col("latency_ms") / 10, hold=3)
    return a.select("minute", "total", F.round("p95", 6).alias("p95"), "firing")


_LE = traffic.HTTP_BUCKETS
_QUANTILE, _low, _below = "CASE", 0.0, "0"
for _i, _b in enumerate(_LE):
    _QUANTILE += f" WHEN le_{_i} >= 0.95::DOUBLE * total THEN {_low}::DOUBLE + ({_b}::DOUBLE - {_low}::DOUBLE) * (0.95::DOUBLE * total - {_below}) / (le_{_i} - {_below})"
    _low, _below = _b, f"le_{_i}"
_QUANTILE += f" ELSE {_LE[-1]}::DOUBLE END"
P95 = f"""WITH {_sliding_sql(", ".join(f"count_if(latency_ms / 10 <= {b}) AS le_{i}" for i, b in enumerate(_LE)) + ", count(*) AS total", [f"le_{i}" for i in range(len(_LE))] + ['total'], 5)},
p AS (SELECT *, {_QUANTILE} AS p95 FROM w), b AS (SELECT *, p95 > 8 AS breach FROM p), {_sustained_sql(3)}
SELECT minute, total, round(p95, 6) AS p95, firing FROM f"""


def latency_quantiles(spark, d):
    q = traffic.latency_quantiles(requests(spark, d), ["route"])
    return q.select("route", F.round("p50", 6).alias("p50"), "p95")


QUANTILES = f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY latency_ms) - 1 AS i, count(*) OVER (PARTITION BY route) AS n FROM {REQUESTS})
SELECT route, round(quantile_cont(latency_ms, 0.5), 6) AS p50, max(CASE WHEN i = floor(0.95 * (n - 1)) THEN latency_ms END) AS p95 FROM r GROUP BY route"""


def latency_histogram(spark, d):
    return traffic.histogram(requests(spark, d), F.col("latency_ms") / 100, ["route", "status"], P.NODE_BUCKETS)


HISTOGRAM = " UNION ALL ".join(
    [f"SELECT route, status, '{b}' AS le, count_if(latency_ms / 100 <= {b})::BIGINT AS n FROM {REQUESTS} q GROUP BY ALL" for b in P.NODE_BUCKETS]
    + [f"SELECT route, status, '+Inf' AS le, count(*)::BIGINT AS n FROM {REQUESTS} q GROUP BY ALL"])


def status_counts(spark, d):
    return traffic.counters(requests(spark, d), "tenant_id", "route", "status")


def step_times(spark, d):
    """Three steps per request, with the shares of its latency that they took."""
    parts = [("input_guard", 0.05), ("retrieve", 0.75), ("generate", 0.2)]
    trace = F.array(*[F.struct(F.lit(n).alias("node"), (F.col("latency_ms") * s).alias("ms")) for n, s in parts])
    return traffic.step_times(requests(spark, d).select(trace.alias("trace")))


STEPS = " UNION ALL ".join(
    f"SELECT '{n}' AS node, '{b}' AS le, count_if(latency_ms * {s}::DOUBLE / 1000 <= {b})::BIGINT AS n FROM {REQUESTS} q"
    for n, s in (("input_guard", 0.05), ("retrieve", 0.75), ("generate", 0.2)) for b in P.NODE_BUCKETS) + " UNION ALL " + " UNION ALL ".join(
    f"SELECT '{n}' AS node, '+Inf' AS le, count(*)::BIGINT AS n FROM {REQUESTS} q" for n in ("input_guard", "retrieve", "generate"))


def key_to_tenant(spark, d):
    """Tenant and fingerprint of every event's API key; keys of every 50th user are not registered."""
    log = _events(spark, d).select("event_id", "ts", F.concat(F.lit("key-"), F.col("user_id").cast("string")).alias("api_key"))
    users = _events(spark, d).select("user_id").distinct().filter("user_id % 50 <> 7")
    keys = users.select(F.sha2(F.concat(F.lit("key-"), F.col("user_id").cast("string")), 256).alias("key_hash"), F.concat(F.lit("t"), (F.col("user_id") % 5).cast("string")).alias("tenant_id"))
    known, unknown = traffic.with_tenant(log, keys)
    return known.unionByName(unknown).select("event_id", "key_id", F.coalesce("tenant_id", F.lit("rejected")).alias("tenant_id"))


KEYS = """SELECT event_id, left(sha256('key-' || user_id), 12) AS key_id, CASE WHEN user_id % 50 <> 7 THEN 't' || (user_id % 5) ELSE 'rejected' END AS tenant_id FROM events"""

QUERIES = {
    "rate_limit": (rate_limit, RATE),
    "rate_limit_stream": (rate_limit_stream, RATE),
    "request_counts_stream": (request_counts_stream, COUNTS),
    "answer_cache_ttl": (answer_cache, CACHE),
    "answer_cache_chained": (answer_cache_chained, CACHE),
    "answer_cache_stream": (answer_cache_stream, CACHE),
    "error_rate_sliding": (error_rate, ERRORS),
    "error_rate_stream": (error_rate_stream, ERRORS),
    "model_error_share": (model_errors, MODEL),
    "spike_alert": (spike, SPIKE),
    "spike_stream": (spike_stream, SPIKE),
    "latency_p95_alert": (latency_p95, P95),
    "latency_quantiles": (latency_quantiles, QUANTILES),
    "latency_histogram": (latency_histogram, HISTOGRAM),
    "step_times": (step_times, STEPS),
    "key_to_tenant": (key_to_tenant, KEYS),
}
QUERIES["status_counts"] = (status_counts, f"SELECT tenant_id, route, status, count(*)::BIGINT AS n FROM {REQUESTS} q GROUP BY ALL")
