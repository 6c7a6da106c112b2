"""Request-log analytics: key lookup, rate limits, answer-cache hits, sliding alerts, histograms, quantiles.

requests: ts, tenant_id, key_id, cache_key, route, status, latency_ms, cacheable, and an id that orders equal times."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewell import params as P
from citewell import session

# FIXED VALUES: default latency buckets of the HTTP histogram, in seconds
HTTP_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0)


def minute_of(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts) / 60_000_000).cast("long")


# ---- tenants -----------------------------------------------------------------------------------


def with_tenant(log: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """log: api_key, ...; keys: key_hash, tenant_id. Stamps tenant and key fingerprint; unknown keys go to rejects."""
    hashed = log.withColumn("key_hash", F.sha2("api_key", 256))
    known = hashed.join(keys, "key_hash", "left")
    known = known.withColumn("key_id", F.left("key_hash", F.lit(12))).drop("api_key", "key_hash")
    return known.filter("tenant_id is not null"), known.filter("tenant_id is null")


# ---- rate limit --------------------------------------------------------------------------------


def rate_limit(requests: DataFrame, order_id: str, limit: int = P.DEFAULTS.rate_limit_per_minute) -> DataFrame:
    """Adds ``minute`` and ``allowed``: the first ``limit`` requests of a key in a clock minute pass; refused ones count too.

    Only the admitted rows of a minute are ranked (the rank filter is applied before the shuffle), and only full
    minutes give a cutoff, so a hot key is never sorted as a whole."""
    key = ["tenant_id", "key_id", "minute"]
    rows = requests.withColumn("minute", minute_of(F.col("ts")))
    w = Window.partitionBy(*key).orderBy("ts", order_id)
    first = rows.select(*key, "ts", order_id).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit)
    cutoff = first.filter(F.col("n") == limit).select(*key, F.struct("ts", order_id).alias("cutoff"))
    joined = rows.join(cutoff, key, "left")
    late = F.struct("ts", order_id) > F.col("cutoff")
    return joined.withColumn("allowed", ~F.coalesce(late, F.lit(False))).drop("cutoff")


# ---- answer cache ------------------------------------------------------------------------------


def cache_outcomes(requests: DataFrame, order_id: str, ttl_s: int = P.DEFAULTS.cache_ttl_s,
                   max_fold: int = 100_000) -> DataFrame:
    """Adds ``hit``. A request hits if the last stored answer of its key is at most ``ttl_s`` old; a miss stores its
    answer if cacheable; hits do not extend.

    Stores of a key are more than ``ttl_s`` apart, so a hit only depends on the latest store before it. The
    stores come from :func:`stored_answers`; finding the latest one is an equi join on (key, time slot)."""
    rows = requests.withColumn("t", F.unix_micros("ts"))
    ttl = ttl_s * 1_000_000
    slot = F.floor(F.col("t") / ttl).cast("long")
    rows = session.written(rows.withColumn("slot", slot), "cache_requests")
    stores = stored_answers(rows, order_id, ttl, max_fold)
    # a store serves its own slot and the next one; each slot has at most one store
    served = stores.select("cache_key", F.col("t").alias("s_t"), F.col(order_id).alias("s_id"),
                           F.explode(F.array(F.col("slot"), F.col("slot") + 1)).alias("slot"))
    served = served.groupBy("cache_key", "slot").agg(F.array_sort(F.collect_list(F.struct("s_t", "s_id"))).alias("stores"))
    joined = rows.join(served, ["cache_key", "slot"], "left")
    fresh = F.exists("stores", lambda s: (F.struct(s["s_t"], s["s_id"]) < F.struct(F.col("t"), F.col(order_id)))
                     & (F.col("t") - s["s_t"] <= ttl))
    return joined.withColumn("hit", F.coalesce(fresh, F.lit(False))).drop("stores", "slot", "t")


def stored_answers(rows: DataFrame, order_id: str, ttl: int, max_fold: int = 100_000) -> DataFrame:
    """The requests whose answers are stored: the first cacheable one of a key, then each time the first cacheable one
    more than ``ttl`` after the last store.

    Keys of moderate size are folded inside one row. Keys above ``max_fold`` go through :func:`_chained_stores`,
    which never brings a key together."""
    ok = rows.filter("cacheable").groupBy("cache_key", "slot", "t").agg(F.min(order_id).alias(order_id))
    ok = session.written(ok, "cacheable")
    heavy = session.written(ok.groupBy("cache_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max_fold).select("cache_key"), "heavy")
    some_heavy = not heavy.isEmpty()
    light = ok.join(heavy, "cache_key", "left_anti") if some_heavy else ok
    start = F.struct(F.lit(None).cast("long").alias("last"), F.array().cast(f"array<struct<t:bigint,{order_id}:bigint>>").alias("stores"))

    def step(acc: Column, x: Column) -> Column:
        stores = acc["last"].isNull() | (x["t"] > acc["last"] + ttl)
        return F.struct(F.when(stores, x["t"]).otherwise(acc["last"]).alias("last"),
                        F.when(stores, F.concat(acc["stores"], F.array(x))).otherwise(acc["stores"]).alias("stores"))

    ordered = F.array_sort(F.collect_list(F.struct("t", F.col(order_id).cast("long").alias(order_id))))
    folded = light.groupBy("cache_key").agg(F.aggregate(ordered, start, step, lambda acc: acc["stores"]).alias("stores"))
    out = folded.select("cache_key", F.inline("stores")).withColumn("slot", F.floor(F.col("t") / ttl).cast("long"))
    out = out.select("cache_key", "slot", "t", order_id)
    if some_heavy:
        out = out.unionByName(_chained_stores(ok.join(heavy, "cache_key", "left_semi"), order_id, ttl))
    return out


def _chained_stores(ok: DataFrame, order_id: str, ttl: int) -> DataFrame:
    """Stores as the chain from a key's first request along "next request more than ttl later".

    Each request finds its successor within the next time slot of ttl length, or as the first request of a later
    slot. Reachability from the first request doubles its step every round: log2(slots) rounds of equi joins."""
    node = ["cache_key", "t"]
    times = ok.select("cache_key", "slot", "t", F.col("t").alias("ok_t"), F.lit(1).alias("kind"))
    asks = ok.select("cache_key", (F.col("slot") + 1).alias("slot"), (F.col("t") + ttl).alias("t"),
                     F.lit(None).cast("long").alias("ok_t"), F.lit(0).alias("kind"))
    later = Window.partitionBy("cache_key", "slot").orderBy(F.desc("t"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    near = times.unionByName(asks).withColumn("near", F.min("ok_t").over(later)).filter("kind = 0")
    near = near.select("cache_key", (F.col("t") - ttl).alias("t"), "near")
    by_slot = Window.partitionBy("cache_key").orderBy("slot")  # one row per slot: bounded by the time range
    firsts = ok.groupBy("cache_key", "slot").agg(F.min("t").alias("first_t"))
    firsts = firsts.select("cache_key", "slot", F.lead("slot").over(by_slot).alias("s1"), F.lead("first_t").over(by_slot).alias("f1"),
                           F.lead("first_t", 2).over(by_slot).alias("f2"))
    far = F.when(F.col("s1") == F.col("slot") + 1, F.col("f2")).otherwise(F.col("f1"))
    links = ok.select("cache_key", "slot", "t").join(near, node).join(firsts, ["cache_key", "slot"])
    jump = session.written(links.select(*node, F.coalesce("near", far).alias("to")).filter("to is not null"), "jump")
    slots = ok.groupBy("cache_key").agg(F.countDistinct("slot").alias("n")).agg(F.max("n")).first()[0]
    reached = ok.groupBy("cache_key").agg(F.min("t").alias("t"))
    for _ in range(max(1, int(slots).bit_length())):
        ahead = reached.join(jump, node).select("cache_key", F.col("to").alias("t"))
        reached = session.written(reached.union(ahead).distinct(), "reached")
        second = jump.select("cache_key", F.col("t").alias("to"), F.col("to").alias("to2"))
        jump = session.written(jump.join(second, ["cache_key", "to"]).select(*node, F.col("to2").alias("to")), "jump")
    return ok.join(reached, node, "left_semi").select("cache_key", "slot", "t", F.col(order_id).cast("long").alias(order_id))


# ---- sliding windows and alerts ----------------------------------------------------------------


def per_minute(requests: DataFrame, **aggregates: Column) -> DataFrame:
    """Minute totals: everything below works on these, so the log itself is aggregated once, map-side first."""
    return requests.groupBy(minute_of(F.col("ts")).alias("minute")).agg(*[c.alias(n) for n, c in aggregates.items()])


def sliding(minutes: DataFrame, width: int, *totals: str) -> DataFrame:
    """Sums over the last ``width`` minutes, for every minute whose window holds a request. ``minute`` is the window's
    last minute."""
    spread = minutes.withColumn("minute", F.explode(F.sequence(F.col("minute"), F.col("minute") + (width - 1))))
    return spread.groupBy("minute").agg(*[F.sum(t).alias(t) for t in totals])


def sustained(evaluated: DataFrame, minutes: int, condition: str = "breach") -> DataFrame:
    """Adds ``firing``: the condition holds now and at every evaluation of the last ``minutes`` minutes, which takes one evaluation in
    each of them. Minutes are counted by key, never put in one order."""
    held = evaluated.filter(condition).select(F.explode(F.sequence(F.col("minute"), F.col("minute") + minutes)).alias("_minute"))
    held = held.groupBy("_minute").agg(F.count(F.lit(1)).alias("_held"))
    joined = evaluated.join(held, F.col("minute") == F.col("_minute"), "left")
    return joined.withColumn("firing", F.col(condition) & (F.coalesce("_held", F.lit(0)) == minutes + 1)).drop("_minute", "_held")


def error_rate_alert(requests: DataFrame, is_error: Column, width: int = 5, threshold: float = 0.02, hold: int = 10) -> DataFrame:
    minutes = per_minute(requests, errors=F.count_if(is_error), total=F.count(F.lit(1)))
    windows = sliding(minutes, width, "errors", "total").withColumn("rate", F.round(F.col("errors") / F.col("total"), 6))
    return sustained(windows.withColumn("breach", F.col("errors") / F.col("total") > threshold), hold)


def spike_alert(requests: DataFrame, is_event: Column, width: int = 15, threshold: int = 50) -> DataFrame:
    minutes = per_minute(requests, n=F.count_if(is_event))
    return sliding(minutes, width, "n").withColumn("firing", F.col("n") > threshold)


def bucket_counts(latency_s: Column, buckets: tuple[float, ...] = HTTP_BUCKETS) -> dict[str, Column]:
    """Cumulative counts: one column per upper bound, and the total."""
    return {f"le_{i}": F.count_if(latency_s <= b) for i, b in enumerate(buckets)} | {"total": F.count(F.lit(1))}


def histogram_quantile(q: float, buckets: tuple[float, ...] = HTTP_BUCKETS) -> Column:
    """Linear interpolation inside the bucket that holds the quantile; above the last bound, that bound."""
    rank = F.col("total") * F.lit(q)
    lower, below, out = 0.0, F.lit(0), None
    for i, upper in enumerate(buckets):
        here = F.col(f"le_{i}")
        value = F.lit(lower) + F.lit(upper - lower) * (rank - below) / (here - below)
        out = F.when(here >= rank, value) if out is None else out.when(here >= rank, value)
        lower, below = upper, here
    return out.otherwise(F.lit(buckets[-1]))


def latency_alert(requests: DataFrame, latency_s: Column, width: int = 5, threshold: float = 8.0, hold: int = 10,
                  q: float = 0.95, route: str | None = None) -> DataFrame:
    """Latency rule over all requests, or over those of one ``route``."""
    requests = requests.filter(F.col("route") == route) if route else requests
    counts = bucket_counts(latency_s)
    windows = sliding(per_minute(requests, **counts), width, *counts)
    windows = windows.withColumn("p95", histogram_quantile(q))
    return sustained(windows.withColumn("breach", F.col("p95") > threshold), hold).select("minute", "total", "p95", "breach", "firing")


# ---- counters, histograms, quantiles -----------------------------------------------------------


def counters(events: DataFrame, *labels: str) -> DataFrame:
    return events.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))


def histogram(events: DataFrame, value: Column, labels: list[str], buckets: tuple[float, ...]) -> DataFrame:
    """Cumulative histogram in long form: labels, le ('+Inf' last), n."""
    counts = [F.count_if(value <= b).alias(f"b{i}") for i, b in enumerate(buckets)]
    wide = events.groupBy(*labels).agg(*counts, F.count(F.lit(1)).alias("total"))
    cells = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)]
    cells.append(F.struct(F.lit("+Inf").alias("le"), F.col("total").alias("n")))
    return wide.select(*labels, F.inline(F.array(*cells)))


def order_statistics(df: DataFrame, keys: list[str], value: str, indexes: dict[str, Callable[[Column], Column]],
                     slices: int = 256) -> DataFrame:
    """Exact elements at given 0-based positions of each group's sorted values; nulls do not count.

    Values are counted, the group is cut into slices of about equal numbers of rows, and only the slices that hold a wanted position
    are ordered. No group is sorted as a whole, however large it is and however its values are spread."""
    df = df.filter(F.col(value).isNotNull())
    counted = session.written(df.groupBy(*keys, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("c")), "counted")
    ranges = session.written(df.groupBy(*keys).agg(
        F.percentile_approx(value, [i / slices for i in range(1, slices)], 20 * slices).alias("cuts"), F.count(F.lit(1)).alias("n")), "ranges")
    place = F.size(F.filter("cuts", lambda c: c < F.col("v")))
    placed = _with_groups(counted, ranges, keys).withColumn("slice", place)
    totals = placed.groupBy(*keys, "slice").agg(F.sum("c").alias("in_slice"))
    before = F.sum("in_slice").over(Window.partitionBy(*keys).orderBy("slice")) - F.col("in_slice")
    totals = totals.withColumn("before", before)
    wanted = F.array(*[F.struct(F.lit(name).alias("stat"), index(F.col("n")).cast("long").alias("at")) for name, index in indexes.items()])
    targets = _with_groups(totals, ranges.select(*keys, F.inline(wanted)), keys)
    targets = targets.filter((F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("in_slice")))
    inside = placed.join(targets, [*keys, "slice"])
    upto = F.sum("c").over(Window.partitionBy(*keys, "stat").orderBy("v"))
    found = inside.withColumn("upto", upto + F.col("before")).filter((F.col("at") < F.col("upto")) & (F.col("at") >= F.col("upto") - F.col("c")))
    return found.groupBy(*keys).pivot("stat", list(indexes)).agg(F.first("v"))


def _with_groups(rows: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(groups, keys)


def latency_quantiles(requests: DataFrame, keys: list[str], value: str = "latency_ms") -> DataFrame:
    """p50 (mean of the two middle elements) and p95 (the element at floor(0.95 (n-1)))."""
    if not keys:
        return latency_quantiles(requests.withColumn("_all", F.lit(0)), ["_all"], value).drop("_all")
    stats = order_statistics(requests, keys, value, {
        "low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.ceil((n - 1) / 2), "p95": lambda n: F.floor((n - 1) * 0.95)})
    return stats.select(*keys, ((F.col("low") + F.col("high")) / 2).alias("p50"), "p95")


def relevant_histogram(answers: DataFrame) -> DataFrame:
    """answers: n_relevant -> cumulative histogram of the relevant chunks that answers rest on."""
    return histogram(answers, F.col("n_relevant").cast("double"), [], P.RELEVANT_BUCKETS)


def step_times(answers: DataFrame) -> DataFrame:
    """answers: trace array<struct<node, ms>> -> cumulative time histogram per step, in seconds."""
    steps = answers.select(F.inline("trace"))
    return histogram(steps, F.col("ms") / 1000.0, ["node"], P.NODE_BUCKETS)
