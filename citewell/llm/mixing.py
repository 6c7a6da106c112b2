"""Mixing sources to target weights.

Efraimidis-Spirakis sampling without replacement: every document draws u in (0, 1] from a hash of its id and gets the
exponential key -ln(u) / quality. Ascending keys within a source are a sample weighted by quality. A source with target t
and size s runs through floor(t / s) complete epochs; the fraction that is left takes documents in key order until the
prefix sum of sizes meets the budget. The document on the border gives only its first words.

Nothing is sorted globally. Keys are cut into about sqrt(rows of the source) monotone buckets; only bucket totals are
prefix-summed, and only the one bucket of each source in which the budget ends is sorted. All steps are DataFrame built-ins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import internal, running_total, word_count, written

CYCLE = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"


def quality(text: str | Column) -> Column:
    """Weight of a document in (0, 1]: prose has few signs that are neither letters nor white space and few capitals."""
    text = F.col(text) if isinstance(text, str) else text
    n = F.greatest(F.length(text), F.lit(1))
    odd = F.regexp_count(text, F.lit(r"[!-@\[-`{-~]")) / n
    capital = F.regexp_count(text, F.lit(r"[A-Z]")) / n
    return F.coalesce(F.greatest(F.lit(0.05), F.lit(1.0) - 3.0 * odd - capital), F.lit(0.05))


def targets(sizes: DataFrame, share: float = SHARE, max_epochs: float = MAX_EPOCHS, cycle: tuple = CYCLE) -> DataFrame:
    """(source, source_size, ...) with its target. Sources by code point, null last, weigh ``cycle`` in turn and share
    ``share`` of all sizes by weight; a target stops at ``max_epochs`` times the size of its source, and what is over goes
    to the others by weight until none is above. That is one water level: with sources ordered by size over weight, the
    ones below the level are capped. One row per source, so the unpartitioned windows hold a summary."""
    one = W.partitionBy(F.lit(1))
    place = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), (place % len(cycle) + 1).cast("int"))
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = one.orderBy("ratio", F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("total", F.lit(float(share)) * F.sum("source_size").over(one))
    rows = rows.withColumn("open_weight", F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.col("open_weight"))
    # The first source whose ratio is not below its level fixes the level for itself and all after it.
    rows = rows.withColumn("fixed", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(one)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("fixed"), F.col("cap")))
    return rows.select("source", "source_size", F.greatest(target, F.lit(0.0)).alias("target"))


def draw(row_id: Column, seed: str = SEED) -> Column:
    """u in (0, 1] from 48 bits of an md5, the same in every run."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(row_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 1.0) / float(1 << 48)


def mix(docs: DataFrame, weight: Column | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: str = SEED, row_id: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, weight for every row of ``docs``, and its ``row_id`` (a distinct long), if one is named:
    rows without doc_id then draw by it, and ties of all else go by it.

    taken counts the words that the mix takes, repeats included: epochs x size plus the part of the fraction.
    ``weight`` is over the columns ``doc_id``, ``text``, ``source`` (default: `quality`). Null text has size 0 and takes 0; a
    null source is a source of its own; null or non-positive weights sort last; ties of key go by doc_id, then size, and rows
    equal in all of these may share the border in any order. An empty table gives an empty result. Other columns are ignored."""
    own = {"row": row_id} if row_id else {}
    base = internal(docs, doc_id=doc_id, text=text, source=source, **own)
    chosen = weight if weight is not None else quality("text")
    rows = base.select("doc_id", "source", word_count(F.col("text")).alias("size"), chosen.cast("double").alias("weight"), *own)
    drawn = F.col("doc_id").cast("string")
    drawn = F.coalesce(drawn, F.concat(F.lit("row-"), F.col("row").cast("string"))) if own else drawn
    rows = rows.withColumn("key", F.when(F.col("weight") > 0, -F.ln(draw(drawn, seed)) / F.col("weight"))
                           .otherwise(F.lit(float("inf"))))
    rows = written(rows, "mix-keys")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"),
                                            F.avg(F.when(F.col("weight") > 0, F.col("weight"))).alias("mean"))
    per_source = written(per_source, "mix-sources")
    goal = targets(per_source.select("source", "source_size"), share, max_epochs)
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
                           .otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("budget", F.round(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))
    plan = goal.join(per_source.select(F.col("source").alias("s"), "n_rows", "mean"), F.col("source").eqNullSafe(F.col("s")))
    plan = plan.drop("s").withColumn("buckets", F.ceil(F.sqrt("n_rows")))
    plan = written(plan.withColumnRenamed("source", "s"), "mix-plan")
    place = F.floor(F.col("buckets") * (1.0 - F.exp(-F.col("key") * F.coalesce("mean", F.lit(1.0)))))
    keyed = rows.join(F.broadcast(plan) if plan.count() <= 100_000 else plan, F.col("source").eqNullSafe(F.col("s")))
    keyed = keyed.drop("s").withColumn("bucket", F.least(place, F.col("buckets") - 1).cast("long"))
    sums = keyed.groupBy("source", "bucket", "budget").agg(F.sum("size").alias("words"))
    border = running_total(sums, ["source"], ["bucket"], "words", "before")
    border = border.filter((F.col("before") < F.col("budget")) & (F.col("before") + F.col("words") >= F.col("budget")))
    border = written(border.select(F.col("source").alias("s"), F.col("bucket").alias("last"), "before"), "mix-border")
    small = border.count() <= 100_000  # one row per source at most
    placed = keyed.join(F.broadcast(border) if small else border, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    inside = placed.filter("bucket = last")
    order = W.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", *own)
    prefix = F.coalesce(F.sum("size").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("before")
    inside = inside.withColumn("part", F.least(F.col("size"), F.greatest(F.lit(0), F.col("budget") - prefix)))
    outside = placed.filter("last is null or bucket <> last").withColumn(
        "part", F.when(F.col("bucket") < F.col("last"), F.col("size")).otherwise(F.lit(0)))
    taken = F.col("epochs") * F.col("size") + F.col("part")
    columns = ["doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source", "weight", *own]
    return inside.select(*columns).unionByName(outside.select(*columns))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, whatever their names, repeated for each epoch. A row on the border appears
    once more with the words that it still gives; rows of size 0 stay once, since they cost nothing. Every row goes by itself, also where
    doc_ids are null or repeated. An empty table gives no rows."""
    named = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()]).withColumn("mix_row", F.monotonically_increasing_id())
    rows = written(rows, "mix-rows")  # the row ids stay what they are
    plan = mix(rows, doc_id=named[doc_id], text=named[text], source=named[source], row_id="mix_row", **options)
    joined = rows.join(plan.select(F.col("row").alias("mix_row"), "size", "taken"), "mix_row")
    size, taken = F.col("size"), F.col("taken")
    full = F.when(size > 0, F.floor(taken / size)).otherwise(F.lit(1)).cast("int")
    rest = F.when(size > 0, taken % size).otherwise(F.lit(0)).cast("int")
    copies = F.when(full > 0, F.array_repeat(F.lit(0), full)).otherwise(F.array().cast("array<int>"))
    copies = F.when(rest > 0, F.concat(copies, F.array(rest))).otherwise(copies)
    out = joined.withColumn("words", F.explode(copies))
    cut = F.when(F.col("words") > 0, _first_words(F.col(named[text]), F.col("words"))).otherwise(F.col(named[text]))
    return out.select(*[(cut if c == text else F.col(n)).alias(c) for c, n in named.items()])


def _first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.greatest(n, F.lit(1))), "")
