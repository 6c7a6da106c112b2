"""Training-corpus pipeline: quality, line dedup, near-dedup, mixture, packing, each over all that the stage before kept.

In every stage an empty table gives no rows, rows go by themselves (also where doc_ids are null or repeated), and further columns pass
through unchanged, whatever their names, up to packing, which ignores them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewell.llm import linededup, mixing, neardup, packing, quality
from citewell.llm.common import table, written


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def any_columns(stage: Stage) -> Stage:
    """The stage for documents whose further columns are named like the operators' own, which begin with two underscores: these travel as one
    struct under a free name."""
    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = [c for c in docs.columns if c.startswith("__")]
        if not own:
            return stage(spark, docs, sf_dir)
        name = "further"
        while name in docs.columns:
            name += "_"
        kept = [F.col(f"`{c}`") for c in docs.columns if c not in own]
        out = stage(spark, docs.select(*kept, F.struct(*[F.col(f"`{c}`") for c in own]).alias(name)), sf_dir)
        return out.select(*[F.col(f"{name}.`{c}`") if c in own else F.col(f"`{c}`") for c in docs.columns]) if name in out.columns else out

    return run


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars, where the table has it, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


@any_columns
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier does not reject. Null and empty texts are scored like any other; equal texts score alike."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.withColumn("__quality", quality.scored(docs, model))
    return scored.filter(F.col("__quality") >= quality.THRESHOLD).drop("__quality")


@any_columns
def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs of lines; a document that is nothing but such runs goes. Null texts stay null and empty ones empty; rows
    equal in doc_id and text are one document and stay alike (near-dedup leaves one of them)."""
    out = linededup.dedup_lines(docs).filter("not (coalesce(__removed, 0) > 0 and text = '')")
    return _measured(out.drop("__removed", "__words_removed", "__removed_lines"))


@any_columns
def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the one with the smallest doc_id, null ids last, then by a hash of the text. Rows that share
    a doc_id, or have none, are rows of their own."""
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()), "near-dedup-rows")
    groups = neardup.near_duplicates(rows, doc_id="__row").select(F.col("doc_id").alias("__row"), "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"), F.col("__row").alias("row"))
    groups = written(rows.select("__row", place.alias("place")).join(groups, "__row"), "near-dedup-groups")
    first = groups.groupBy("component_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    gone = groups.join(first, "component_id").filter(F.col("__row") != F.col("first.row")).select("__row")
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)


@any_columns
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents repeated by epoch, the one on a source's border cut to its budget. Null texts have no words and stay once;
    a null source is a source of its own; rows without doc_id draw by row; ties go by doc_id, size and row."""
    return _measured(mixing.mixed_documents(docs))


@any_columns
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, each sequence with the mixture of the corpus. Null and empty texts are one end token; null and repeated
    doc_ids are packed row by row."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("near-dedup", without_near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

# Training, set similarity over token sequences and tokenizers are not SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, "stage-" + name.replace(" ", "-"))
    return docs
