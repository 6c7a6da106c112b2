"""Shared pieces of the query families: table access, tenancy, and the DuckDB spelling of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewell import params as P
from citewell.functions import text
from citewell.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str, tenant: str = "source") -> DataFrame:
    """The documents table as chunks, one chunk per document. tenant: a column, or 'all' for a single tenant."""
    docs = text.with_normalized(table(spark, sf_dir, "documents"), "text")
    owner = F.lit("all") if tenant == "all" else F.col(tenant)
    return docs.select(owner.alias("tenant_id"), F.col("doc_id").cast("string").alias("chunk_id"),
                       F.col("doc_id").cast("string").alias("doc_id"), "text", "lang")


def owners(spark: SparkSession, sf_dir: str, tenant: str = "source") -> DataFrame:
    """tenant_id of every document, without its text."""
    docs = table(spark, sf_dir, "documents")
    return docs.select((F.lit("all") if tenant == "all" else F.col(tenant)).alias("tenant_id"))


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of the conversations table; the tenant is one of the document sources."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    turns = turns.select(
        F.concat(F.lit("src"), (F.col("conv_id") % 20).cast("string")).alias("tenant_id"),
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"),
        F.col("text").alias("question"))
    return text.with_normalized(turns, "question")


USER_TURNS = """(SELECT 'src' || (conv_id % 20) AS tenant_id, conv_id || '-' || turn AS qid, text AS question
FROM conversations WHERE role = 'user')"""


# ---- DuckDB spellings --------------------------------------------------------------------------


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOP_LIST = "(" + ", ".join(quoted(w) for w in P.STOPWORDS) + ")"


def sql_tokens(c: str) -> str:
    return f"regexp_extract_all(lower({c}), {quoted(P.TOKEN_PATTERN)})"


def sql_stem(t: str) -> str:
    cases = []
    for suffix in P.STEM_SUFFIXES:
        cut = f"left({t}, length({t}) - {len(suffix)})" + (" || 'y'" if suffix == "ies" else "")
        cases.append(f"WHEN length({t}) > {len(suffix) + 3} AND ends_with({t}, '{suffix}') THEN {cut}")
    return "CASE " + " ".join(cases) + f" ELSE {t} END"


def sql_terms_of(tokens: str) -> str:
    kept = f"list_filter({tokens}, lambda w: length(w) > 1 AND w NOT IN {STOP_LIST})"
    return f"list_transform({kept}, lambda w: {sql_stem('w')})"


def sql_terms(c: str) -> str:
    return sql_terms_of(sql_tokens(c))


def sql_index_terms(c: str) -> str:
    return f"(CASE WHEN len({sql_terms(c)}) > 0 THEN {sql_terms(c)} ELSE {sql_tokens(c)} END)"


def sql_overlap(q: str, t: str) -> str:
    """Both sides are term lists."""
    distinct = f"list_distinct({q})"
    return (f"(CASE WHEN len({distinct}) > 0 THEN len(list_filter({distinct}, lambda w: list_contains({t}, w)))::DOUBLE "
            f"/ len({distinct}) ELSE 0.0 END)")


def sql_sentences(c: str) -> str:
    collapsed = f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    marked = f"regexp_replace({collapsed}, '([.!?])\\s+([A-Z0-9\"''(\\[])', '\\1' || chr(30) || '\\2', 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(30)), lambda s: trim(s)), lambda s: s <> '')"


def sql_ascii(c: str) -> str:
    """Letters outside ASCII become a digit, so that RE2's ASCII word boundary agrees with the Unicode one."""
    return f"regexp_replace({c}, '[^\\x00-\\x7F]', '0', 'g')"
