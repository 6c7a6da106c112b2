"""Index tables of a chunk collection: postings, document frequency, corpus size, vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewell import params as P
from citewell.functions import identity, text


def with_terms(chunks: DataFrame, source: Column | str = "text") -> DataFrame:
    """Adds ``terms`` (index terms in order, repeats kept), ``content`` (content terms only) and ``dl``, the chunk
    length in terms. Built in steps, so that tokens are computed once for both."""
    source = F.col(source) if isinstance(source, str) else source
    df = chunks.withColumn("_tokens", text.tokens(source)).withColumn("content", text.terms_of_tokens(F.col("_tokens")))
    terms = F.when(F.size("content") > 0, F.col("content")).otherwise(F.col("_tokens"))
    return df.withColumn("terms", terms).withColumn("dl", F.greatest(F.size("terms"), F.lit(1))).drop("_tokens")


def with_headed_terms(chunks: DataFrame, head: Column) -> DataFrame:
    """`with_terms` of the head, a line break and ``text``, all normalized, and ``body_terms``, the content terms of ``text`` as it is. No token
    crosses the break, so a text that is normalized already is cut into tokens once."""
    df = text.computed(chunks, _head=text.normalize(head), _plain=text.normalize(F.col("text")))
    df = df.withColumn("_own", text.tokens(F.col("text"))).withColumn("_same", F.col("_plain") == F.col("text"))
    df = df.withColumn("body_terms", text.terms_of_tokens(F.col("_own"))).withColumn("_other", F.when(~F.col("_same"), text.tokens(F.col("_plain"))))
    df = df.withColumn("_first", text.tokens(F.col("_head"))).drop("_plain", "_head")
    content = F.concat(text.terms_of_tokens(F.col("_first")), F.when(F.col("_same"), F.col("body_terms")).otherwise(text.terms_of_tokens(F.col("_other"))))
    df = df.withColumn("content", content)
    terms = F.when(F.size("content") > 0, F.col("content")).otherwise(F.concat("_first", F.when(F.col("_same"), F.col("_own")).otherwise(F.col("_other"))))
    return df.withColumn("terms", terms).withColumn("dl", F.greatest(F.size("terms"), F.lit(1))).drop("_own", "_other", "_same", "_first")


def bm25_weight(tf: Column, dl: Column, s: P.Settings = P.DEFAULTS) -> Column:
    return tf * (s.bm25_k1 + 1) / (tf + s.bm25_k1 * (1 - s.bm25_b + s.bm25_b * dl / s.bm25_avgdl))


def postings(chunks: DataFrame, s: P.Settings = P.DEFAULTS) -> DataFrame:
    """One row per distinct term of a chunk. Row-local: the counts come from the chunk's own sorted terms."""
    keys = ["tenant_id", "chunk_id"] + [c for c in ("doc_id",) if c in chunks.columns]
    return (
        chunks.select(*keys, "dl", F.inline(text.term_counts(F.col("terms"))))
        .withColumn("weight", F.round(bm25_weight(F.col("tf"), F.col("dl"), s), 6))
    )


def by_chunk(chunks: DataFrame, s: P.Settings = P.DEFAULTS) -> DataFrame:
    """The postings of a chunk as one row: keys, dl, its distinct terms, how often it has each (tfs) and their weights. Chunks without a term are
    left out. A weight is computed once for all terms that the chunk has equally often."""
    keys = ["tenant_id", "chunk_id"] + [c for c in ("doc_id",) if c in chunks.columns]
    rows = text.computed(chunks.select(*keys, "dl", "terms"), counts=text.term_counts(F.col("terms"))).filter(F.size("counts") > 0)
    rows = rows.select(*keys, "dl", F.col("counts.term").alias("terms"), F.col("counts.tf").alias("tfs"))
    rows = rows.withColumn("_tf", F.array_distinct("tfs"))
    weight = F.transform("_tf", lambda tf: F.round(bm25_weight(tf, F.col("dl"), s), 6))
    rows = text.computed(rows, _weight=weight)
    return rows.select(*keys, "dl", "terms", "tfs", F.transform("tfs", lambda tf: F.get("_weight", F.array_position("_tf", tf).cast("int") - 1)).alias("weights"))


def packed(chunks: DataFrame, s: P.Settings = P.DEFAULTS) -> DataFrame:
    """`by_chunk` as searches read it: tenant_id, chunk_id, terms, weights."""
    return by_chunk(chunks, s).select("tenant_id", "chunk_id", "terms", "weights")


def unpacked(rows: DataFrame) -> DataFrame:
    """`postings` of `by_chunk` rows."""
    lists = F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"), F.col("weights").alias("weight"))
    return rows.select(*[c for c in rows.columns if c not in ("terms", "tfs", "weights")], F.inline(lists))


def of_packed(rows: DataFrame) -> DataFrame:
    """tenant_id, term of every posting of `packed` rows."""
    return rows.select("tenant_id", F.explode("terms").alias("term"))


def document_frequency(post: DataFrame) -> DataFrame:
    """Chunks per (tenant, term). Postings are unique per chunk, so a plain count is the distinct count."""
    return post.groupBy("tenant_id", "term").agg(F.count(F.lit(1)).alias("df"))


def corpus_size(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n"))


def inverse_frequency(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def vectors(chunks: DataFrame, dim: int = P.DEFAULTS.embedding_dim, mode: str = "md5") -> DataFrame:
    return chunks.select("tenant_id", "chunk_id", identity.hash_embedding(F.col("content"), dim, mode).alias("embedding"))
