"""Text functions as Column expressions.

All of them expect text that went through :func:`normalize` once (ingest and question preparation do
that), so nothing here crosses into Python except NFKC itself, and that only for rows that may need it.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewell import params as P

# White space as Python's str methods and `\s` see it (Java needs (?U), and lacks U+001C..U+001F).
WS = r"[\s\x1c-\x1f]"

# Characters that NFKC leaves alone and that never combine with a neighbour. Text made only of these is
# NFKC-stable, so it never has to visit a Python worker. Checked against unicodedata in the tests.
NFKC_STABLE = (
    r"\x00-\x9f¡-§©«-®°±¶·»¿-ıĴ-ľ"
    r"Ł-ňŊ-žΑ-ΡΣ-ώЀ-҂Ҋ-ԯ‐‒-‖"
    r"‘-‣€、-〩ぁ-ゖァ-ヺ一-鿿가-힣"
)
# a cheap test that settles most non-ASCII text before the full class is tried
LATIN_ONLY = r"^[\x00-\x7f\xc0-\xff]*+$"


@F.pandas_udf(T.StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s))


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable, so that ``body`` may use it many times and Spark computes it once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def zero_width_removed(c: Column) -> Column:
    return F.translate(c, P.ZERO_WIDTH, "")


def normalize(c: Column) -> Column:
    """NFKC, then zero-width characters removed."""
    ascii_only = F.octet_length(c) == F.length(c)
    stable = ascii_only | c.rlike(LATIN_ONLY) | c.rlike(f"^[{NFKC_STABLE}]*+$")
    return F.coalesce(zero_width_removed(_nfkc(F.when(~stable, c))), c)


def computed(df: DataFrame, **values: Column) -> DataFrame:
    """``withColumns`` whose values are computed exactly once.

    The one-row generator is a barrier for Catalyst, which else inlines a value into everything above it: into each
    filter that is pushed down, and into whole projections when a Python function is on both sides."""
    rest = [c for c in df.columns if c not in values]
    row = F.struct(*[value.alias(name) for name, value in values.items()])
    return df.select(*rest, F.inline(F.array(row)))


def with_normalized(df: DataFrame, column: str, out: str | None = None) -> DataFrame:
    return computed(df, **{out or column: normalize(F.col(column))})


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"(?U)^{WS}+|{WS}+$", "")


def collapse_spaces(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"(?U){WS}+", " "))


def norm_entity(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(c)), f"(?U){WS}+", " ")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(P.TOKEN_PATTERN), F.lit(0))


def stem(t: Column) -> Column:
    """The first suffix of the list that fits a long enough token is cut; ``ies`` becomes ``y``."""
    out = None
    for suffix in P.STEM_SUFFIXES:
        fits = (F.length(t) > len(suffix) + 3) & t.endswith(suffix)
        cut = F.substring(t, F.lit(1), F.length(t) - len(suffix))
        if suffix == "ies":
            cut = F.concat(cut, F.lit("y"))
        out = F.when(fits, cut) if out is None else out.when(fits, cut)
    return out.otherwise(t)


@lru_cache(maxsize=8)
def _stopword_literals(application: str) -> list[Column]:
    return [F.lit(w) for w in P.STOPWORDS]


def is_stopword(t: Column) -> Column:
    """The literals are made once per application: building them anew for every use dominates planning."""
    return t.isin(*_stopword_literals(SparkSession.active().sparkContext.applicationId))


def is_content_token(t: Column) -> Column:
    return (F.length(t) > 1) & ~is_stopword(t)


def terms_of_tokens(toks: Column) -> Column:
    return F.transform(F.filter(toks, is_content_token), stem)


def content_terms(c: Column) -> Column:
    return terms_of_tokens(tokens(c))


def term_counts(terms: Column) -> Column:
    """array<struct<term, tf>> of one row's terms: sort, then measure the runs. No shuffle is needed,
    because all terms of a chunk are in its row."""

    def runs(s: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(s)),
            lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))),
        )
        return let(
            starts,
            lambda b: F.transform(
                b,
                lambda start, k: F.struct(
                    F.element_at(s, start).alias("term"),
                    (F.coalesce(F.get(b, k + 1), F.size(s) + 1) - start).cast("int").alias("tf"),
                ),
            ),
        )

    empty = F.array().cast("array<struct<term:string,tf:int>>")
    return let(F.sort_array(terms), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(empty))


def sentences(c: Column) -> Column:
    parts = F.split(collapse_spaces(c), P.SENTENCE_BOUNDARY)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def overlap_terms(query_terms: Column, text_terms: Column) -> Column:
    """Share of the distinct query terms that occur in the text; 0 without query terms."""
    q = F.size(F.array_distinct(query_terms))
    hit = F.size(F.array_intersect(query_terms, text_terms))
    return F.when(q > 0, hit / q).otherwise(F.lit(0.0))


def overlap(query: Column, text: Column) -> Column:
    return overlap_terms(content_terms(query), content_terms(text))
