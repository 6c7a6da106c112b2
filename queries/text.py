"""Text, question and identity functions over whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from citewell import params as P
from citewell.functions import answers, chunking, identity, questions, text
from queries.common import (STOP_LIST, USER_TURNS, corpus, quoted, sql_index_terms, sql_overlap, sql_sentences, sql_terms,
                            sql_tokens, table, user_turns)


def content_terms(spark, d):
    toks = text.tokens(F.col("text"))
    return corpus(spark, d).withColumn("tokens", toks).select(
        "doc_id", F.size("tokens").cast("long").alias("n_tokens"),
        F.array_join(text.terms_of_tokens(F.col("tokens")), " ").alias("terms"))


CONTENT_TERMS = f"""SELECT doc_id::VARCHAR AS doc_id, len({sql_tokens('text')})::BIGINT AS n_tokens,
array_to_string({sql_terms('text')}, ' ') AS terms FROM documents"""


def normalize_text(spark, d):
    return corpus(spark, d).select("doc_id", F.sha2("text", 256).alias("digest"), F.length("text").cast("long").alias("n"))


NORMALIZE = """SELECT doc_id::VARCHAR AS doc_id, sha256(translate(text, chr(8203)||chr(8204)||chr(8205)||chr(8288)||chr(65279), ''))
 AS digest, length(text)::BIGINT AS n FROM documents"""


def sentence_split(spark, d):
    s = text.sentences(F.col("text"))
    return corpus(spark, d).withColumn("s", s).select(
        "doc_id", F.size("s").cast("long").alias("n_sentences"), F.array_join("s", "\n").alias("sentences"))


SENTENCES = f"""WITH t AS (SELECT doc_id, {sql_sentences('text')} AS s FROM documents)
SELECT doc_id::VARCHAR AS doc_id, len(s)::BIGINT AS n_sentences, array_to_string(s, chr(10)) AS sentences FROM t"""


def overlap_score(spark, d):
    """Share of a user turn's terms that the assistant's next turn repeats."""
    t = table(spark, d, "conversations")
    t = t.withColumn("terms", text.content_terms(F.col("text")))
    ask = t.filter("role = 'user'").select("conv_id", "turn", F.col("terms").alias("q"))
    reply = t.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("terms").alias("a"))
    return ask.join(reply, ["conv_id", "turn"]).select("conv_id", "turn", F.round(text.overlap_terms(F.col("q"), F.col("a")), 6).alias("overlap"))


OVERLAP = f"""WITH t AS (SELECT *, {sql_terms('text')} AS terms FROM conversations)
SELECT u.conv_id, u.turn, round({sql_overlap('u.terms', 'a.terms')}, 6) AS overlap FROM t u JOIN t a
ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'"""


def term_sets(spark, d):
    """Shared, missing and united distinct terms of a user turn and the reply."""
    t = table(spark, d, "conversations").withColumn("terms", text.content_terms(F.col("text")))
    ask = t.filter("role = 'user'").select("conv_id", "turn", F.col("terms").alias("q"))
    reply = t.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("terms").alias("a"))
    n = lambda c: F.size(c).cast("long")
    return ask.join(reply, ["conv_id", "turn"]).select(
        "conv_id", "turn", n(F.array_intersect("q", "a")).alias("shared"), n(F.array_except("q", "a")).alias("missing"),
        n(F.array_union("q", "a")).alias("united"), F.array_join(F.array_distinct("q"), " ").alias("ordered"))


TERM_SETS = f"""WITH t AS (SELECT *, {sql_terms('text')} AS terms FROM conversations),
p AS (SELECT u.conv_id, u.turn, u.terms AS q, a.terms AS a FROM t u JOIN t a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant')
SELECT conv_id, turn, len(list_filter(list_distinct(q), lambda w: list_contains(a, w)))::BIGINT AS shared,
len(list_filter(list_distinct(q), lambda w: NOT list_contains(a, w)))::BIGINT AS missing,
len(list_distinct(list_concat(q, a)))::BIGINT AS united,
array_to_string(list_filter(q, lambda w, i: list_position(q, w) = i), ' ') AS ordered FROM p"""


def plan_subqueries(spark, d):
    """Two user turns of a conversation as one compound question, decomposed."""
    return _compound(spark, d).select(
        "qid", F.array_join(questions.sub_queries(F.col("question")), "\x1f").alias("sub_queries"),
        F.size(questions.sub_queries(F.col("question"))).cast("long").alias("n"))


def _compound(spark, d):
    t = table(spark, d, "conversations").filter("role = 'user'")
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = t.withColumn("next", F.lead("text").over(w))
    return t.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("qid"),
                    F.concat(F.col("text"), F.when(F.col("next").isNotNull(), F.concat(F.lit(" and what of? "), F.col("next"))).otherwise("")).alias("question"))


_COMPOUND_SQL = """(SELECT conv_id || '-' || turn AS qid, text || coalesce(' and what of? ' || lead(text) OVER (PARTITION BY conv_id ORDER BY turn), '')
AS question FROM conversations WHERE role = 'user')"""
_WS = "chr(32)||chr(10)||chr(9)||chr(13)"
PLAN = f"""WITH t AS (SELECT qid, trim(question, {_WS}) AS whole, list_transform(list_filter(regexp_split_to_array(question, '(?i){P.SPLIT_PATTERN}'),
 lambda p: len({sql_terms('p')}) >= 2), lambda p: trim(p, ' ?.,')) AS parts FROM {_COMPOUND_SQL}),
c AS (SELECT qid, whole, list_slice(CASE WHEN len(parts) > 0 THEN parts ELSE [whole] END, 1, 3) AS chosen FROM t),
f AS (SELECT qid, CASE WHEN len(chosen) > 1 AND NOT list_contains(chosen, whole) THEN list_slice(list_concat([whole], chosen), 1, 3) ELSE chosen END AS s FROM c)
SELECT qid, array_to_string(s, chr(31)) AS sub_queries, len(s)::BIGINT AS n FROM f"""


def question_entities(spark, d):
    return user_turns(spark, d).select("qid", F.array_join(questions.entities(F.col("question")), "|").alias("entities"))


# the boundary of RE2 is an ASCII one, so a capital letter after an accented one must be excluded by hand
ENTITIES = f"""WITH t AS (SELECT qid, regexp_extract_all(question, '(?:^|[^\\pL\\pN_])([A-Z][A-Za-z0-9]+(?:[- ][A-Z0-9][A-Za-z0-9]+)*)(?:[^\\pL\\pN_]|$)', 1) AS e FROM {USER_TURNS}),
k AS (SELECT qid, list_filter(e, lambda x: lower(x) NOT IN {STOP_LIST} AND length(x) > 2) AS e FROM t)
SELECT qid, array_to_string(list_filter(e, lambda x, i: list_position(e, x) = i), '|') AS entities FROM k"""


def rewrite_terms(spark, d):
    q = F.concat(F.col("question"), F.lit(" outage owner db"))
    return user_turns(spark, d).select("qid", questions.rewrite(q, F.array(F.lit("payments api"))).alias("rewritten"))


_SYN = "CASE x " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in P.SYNONYMS.items()) + " END"
REWRITE = f"""WITH t AS (SELECT qid, list_filter({sql_tokens("(question || ' outage owner db')")}, lambda x: x NOT IN {STOP_LIST}) AS w FROM {USER_TURNS}),
e AS (SELECT qid, list_concat(list_concat(w, list_filter(list_transform(w, lambda x: {_SYN}), lambda x: x IS NOT NULL)), ['payments api']) AS e FROM t)
SELECT qid, array_to_string(list_filter(e, lambda x, i: list_position(e, x) = i), ' ') AS rewritten FROM e"""


def smalltalk_route(spark, d):
    first = F.concat(F.element_at(F.array(*[F.lit(x) for x in _GREETINGS]), (F.col("conv_id") % len(_GREETINGS) + 1).cast("int")))
    t = table(spark, d, "conversations").withColumn("greeting", first)
    return t.select("conv_id", "turn", F.when(questions.is_smalltalk(F.col("greeting")), "direct").otherwise("retrieve").alias("greeting_route"),
                    F.when(questions.is_smalltalk(F.col("text")), "direct").otherwise("retrieve").alias("route"))


_GREETINGS = ["hello", "Thanks !", "good morning?", "hi there", "who are you", "Hey..."]
SMALLTALK = f"""SELECT conv_id, turn, CASE WHEN regexp_matches([{', '.join(quoted(g) for g in _GREETINGS)}][conv_id % {len(_GREETINGS)} + 1], '(?i){P.SMALLTALK_PATTERN}')
THEN 'direct' ELSE 'retrieve' END AS greeting_route, CASE WHEN regexp_matches(text, '(?i){P.SMALLTALK_PATTERN}') THEN 'direct' ELSE 'retrieve' END AS route FROM conversations"""


def identities(spark, d):
    """Chunk ids, point ids, snippets and contextual embedding texts of the documents."""
    c = corpus(spark, d)
    cid = identity.chunk_id(F.col("doc_id"), F.lit(0), F.col("text"))
    return c.withColumn("id", cid).select(
        "doc_id", F.col("id").alias("chunk_id"), identity.point_id(F.col("tenant_id"), F.col("id")).alias("point_id"),
        answers.snippet(F.col("text")).alias("snippet"),
        F.sha2(identity.embedding_text(F.concat(F.lit("Document "), F.col("doc_id")), F.col("lang"), F.col("text")), 256).alias("embedding_text"),
        F.col("doc_id").rlike(P.DOC_ID_PATTERN).alias("valid_id"))


IDENTITIES = f"""WITH c AS (SELECT doc_id::VARCHAR AS doc_id, source, lang, text, doc_id || '#0-' || left(sha256(text), 12) AS chunk_id FROM documents),
h AS (SELECT *, sha1(unhex('{P.POINT_NAMESPACE.replace("-", "")}') || encode(source || ':' || chunk_id)) AS h FROM c)
SELECT doc_id, chunk_id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' ||
substring('89ab89ab89ab89ab', (strpos('0123456789abcdef', substring(h, 17, 1)))::INT, 1) || substring(h, 18, 3) || '-' || substring(h, 21, 12) AS point_id,
CASE WHEN length(text) > 280 THEN left(text, 280) || '...' ELSE text END AS snippet,
sha256('Document ' || doc_id || ' | ' || lang || chr(10) || text) AS embedding_text,
regexp_matches(doc_id, {quoted(P.DOC_ID_PATTERN)}) AS valid_id FROM h"""


def cache_keys(spark, d):
    t = user_turns(spark, d)
    k = F.when(F.length("question") % 2 == 0, F.length("question") % 20 + 1)
    return t.select("qid", identity.cache_key(F.col("tenant_id"), F.col("question"), k).alias("cache_key"))


CACHE_KEYS = f"""SELECT qid, 'ans:' || sha256(tenant_id || chr(31) || trim(regexp_replace(lower(question), '\\s+', ' ', 'g')) || chr(31) ||
CASE WHEN length(question) % 2 = 0 THEN (length(question) % 20 + 1)::VARCHAR ELSE 'None' END) AS cache_key FROM {USER_TURNS}"""


def entity_norm(spark, d):
    n = table(spark, d, "part")
    return n.select("p_partkey", text.norm_entity(F.concat(F.lit("  "), F.col("p_name"), F.lit(" \t OF  "), F.col("p_brand"), F.lit(" "))).alias("norm"))


ENTITY_NORM = """SELECT p_partkey, regexp_replace(lower(trim('  ' || p_name || ' ' || chr(9) || ' OF  ' || p_brand || ' ')), '\\s+', ' ', 'g') AS norm FROM part"""


def page_markdown(html):
    """Headings of a page as markdown; every other tag is cut to a line end."""
    out = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    for level in range(1, 7):
        out = F.regexp_replace(out, rf"(?is)<h{level}[^>]*>(.*?)</h{level}>", "\n\n" + "#" * level + " $1\n\n")
    return F.regexp_replace(out, r"(?s)<[^>]*>", "\n\n")


def page_markdown_sql(html: str) -> str:
    out = f"regexp_replace({html}, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g')"
    for level in range(1, 7):
        out = f"regexp_replace({out}, '(?is)<h{level}[^>]*>(.*?)</h{level}>', chr(10)||chr(10)||'{'#' * level} \\1'||chr(10)||chr(10), 'g')"
    return f"regexp_replace({out}, '(?s)<[^>]*>', chr(10)||chr(10), 'g')"


def markdown_sections(spark, d):
    p = table(spark, d, "pages").select("page_id", page_markdown(F.col("html")).alias("md"))
    rows = p.select("page_id", F.posexplode(chunking.sections(F.col("md"))).alias("pos", "s"))
    return rows.select("page_id", F.col("pos").cast("long").alias("pos"), F.coalesce("s.section", F.lit("-")).alias("section"), F.sha2("s.body", 256).alias("body"))


_TRIMMED = f"lambda b: trim(b, {_WS})"
SECTIONS = f"""WITH p AS (SELECT page_id, {page_markdown_sql('html')} AS md FROM pages),
m AS (SELECT page_id, md, regexp_matches(md, '(?m){P.HEADING_PATTERN}') AS headed,
 string_split(regexp_replace(md, '(?m)^(#{{1,6}})[ \\t]+(.+?)[ \\t]*$', chr(30) || '\\2' || chr(31), 'g'), chr(30)) AS parts FROM p),
s AS (SELECT page_id, headed, i, parts[i] AS part, md FROM m, unnest(generate_series(1, len(parts))) AS g(i)),
b AS (SELECT page_id, i, CASE WHEN i = 1 THEN '-' ELSE trim(split_part(part, chr(31), 1), {_WS}) END AS section,
 CASE WHEN i = 1 THEN part ELSE trim(split_part(part, chr(31), 2), {_WS}) END AS body FROM s),
k AS (SELECT * FROM b WHERE trim(body, {_WS}) <> '')
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS pos, section, sha256(body) AS body FROM k"""

QUERIES = {
    "normalize_text": (normalize_text, NORMALIZE),
    "content_terms": (content_terms, CONTENT_TERMS),
    "sentence_split": (sentence_split, SENTENCES),
    "overlap_score": (overlap_score, OVERLAP),
    "term_sets": (term_sets, TERM_SETS),
    "plan_subqueries": (plan_subqueries, PLAN),
    "question_entities": (question_entities, ENTITIES),
    "rewrite_terms": (rewrite_terms, REWRITE),
    "smalltalk_route": (smalltalk_route, SMALLTALK),
    "identities": (identities, IDENTITIES),
    "cache_keys": (cache_keys, CACHE_KEYS),
    "entity_norm": (entity_norm, ENTITY_NORM),
    "markdown_sections": (markdown_sections, SECTIONS),
}
