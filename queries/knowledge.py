"""Knowledge graph over the star schema: nations are part of regions, customers and suppliers part of nations, suppliers
integrate with the parts they ship. One tenant owns all of it, so nations and regions are very large hubs."""

from __future__ import annotations

from pyspark.sql import functions as F

from citewell import session
from citewell.functions import text, triples
from citewell.operators import graph
from citewell.sources import tables
from queries.common import table, user_turns

NORM = "regexp_replace(lower(trim({})), '\\s+', ' ', 'g')"


def edges(spark, d):
    """Raw edges, one row per source row, so repeated ones occur."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    named = F.broadcast(nation.select(F.col("n_nationkey").alias("k"), "n_name"))  # 25 rows by definition of the schema
    part_of = lambda s, o, doc: [s.alias("subject"), F.lit("part of").alias("predicate"), o.alias("object"), doc.alias("doc_id")]
    a = nation.join(region, nation.n_regionkey == region.r_regionkey).select(*part_of(F.col("n_name"), F.col("r_name"), F.concat(F.lit("n"), "n_nationkey")))
    c = table(spark, d, "customer").join(named, F.col("c_nationkey") == F.col("k")).select(
        *part_of(F.col("c_name"), F.col("n_name"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"))))
    s = table(spark, d, "supplier").join(named, F.col("s_nationkey") == F.col("k")).select(
        *part_of(F.col("s_name"), F.col("n_name"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))))
    # names are normalized where each stands once
    supplier = text.computed(table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), s_norm=text.norm_entity(F.col("s_name")))
    part = text.computed(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), p_norm=text.norm_entity(F.col("p_name")))
    shipped = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey").join(supplier, "l_suppkey").join(part, "l_partkey").select(
        F.col("s_name").alias("subject"), F.col("s_norm").alias("subject_norm"), F.lit("integrates with").alias("predicate"), F.col("p_name").alias("object"),
        F.col("p_norm").alias("object_norm"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("doc_id"))
    rows = a.unionByName(c).unionByName(s).select("subject", text.norm_entity(F.col("subject")).alias("subject_norm"), "predicate", "object",
                                                  text.norm_entity(F.col("object")).alias("object_norm"), "doc_id").unionByName(shipped)
    return rows.select(F.lit("acme").alias("tenant_id"), "subject", "subject_norm", "predicate", "object", "object_norm", "doc_id",
                       F.concat("doc_id", F.lit("#0")).alias("chunk_id"))


EDGES = f"""raw AS (SELECT n_name AS subject, 'part of' AS predicate, r_name AS object, 'n' || n_nationkey AS doc_id FROM nation JOIN region ON n_regionkey = r_regionkey
 UNION ALL SELECT c_name, 'part of', n_name, 'c' || c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey
 UNION ALL SELECT s_name, 'part of', n_name, 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
 UNION ALL SELECT s_name, 'integrates with', p_name, 'o' || l_orderkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey),
edges AS (SELECT subject, {NORM.format('subject')} AS subject_norm, predicate, object, {NORM.format('object')} AS object_norm, doc_id, doc_id || '#0' AS chunk_id FROM raw)"""


def kg_dedupe(spark, d):
    """Edges per predicate and subject after the unique-key insert."""
    t = tables.distinct_triples(edges(spark, d))
    return t.groupBy("predicate", "subject").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


DEDUPE = f"""WITH {EDGES}, u AS (SELECT subject_norm, predicate, object_norm, chunk_id, min(subject) AS subject, min(doc_id) AS doc_id FROM edges GROUP BY ALL)
SELECT predicate, subject, count(*)::BIGINT AS n, min(doc_id) AS first_doc FROM u GROUP BY ALL"""


def kg_insert_new(spark, d):
    """Triples of even orders are stored; those of all orders are offered; what is really inserted, per predicate."""
    all_edges = edges(spark, d)
    stored = all_edges.filter("doc_id like '%0' or doc_id like '%2' or doc_id like '%4' or doc_id like '%6' or doc_id like '%8'")
    return tables.new_triples(stored, all_edges).groupBy("predicate").agg(F.count(F.lit(1)).alias("inserted"))


INSERT_NEW = f"""WITH {EDGES}, st AS (SELECT DISTINCT subject_norm, predicate, object_norm, chunk_id FROM edges WHERE right(doc_id, 1) IN ('0', '2', '4', '6', '8')),
al AS (SELECT DISTINCT subject_norm, predicate, object_norm, chunk_id FROM edges)
SELECT predicate, count(*)::BIGINT AS inserted FROM al ANTI JOIN st USING (subject_norm, predicate, object_norm, chunk_id) GROUP BY predicate"""


def kg_names(spark, d):
    return graph.entity_names(edges(spark, d)).withColumn("kind", F.regexp_extract("name", "^[a-z]+", 0)).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


NAMES = f"""WITH {EDGES}, n AS (SELECT subject_norm AS name FROM edges UNION SELECT object_norm FROM edges)
SELECT regexp_extract(name, '^[a-z]+') AS kind, count(*)::BIGINT AS n FROM n GROUP BY ALL"""


def _neighborhood(spark, d, seed_table, name, hops, limit):
    t = session.written(edges(spark, d), "edges")
    seeds = table(spark, d, seed_table).select(F.lit("acme").alias("tenant_id"), F.col(name).alias("qid"), text.norm_entity(F.col(name)).alias("node"))
    facts = graph.neighborhood(seeds, t, hops, limit)
    return facts.select("qid", F.col("position").cast("long").alias("position"), "subject", "predicate", "object", "doc_id", "chunk_id", F.col("depth").cast("long").alias("depth"))


def _neighborhood_sql(seed_table: str, name: str, hops: int, limit: int) -> str:
    levels = [f"d0 AS (SELECT DISTINCT {name} AS qid, {NORM.format(name)} AS node, 0 AS depth FROM {seed_table})"]
    for i in range(1, hops):
        levels.append(f"""d{i} AS (SELECT DISTINCT qid, other AS node, {i} AS depth FROM d{i - 1} JOIN steps USING (node))""")
    union = " UNION ALL ".join(f"SELECT * FROM d{i}" for i in range(hops))
    return f"""WITH {EDGES}, both_ways AS (SELECT *, subject_norm AS node, object_norm AS other FROM edges UNION ALL SELECT *, object_norm, subject_norm FROM edges),
steps AS (SELECT DISTINCT node, other FROM both_ways), {', '.join(levels)},
nodes AS (SELECT qid, node, min(depth) AS depth FROM ({union}) GROUP BY ALL),
facts AS (SELECT qid, subject, predicate, object, min(depth)::BIGINT AS depth, min(doc_id) AS doc_id, min(chunk_id) AS chunk_id FROM nodes JOIN both_ways USING (node) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY depth, subject, predicate, object) AS position FROM facts)
SELECT qid, position, subject, predicate, object, doc_id, chunk_id, depth FROM p WHERE position <= {limit}"""


def kg_one_hop(spark, d):
    return _neighborhood(spark, d, "supplier", "s_name", 1, 25)


def kg_two_hop(spark, d):
    return _neighborhood(spark, d, "supplier", "s_name", 2, 25)


def kg_three_hop(spark, d):
    return _neighborhood(spark, d, "region", "r_name", 3, 100)


def kg_explore(spark, d):
    """Entity explorer: hops clamped to three, at most 100 facts; unknown names give nothing."""
    t = session.written(edges(spark, d), "edges")
    asked = table(spark, d, "nation").select(F.lit("acme").alias("tenant_id"), F.concat(F.lit("  "), F.col("n_name"), F.when(F.col("n_nationkey") % 5 == 0, " Unknown").otherwise("")).alias("entity"))
    facts = graph.explore(asked, t, 9)
    return facts.select("entity", F.col("position").cast("long").alias("position"), "subject", "predicate", "object", "doc_id")


EXPLORE = _neighborhood_sql("(SELECT lower(n_name) AS n_name FROM nation WHERE n_nationkey % 5 <> 0)", "n_name", 3, 100)
EXPLORE = f"SELECT qid AS entity, position, subject, predicate, object, doc_id FROM ({EXPLORE})"


def _customer_questions(spark, d):
    named = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    c = table(spark, d, "customer").join(F.broadcast(named), "c_nationkey")
    q = F.concat(F.lit("Did "), F.col("c_name"), F.lit(" in "), F.initcap("n_name"), F.lit(" buy from Supplier#"), F.lpad((F.col("c_custkey") % 90).cast("string"), 9, "0"), F.lit("?"))
    return c.select(F.lit("acme").alias("tenant_id"), F.col("c_name").alias("qid"), q.alias("question"))


_QUESTIONS = """(SELECT c_name AS qid, 'Did ' || c_name || ' in ' || array_to_string(list_transform(string_split(n_name, ' '), lambda w: upper(left(w, 1)) || lower(substring(w, 2))), ' ') || ' buy from Supplier#' || lpad((c_custkey % 90)::VARCHAR, 9, '0') || '?' AS question
FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def kg_link_entities(spark, d):
    """Names mentioned in a question per customer, longest first, names inside longer ones dropped."""
    t = session.written(edges(spark, d), "edges")
    q = _customer_questions(spark, d).withColumnRenamed("question", "text")
    linked = graph.link_entities(q, graph.entity_names(t))
    return linked.select("qid", F.array_join("linked", "|").alias("linked"))


_LINKED = f"""names AS (SELECT subject_norm AS name FROM edges UNION SELECT object_norm FROM edges),
asked AS (SELECT qid, {NORM.format('question')} AS t FROM {_QUESTIONS} q),
near AS MATERIALIZED (SELECT qid, name, t FROM asked JOIN names ON length(name) >= 3 AND contains(t, name)),
hit AS MATERIALIZED (SELECT qid, name FROM near WHERE regexp_matches(t, '(^|[^a-z0-9])' || regexp_escape(name) || '($|[^a-z0-9])')),
kept AS (SELECT h.* FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit o WHERE o.qid = h.qid AND length(o.name) > length(h.name) AND contains(o.name, h.name))),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY length(name) DESC, name) AS rn FROM kept),
linked AS (SELECT qid, string_agg(name, '|' ORDER BY rn) AS linked FROM ranked WHERE rn <= 10 GROUP BY qid)"""
LINK = f"WITH {EDGES}, {_LINKED} SELECT qid, linked FROM linked"


def kg_question_facts(spark, d):
    """Linking and two-hop facts together: how many facts a question gets, and its first."""
    t = session.written(edges(spark, d), "edges")
    q = _customer_questions(spark, d).withColumn("entities", F.array().cast("array<string>"))
    _, facts = graph.graph_facts(q, t)
    return facts.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("position", F.concat_ws(" ", "subject", "predicate", "object").alias("f")))["f"].alias("first"))


FACTS = f"""WITH {EDGES}, {_LINKED}, both_ways AS (SELECT *, subject_norm AS node, object_norm AS other FROM edges UNION ALL SELECT *, object_norm, subject_norm FROM edges),
steps AS (SELECT DISTINCT node, other FROM both_ways), sets AS (SELECT DISTINCT linked FROM linked), d0 AS (SELECT linked, unnest(string_split(linked, '|')) AS node, 0 AS depth FROM sets),
d1 AS (SELECT DISTINCT linked, other AS node, 1 AS depth FROM d0 JOIN steps USING (node)), nodes AS (SELECT linked, node, min(depth) AS depth FROM (SELECT * FROM d0 UNION ALL SELECT * FROM d1) GROUP BY ALL),
facts AS (SELECT linked, subject, predicate, object, min(depth) AS depth FROM nodes JOIN both_ways USING (node) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY linked ORDER BY depth, subject, predicate, object) AS position FROM facts),
g AS (SELECT linked, count(*)::BIGINT AS n, min_by(subject || ' ' || predicate || ' ' || object, position) AS first FROM p WHERE position <= 25 GROUP BY linked)
SELECT qid, n, first FROM linked JOIN g USING (linked)"""


def triple_extraction(spark, d):
    """Triples found by the extractor in one written sentence per lineitem pair of supplier and part: every edge must come back."""
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")), "s_nationkey")
    body = F.concat(F.lit("The Supplier"), F.col("s_suppkey").cast("string"), F.lit(" Service depends on Part"), (F.col("s_suppkey") * 7).cast("string"), F.lit(" Store and is owned by Team "),
                    F.initcap(F.regexp_replace("n_name", "[ _]", "-")), F.lit(". It is late. Region Office"), F.col("s_nationkey").cast("string"), F.lit(" manages Depot A, Depot B, and Depot"), F.col("s_suppkey").cast("string"), F.lit("."))
    rows = s.select(F.lit("acme").alias("tenant_id"), F.col("s_suppkey").cast("string").alias("doc_id"), F.col("s_suppkey").cast("string").alias("chunk_id"), body.alias("text"))
    return triples.triples(rows).select("doc_id", "subject", "predicate", "object")


_TEAM = "'Team ' || upper(left(n_name, 1)) || lower(substring(regexp_replace(n_name, '[ _]', '-', 'g'), 2))"
EXTRACTION = f"""WITH s AS (SELECT s_suppkey, s_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey), t AS (
SELECT s_suppkey, 'Supplier' || s_suppkey || ' Service' AS subject, 'depends on' AS predicate, 'Part' || (s_suppkey * 7) || ' Store' AS object FROM s
UNION ALL SELECT s_suppkey, 'Supplier' || s_suppkey || ' Service', 'owned by', {_TEAM} FROM s
UNION ALL SELECT s_suppkey, 'Region Office' || s_nationkey, 'manages', unnest(['Depot A', 'Depot B', 'Depot' || s_suppkey]) FROM s)
SELECT s_suppkey::VARCHAR AS doc_id, subject, predicate, object FROM t"""

QUERIES = {
    "kg_dedupe": (kg_dedupe, DEDUPE),
    "kg_insert_new": (kg_insert_new, INSERT_NEW),
    "kg_names": (kg_names, NAMES),
    "kg_one_hop": (kg_one_hop, _neighborhood_sql("supplier", "s_name", 1, 25)),
    "kg_two_hop": (kg_two_hop, _neighborhood_sql("supplier", "s_name", 2, 25)),
    "kg_three_hop": (kg_three_hop, _neighborhood_sql("region", "r_name", 3, 100)),
    "kg_explore": (kg_explore, EXPLORE),
    "kg_link_entities": (kg_link_entities, LINK),
    "kg_question_facts": (kg_question_facts, FACTS),
    "triple_extraction": (triple_extraction, EXTRACTION),
}
