"""Queries of graph tables and reviews over the driver's star schema, with DuckDB SQL for each.

Customers stand for entities, orders and events for events, conversations for dialogues, labels for reviews.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as tx
from quillmill.operators import graph as op
from quillmill.operators import review
from quillmill.operators.lexical import paragraphs
from quillmill.sources.tables import table


def chunk_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks by content hash: the first of equal texts is the chunk, stored values stay."""
    docs = table(spark, d, "documents").select(tx.content_hash(F.col("text")).alias("hash"), "doc_id", "source", "lang")
    old = docs.filter("doc_id % 2 = 0").groupBy("hash").agg(F.min_by("source", "doc_id").alias("source"), F.lit(None).cast("string").alias("lang"))
    return op.first_wins(old, docs, "hash", "doc_id")


def interaction_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return op.last_wins(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def state_history(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    again = rows.unionByName(rows.filter("event_id % 5 = 0"))  # some changes come twice
    out = op.state_history(again, ["user_id", "event_type"], "ts", "event_id")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return out.select("user_id", "event_type", "event_id", stamp("valid_from").alias("valid_from"), stamp("valid_until").alias("valid_until"), "is_open")


def event_chain(spark: SparkSession, d: str) -> DataFrame:
    return op.event_chain(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_id")


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(op.add_label(F.array("c_mktsegment"), F.when(F.col("c_acctbal") < 0, "Debtor").otherwise("Customer")).alias("labels"))
    return op.label_counts(c)


def event_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("count"))


def referential_violations(spark: SparkSession, d: str) -> DataFrame:
    events, orders, c = (table(spark, d, t) for t in ("events", "orders", "customer"))
    known = c.filter("c_custkey % 10 <> 0")
    found = [
        op.violations("event_without_participant", events, "user_id", known, "c_custkey"),
        op.violations("order_without_customer", orders, "o_custkey", known, "c_custkey"),
        op.violations("customer_without_location", c, "c_nationkey", table(spark, d, "nation").filter("n_regionkey <> 2"), "n_nationkey"),
        op.violations("label_without_document", table(spark, d, "labels"), "doc_id", table(spark, d, "documents").filter("lang <> 'fr'"), "doc_id"),
        table(spark, d, "lineitem").filter("l_discount < 0 OR l_discount > 0.08").groupBy(F.lit("weight_out_of_range").alias("rule")).agg(F.count("*").alias("violations")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _ontology(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.concat(F.lit("n-"), "n_nationkey").alias("uuid"), F.col("n_name").alias("name"), F.array("r_name").alias("aliases"), F.col("n_nationkey").cast("long").alias("position"))


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("s_suppkey") % 4
    name = F.when(k == 0, F.lower("n_name")).when(k == 1, F.concat(F.lit(" "), F.lower("r_name"))).when(k == 2, F.concat(F.substring("n_name", 1, 5), F.lit("x"))).otherwise(F.col("s_name"))
    return s.select(F.col("s_suppkey").cast("long").alias("temp_id"), name.alias("name"))


def recent_states(spark: SparkSession, d: str) -> DataFrame:
    """The latest 50 events of customers in one segment, newest first."""
    wanted = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    rows = table(spark, d, "events").join(wanted, "user_id", "left_semi").orderBy(F.desc("ts"), F.desc("event_id")).limit(50)
    return rows.select("event_id", "user_id", "event_type")


def filtered_entities(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").filter(F.contains(F.lower("p_name"), F.lit("a"))).orderBy("p_name", "p_partkey").limit(200)
    return rows.select("p_partkey", "p_name")


def _reviews(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 3
    decision = F.when(k == 0, "accept").when(k == 1, "minor_rewrite").otherwise("major_rewrite")
    return table(spark, d, "labels").select(F.col("doc_id").alias("paragraph_id"), decision.alias("decision"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("revised "), "doc_id")).otherwise("").alias("revised"))


def qa_final_text(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    translated = docs.select(F.col("doc_id").alias("paragraph_id"), F.col("text").alias("translation"))
    source = docs.filter("lang = 'en'").select(F.col("doc_id").alias("paragraph_id"), F.concat(F.lit("source: "), "text").alias("source_text"))
    return review.final_texts(translated, source, _reviews(spark, d))


def _critics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return rows.select("source", F.concat(F.lit("critic-"), F.col("doc_id") % 5).alias("critic_id"), F.when((F.col("quality") == 0) & (F.col("doc_id") % 4 == 0), "rework").otherwise("pass").alias("verdict"), (F.col("toxic") == 1).alias("fundamental"))


def critics_rollup(spark: SparkSession, d: str) -> DataFrame:
    return review.critics_rollup(_critics(spark, d), "source")


def review_mapping(spark: SparkSession, d: str) -> DataFrame:
    rework = bool(_critics(spark, d).agg(F.bool_or((F.col("verdict") == "rework") | F.col("fundamental"))).first()[0])
    typography = table(spark, d, "labels").select(F.col("doc_id").alias("paragraph_id"), F.when(F.col("quality") == 1, "pass").otherwise("fix").alias("decision"), (F.col("toxic") == 1).alias("hard_fail"))
    return review.mapped(table(spark, d, "documents").select(F.col("doc_id").alias("paragraph_id")), typography, rework)


def candidate_map(spark: SparkSession, d: str) -> DataFrame:
    return review.line_map(paragraphs(table(spark, d, "documents")))


def signup_dedupe(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.concat(F.when(F.col("user_id") % 7 == 0, "=").otherwise(""), F.lit("u"), "user_id", F.lit("@example.org")).alias("email"), F.col("event_type").alias("lang"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "event_id")
    return review.new_signups(e.filter("event_id % 11 = 0").select("lang", "email").distinct(), e.select("lang", "email", "ts"))


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("group_id"), F.col("turn").alias("position"), F.coalesce("text", F.lit("")).alias("text"))


def context_topk(spark: SparkSession, d: str) -> DataFrame:
    """Every turn as an item, some with words that no turn has, against all turns of its dialogue."""
    turns = _turns(spark, d)
    items = turns.select("group_id", F.col("position").alias("item_id"), F.when(F.col("position") % 4 == 3, "zzzz").otherwise(F.col("text")).alias("text"))
    return review.context_top(items, turns)


def context_band(spark: SparkSession, d: str) -> DataFrame:
    turns, p = _turns(spark, d), F.col("position")
    items = turns.select("group_id", p.alias("item_id"), F.when(p % 3 > 0, p).alias("start"), F.when(p % 3 < 2, p + 1).alias("end"))
    return review.context_band(items, turns, 1)


def directive_items(spark: SparkSession, d: str) -> DataFrame:
    return review.directives(table(spark, d, "documents").select("doc_id", "text"))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """Deterministic ids: hash prefixes and a name-based UUID."""
    h = F.sha2("text", 256)
    return table(spark, d, "documents").select("doc_id", F.concat(F.substring(h, 1, 8), F.lit("-chunk-"), "doc_id").alias("chunk_id"), F.substring(h, 1, 16).alias("chapter_id"), tx.content_hash(F.col("text")).alias("content_hash"))


QUERIES = {
    f.__name__: f
    for f in (
        chunk_upsert, interaction_upsert, state_history, event_chain, label_counts, event_types, referential_violations, recent_states,
        filtered_entities, qa_final_text, critics_rollup, review_mapping, candidate_map, signup_dedupe, context_topk, context_band, directive_items, chunk_ids,
    )
} | {"entity_exact_resolution": lambda spark, d: op.exact_resolution(_mentions(spark, d), _ontology(spark, d))}

_TERMS = "list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda x: length(x) > 2))"
_CRITICS = "k AS (SELECT source, 'critic-' || (doc_id % 5) AS critic_id, CASE WHEN quality = 0 AND doc_id % 4 = 0 THEN 'rework' ELSE 'pass' END AS verdict, toxic = 1 AS fundamental FROM documents JOIN labels USING (doc_id))"

ORACLE_SQL = {
    "chunk_upsert": """
        WITH d AS (SELECT 'sha256:' || sha256(text) AS hash, doc_id, source, lang FROM documents),
        o AS (SELECT hash, arg_min(source, doc_id) AS source FROM d WHERE doc_id % 2 = 0 GROUP BY hash),
        n AS (SELECT hash, arg_min(source, doc_id) AS source, arg_min(lang, doc_id) AS lang FROM d GROUP BY hash)
        SELECT hash, coalesce(o.source, n.source) AS source, n.lang FROM n LEFT JOIN o USING (hash)""",
    "interaction_upsert": """
        SELECT user_id, event_type, event_id, "value" FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""",
    "state_history": """
        WITH s AS (SELECT user_id, event_type, event_id, ts, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS u FROM events)
        SELECT user_id, event_type, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS valid_from, strftime(u, '%Y-%m-%d %H:%M:%S') AS valid_until, u IS NULL AS is_open FROM s""",
    "event_chain": """
        SELECT * FROM (SELECT user_id, event_id AS source_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target_id FROM events) WHERE target_id IS NOT NULL""",
    "label_counts": """
        SELECT label, count(*) AS count FROM (SELECT unnest(list_distinct([c_mktsegment, CASE WHEN c_acctbal < 0 THEN 'Debtor' ELSE 'Customer' END])) AS label FROM customer) GROUP BY label""",
    "event_types": "SELECT event_type, count(*) AS count FROM events GROUP BY event_type",
    "referential_violations": """
        WITH c AS (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0),
        v AS (
            SELECT 'event_without_participant' AS rule FROM events WHERE user_id NOT IN (SELECT c_custkey FROM c)
            UNION ALL SELECT 'order_without_customer' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM c)
            UNION ALL SELECT 'customer_without_location' FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)
            UNION ALL SELECT 'label_without_document' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang <> 'fr')
            UNION ALL SELECT 'weight_out_of_range' FROM lineitem WHERE l_discount < 0 OR l_discount > 0.08)
        SELECT rule, count(*) AS violations FROM v GROUP BY rule""",
    "recent_states": """
        SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') ORDER BY ts DESC, event_id DESC LIMIT 50""",
    "filtered_entities": "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') ORDER BY p_name, p_partkey LIMIT 200",
    "qa_final_text": """
        WITH r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'accept' WHEN 1 THEN 'minor_rewrite' ELSE 'major_rewrite' END AS decision, CASE WHEN doc_id % 2 = 0 THEN 'revised ' || doc_id ELSE '' END AS revised FROM labels),
        t AS (SELECT doc_id, text AS translation, CASE WHEN lang = 'en' THEN 'source: ' || text ELSE '' END AS source_text FROM documents)
        SELECT doc_id AS paragraph_id, source_text, coalesce(decision, 'missing') AS decision,
               CASE WHEN decision IN ('minor_rewrite', 'major_rewrite') THEN CASE WHEN revised <> '' THEN revised ELSE trim(translation) END ELSE translation END AS final_text
        FROM t LEFT JOIN r USING (doc_id)""",
    "critics_rollup": f"""
        WITH {_CRITICS}
        SELECT source, bool_or(verdict = 'rework' OR fundamental) AS rework_required, count(*) FILTER (fundamental) AS fundamental_problems, count(*) AS critics,
               count(*) FILTER (verdict <> 'rework') AS passing, count(*) FILTER (verdict = 'rework') AS failing,
               coalesce(array_to_string(list_sort(list_distinct(list(critic_id) FILTER (verdict = 'rework'))), ','), '') AS failing_critics FROM k GROUP BY source""",
    "review_mapping": f"""
        WITH {_CRITICS}, w AS (SELECT CASE WHEN bool_or(verdict = 'rework' OR fundamental) THEN 0 ELSE 1 END AS p FROM k)
        SELECT d.doc_id AS paragraph_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN quality = 1 THEN 'pass' ELSE 'fix' END AS decision,
               coalesce(toxic = 1, false) AS hard_fail, CAST(p AS BIGINT) AS critics_pass FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id, w""",
    "candidate_map": """
        WITH n AS (SELECT source AS manuscript_id, doc_id, len(string_split(text, chr(10))) AS lines FROM documents),
        s AS (SELECT *, CAST(coalesce(sum(lines + 1) OVER (PARTITION BY manuscript_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS BIGINT) AS start_line FROM n)
        SELECT manuscript_id, doc_id, start_line, start_line + lines - 1 AS end_line FROM s""",
    "signup_dedupe": """
        WITH e AS (SELECT CASE WHEN user_id % 7 = 0 THEN '=' ELSE '' END || 'u' || user_id || '@example.org' AS email, event_type AS lang, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_id FROM events),
        f AS (SELECT lang, email, min(ts) AS ts FROM e GROUP BY ALL)
        SELECT lang, regexp_replace(email, '^([=+\\-@])', '''\\1') AS email, ts FROM f ANTI JOIN (SELECT lang, email FROM e WHERE event_id % 11 = 0) s USING (lang, email)""",
    "context_topk": f"""
        WITH t AS (SELECT conv_id AS group_id, turn AS position, {_TERMS} AS terms FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)),
        m AS (SELECT a.group_id, a.position AS item_id, b.position, CAST(len(list_intersect(CASE WHEN a.position % 4 = 3 THEN ['zzzz'] ELSE a.terms END, b.terms)) AS BIGINT) AS shared FROM t a JOIN t b USING (group_id)),
        x AS (SELECT *, max(shared) OVER (PARTITION BY group_id, item_id) AS most FROM m),
        r AS (SELECT *, row_number() OVER (PARTITION BY group_id, item_id ORDER BY shared DESC, position) AS n FROM x WHERE shared > 0 OR most = 0)
        SELECT group_id, item_id, position, shared, row_number() OVER (PARTITION BY group_id, item_id ORDER BY position) AS place FROM r WHERE n <= 8""",
    "context_band": """
        WITH i AS (SELECT conv_id AS group_id, turn AS item_id, CASE WHEN turn % 3 = 0 THEN turn + 1 ELSE turn END AS a, CASE WHEN turn % 3 < 2 THEN turn + 1 ELSE turn END AS b FROM conversations)
        SELECT group_id, item_id, turn AS position FROM i JOIN conversations ON group_id = conv_id WHERE turn BETWEEN a - 1 AND b + 1""",
    "directive_items": """
        WITH l AS (SELECT doc_id, regexp_replace(v, '^\\s+|\\s+$', '', 'g') AS v, line FROM (SELECT doc_id, unnest(l) AS v, unnest(range(1, len(l) + 1)) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS l FROM documents))),
        m AS (SELECT *, regexp_matches(v, '^([-*]|\\d+[.)])\\s+') OR regexp_matches(lower(v), '^(cull|delete)') AS k FROM l WHERE v <> '' AND NOT starts_with(v, '#')),
        a AS (SELECT *, bool_or(k) OVER (PARTITION BY doc_id) AS any_k FROM m)
        SELECT doc_id, 'item_' || CASE WHEN line < 10000 THEN lpad(CAST(line AS VARCHAR), 4, '0') ELSE CAST(line AS VARCHAR) END AS item_id, CASE WHEN k THEN regexp_replace(v, '^([-*]|\\d+[.)])\\s+', '') ELSE v END AS item FROM a WHERE k OR NOT any_k""",
    "chunk_ids": """
        SELECT doc_id, sha256(text)[1:8] || '-chunk-' || doc_id AS chunk_id, sha256(text)[1:16] AS chapter_id, 'sha256:' || sha256(text) AS content_hash FROM documents""",
    "entity_exact_resolution": """
        WITH n AS (SELECT n_nationkey, 'n-' || n_nationkey AS uuid, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
        x AS (SELECT k, arg_max(uuid, n_nationkey) AS uuid FROM (SELECT lower(n_name) AS k, uuid, n_nationkey FROM n UNION ALL SELECT lower(r_name), uuid, n_nationkey FROM n) GROUP BY k),
        m AS (SELECT CAST(s_suppkey AS BIGINT) AS temp_id, CASE s_suppkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN ' ' || lower(r_name) WHEN 2 THEN n_name[1:5] || 'x' ELSE s_name END AS name
              FROM supplier JOIN n ON s_nationkey = n_nationkey)
        SELECT temp_id, name, uuid, CASE WHEN uuid IS NULL THEN 'none' ELSE 'ontology' END AS match_source FROM m LEFT JOIN x ON k = lower(trim(name))""",
}
