"""Queries of name resolution and of events, links and states, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as tx
from quillmill.operators import events as op
from quillmill.operators import graph, resolution
from quillmill.plans import sqltext as q
from quillmill.sources.tables import table

THRESHOLD = 0.85


def _ontology(spark: SparkSession, d: str) -> DataFrame:
    """Nations, some of which are known by no name of their own."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("n_nationkey")
    name = F.when(key == 7, "She").when(key.isin(3, 24), F.concat(F.lit("the "), F.lower("n_name"))).otherwise(F.col("n_name"))
    return n.select(F.concat(F.lit("n-"), "n_nationkey").alias("uuid"), name.alias("name"), F.col("r_name").alias("type"), F.array(F.lower("n_name")).alias("aliases"), key.cast("long").alias("position"))


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("s_suppkey") % 5
    name = F.when(k == 0, F.concat(F.lit(" "), F.lower("n_name"))).when(k == 1, F.lit("stranger")).when(k == 2, F.concat(F.substring("n_name", 1, 5), F.lit("x"))).when(k == 3, F.concat("n_name", F.lit("n"))).otherwise(F.col("s_name"))
    return s.select(F.col("s_suppkey").cast("long").alias("temp_id"), name.alias("name"), F.when(k < 4, F.col("r_name")).otherwise("Company").alias("type"), (F.col("s_suppkey") % 2 == 0).alias("is_new"))


def entity_resolution(spark: SparkSession, d: str) -> DataFrame:
    return resolution.resolve(_mentions(spark, d), _ontology(spark, d), THRESHOLD)


def resolution_metrics(spark: SparkSession, d: str) -> DataFrame:
    return resolution.metrics(entity_resolution(spark, d))


def _batch(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("event_type").alias("chapter_id"), F.col("event_id").cast("string").alias("event_id"), F.col("event_id").cast("long").alias("position"), F.concat(F.lit("by "), "user_id").alias("description"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """A third of the events, stored with another type, some without a description."""
    rows = op.event_rows(_batch(spark, d).filter("position % 3 = 0"))
    return rows.withColumn("type", F.lit("SCENE")).withColumn("description", F.when(F.col("sequence") % 2 == 1, "stored")).withColumn("sequence", F.lit(None).cast("long"))


def event_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A batch, of which some events come again, applied twice."""
    batch = _batch(spark, d)
    batch = batch.unionByName(batch.filter("position % 7 = 0").withColumn("position", F.col("position") + 1_000_000_000))
    return op.upsert_events(op.upsert_events(_stored(spark, d), batch), batch)


def event_links(spark: SparkSession, d: str) -> DataFrame:
    """All edges of the events, each as kind, source, target, role, intent."""
    e = table(spark, d, "events")
    events = op.event_rows(_batch(spark, d))
    uuid = tx.uuid5(F.lit(op.DNS), F.concat_ws(":", "event_type", "event_id"))
    c = table(spark, d, "customer")
    entities = c.select(F.concat(F.lit("c-"), "c_custkey").alias("uuid"), F.array(F.when(F.col("c_nationkey") % 2 == 0, "Location").otherwise("Character")).alias("labels"))
    chunks = e.filter("event_id % 10 = 3").select(F.col("event_type").alias("chapter_id"), F.col("event_id").alias("position"), F.md5(F.col("event_id").cast("string")).alias("hash"))
    places = e.select(uuid.alias("event_uuid"), F.concat(F.lit("c-"), F.col("user_id") % 50).alias("location_uuid"))
    entity = F.concat(F.lit("c-"), "user_id").alias("entity_uuid")
    stored = e.filter("event_id % 4 = 0").select(entity, uuid.alias("event_uuid"), F.lit("stored").alias("role"), F.lit("kept").alias("intent"))
    stored = stored.join(entities.select(F.col("uuid").alias("entity_uuid")), "entity_uuid", "left_semi")
    batch = e.select(entity, uuid.alias("event_uuid"), F.concat(F.lit("role "), F.col("event_id") % 3).alias("role"), F.when(F.col("event_id") % 5 == 0, "set").alias("intent"), F.col("event_id").alias("position"))
    again = batch.filter("position % 6 = 0").withColumn("role", F.lit("last")).withColumn("intent", F.lit(None).cast("string")).withColumn("position", F.col("position") + 1_000_000_000)
    took_part = op.participated_in(stored, batch.unionByName(again), events, entities)
    none = F.lit(None).cast("string")
    edges = [("DOCUMENTED_BY", op.documented_by(events, chunks), "event_uuid", "chunk_hash"), ("OCCURRED_IN", op.occurred_in(events, places, entities), "event_uuid", "location_uuid"), ("NEXT", op.next_events(events), "from_uuid", "to_uuid")]
    out = took_part.select(F.lit("PARTICIPATED_IN").alias("kind"), F.col("entity_uuid").alias("source"), F.col("event_uuid").alias("target"), "role", "intent")
    for kind, rows, a, b in edges:
        out = out.unionByName(rows.select(F.lit(kind).alias("kind"), F.col(a).alias("source"), F.col(b).alias("target"), none.alias("role"), none.alias("intent")))
    return out


def state_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Even events are stored; then come the odd ones and some of the even again, twice."""
    e = table(spark, d, "events").select(
        F.concat(F.lit("u"), "user_id").alias("entity_uuid"), F.col("event_type").alias("attribute"), F.col("event_id").cast("string").alias("event_id"),
        F.concat(F.lit("v"), F.col("event_id") % 9).alias("value"), F.col("event_id").cast("long").alias("position"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"),
    )
    none = spark.createDataFrame([], "uuid string, entity_uuid string, attribute string, value string, valid_from string, valid_until string, closed_at string, created_at string")
    stored = op.apply_states(none, e.filter("position % 2 = 0"))
    batch = e.filter("position % 2 = 1 OR position % 5 = 0")
    return op.apply_states(op.apply_states(stored, batch), batch)


def logged_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    stamp = F.when(F.col("event_id") % 2 == 0, F.year("ts").cast("string")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    events = e.select(F.col("event_id").cast("string").alias("uid"), stamp.alias("timestamp"), F.concat(F.lit("place "), F.col("user_id") % 7).alias("location_name"), (F.col("event_id") - 1).cast("string").alias("parent_uid"))
    actors = e.select(F.col("event_id").cast("string").alias("event_uid"), F.concat(F.lit("u"), "user_id").alias("uid"), F.col("event_type").alias("role"))
    characters = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("u"), "c_custkey").alias("uid"))
    return op.logged(events, actors, characters, events.filter("cast(uid as long) % 4 = 0").select("uid"))


def entity_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Half of the customers are stored, some without a name; two thirds come again with other values, some of them twice."""
    c = table(spark, d, "customer")
    uuid = F.concat(F.lit("c-"), "c_custkey").alias("uuid")
    none, unset = F.array().cast("array<string>"), F.lit(None).cast("string")
    old = c.filter("c_custkey % 2 = 0").select(uuid, F.when(F.col("c_custkey") % 4 == 0, F.col("c_name")).alias("name"), F.when(F.col("c_custkey") % 6 == 0, F.array("c_mktsegment")).otherwise(none).alias("aliases"), unset.alias("baseline_state"))
    new = c.filter("c_custkey % 3 <> 1").select(uuid, F.upper("c_name").alias("name"), F.array(F.lower("c_mktsegment")).alias("aliases"), F.concat(F.lit("of "), "c_nationkey").alias("baseline_state"), F.col("c_custkey").cast("long").alias("position"))
    again = new.filter("position % 5 = 0").withColumn("name", F.lit("again")).withColumn("position", F.col("position") + 1_000_000_000)
    return graph.entity_upsert(old, new.unionByName(again)).select("uuid", "name", F.array_join("aliases", ",").alias("aliases"), "baseline_state")


def name_promotion(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    entities = n.select(F.concat(F.lit("n-"), "n_nationkey").alias("uuid"), F.when(F.col("n_nationkey") % 6 == 0, " ").otherwise(F.col("n_name")).alias("name"), F.array(F.lower("n_name")).alias("aliases"))
    renames = n.filter("n_nationkey % 3 = 0").select(F.concat(F.lit("n-"), "n_nationkey").alias("uuid"), F.concat(F.lit("New "), "n_name").alias("new_name"))
    return graph.promote_name(entities, renames).select("uuid", "name", F.array_join("aliases", ",").alias("aliases"), "aliases_text")


QUERIES = {f.__name__: f for f in (entity_resolution, resolution_metrics, event_upsert, event_links, state_upsert, logged_events, entity_upsert, name_promotion)}


def _uuid5(namespace: str, name: str) -> str:
    h = f"sha1(unhex('{namespace}') || encode({name}))"
    variant = f"substr('89ab', CAST(('0x' || {h}[17:17]) AS INTEGER) % 4 + 1, 1)"
    return f"({h}[1:8] || '-' || {h}[9:12] || '-5' || {h}[14:16] || '-' || {variant} || {h}[18:20] || '-' || {h}[21:32])"


_GENERIC = f"(lower(trim(name)) IN ({q.words(graph.GENERIC_NAMES)}) OR starts_with(lower(trim(name)), 'the '))"
_RESOLVED = f"""
    o AS (
        SELECT 'n-' || n_nationkey AS uuid, CASE WHEN n_nationkey = 7 THEN 'She' WHEN n_nationkey IN (3, 24) THEN 'the ' || lower(n_name) ELSE n_name END AS name,
               r_name AS type, lower(n_name) AS alias, n_nationkey AS position FROM nation JOIN region ON n_regionkey = r_regionkey),
    m AS (
        SELECT CAST(s_suppkey AS BIGINT) AS temp_id, CASE s_suppkey % 5 WHEN 0 THEN ' ' || lower(n_name) WHEN 1 THEN 'stranger' WHEN 2 THEN n_name[1:5] || 'x' WHEN 3 THEN n_name || 'n' ELSE s_name END AS name,
               CASE WHEN s_suppkey % 5 < 4 THEN r_name ELSE 'Company' END AS type, s_suppkey % 2 = 0 AS is_new
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
    x AS (SELECT k, arg_max(uuid, position) AS uuid FROM (SELECT lower(name) AS k, uuid, position FROM o UNION ALL SELECT alias, uuid, position FROM o) GROUP BY k),
    g AS (SELECT lower(type) AS t, min(uuid) AS uuid FROM o WHERE {_GENERIC} GROUP BY ALL HAVING count(*) = 1),
    a AS (SELECT m.*, x.uuid AS exact, CASE WHEN x.uuid IS NULL AND NOT {_GENERIC.replace("name", "m.name")} THEN g.uuid END AS unnamed
          FROM m LEFT JOIN x ON k = lower(trim(m.name)) LEFT JOIN g ON t = lower(m.type)),
    n AS (SELECT DISTINCT lower(name) AS name FROM a WHERE exact IS NULL AND unnamed IS NULL),
    l(a, b, i, s) AS (
        SELECT n.name, lower(o.name), 0, list_transform(range(0, length(n.name) + 1), lambda j: 0) FROM n, o
        UNION ALL
        SELECT a, b, i + 1, list_transform(range(0, length(a) + 1), lambda j: list_max(list_transform(range(0, j + 1), lambda k: CASE WHEN k > 0 AND a[k:k] = b[i + 1:i + 1] THEN s[k] + 1 ELSE s[k + 1] END)))
        FROM l WHERE i < length(b)),
    r AS (SELECT a, b, 200.0 * s[length(a) + 1] / (length(a) + length(b)) AS score FROM l WHERE i = length(b)),
    f AS (SELECT a, max({{'s': score, 'p': -position, 'u': uuid}}) AS best FROM r JOIN o ON b = lower(o.name) GROUP BY a),
    j AS (
        SELECT a.*, CASE WHEN best.s >= {THRESHOLD * 100} THEN best.u END AS near, best.s AS s
        FROM a LEFT JOIN f ON exact IS NULL AND unnamed IS NULL AND f.a = lower(a.name)),
    k AS (
        SELECT j.*, o.uuid, o.name AS known, {_GENERIC.replace("name", "o.name")} AND NOT {_GENERIC.replace("name", "j.name")} AND lower(trim(o.name)) <> lower(trim(j.name)) AS up
        FROM j LEFT JOIN o ON o.uuid = coalesce(exact, unnamed, near)),
    resolved AS (
        SELECT temp_id, name, type, uuid, is_new AND exact IS NOT NULL AS is_new_mismatch, CASE WHEN near IS NOT NULL THEN round(s, 4) END AS score,
               CASE WHEN exact IS NOT NULL THEN 'ontology' WHEN unnamed IS NOT NULL THEN 'generic_placeholder_upgrade' WHEN near IS NULL THEN 'new' WHEN up THEN 'fuzzy_generic_upgrade' ELSE 'conflict' END AS outcome,
               CASE WHEN (exact IS NOT NULL AND up) OR unnamed IS NOT NULL OR (near IS NOT NULL AND up) THEN known END AS old_name FROM k)"""

_EVENTS = f"v AS (SELECT {_uuid5(op.DNS, 'event_type || chr(58) || event_id')} AS uuid, * FROM events)"

ORACLE_SQL = {
    "entity_resolution": f"WITH RECURSIVE {_RESOLVED} SELECT temp_id, name, type, outcome, uuid, old_name, is_new_mismatch, score FROM resolved",
    "resolution_metrics": f"""
        WITH RECURSIVE {_RESOLVED}
        SELECT count(*) FILTER (outcome = 'ontology') AS exact_resolved, count(*) FILTER (is_new_mismatch) AS auto_corrected_is_new, count(*) FILTER (outcome = 'conflict') AS fuzzy_conflicts,
               count(*) FILTER (outcome = 'new') AS created_new, count(old_name) AS name_promotions FROM resolved""",
    "event_upsert": f"""
        WITH {_EVENTS}
        SELECT uuid, CASE WHEN event_id % 3 = 0 THEN 'SCENE' ELSE 'GENERIC' END AS type, CASE WHEN event_id % 6 = 3 THEN 'stored' ELSE 'by ' || user_id END AS description,
               CAST(NULL AS VARCHAR) AS timestamp, CAST(event_id AS BIGINT) AS sequence, event_type AS chapter_id FROM v""",
    "event_links": f"""
        WITH {_EVENTS},
        c AS (SELECT 'c-' || c_custkey AS uuid, c_nationkey % 2 = 0 AS is_place FROM customer),
        h AS (SELECT event_type, md5(CAST(min(event_id) AS VARCHAR)) AS hash FROM events WHERE event_id % 10 = 3 GROUP BY ALL)
        SELECT 'DOCUMENTED_BY' AS kind, uuid AS source, hash AS target, CAST(NULL AS VARCHAR) AS role, CAST(NULL AS VARCHAR) AS intent FROM v JOIN h USING (event_type)
        UNION ALL SELECT 'OCCURRED_IN', v.uuid, c.uuid, NULL, NULL FROM v JOIN c ON c.uuid = 'c-' || (user_id % 50) WHERE is_place
        UNION ALL SELECT 'NEXT', uuid, n, NULL, NULL FROM (SELECT uuid, lead(uuid) OVER (PARTITION BY event_type ORDER BY event_id, uuid) AS n FROM v) WHERE n IS NOT NULL
        UNION ALL SELECT 'PARTICIPATED_IN', c.uuid, v.uuid, CASE WHEN event_id % 6 = 0 THEN 'last' ELSE 'role ' || (event_id % 3) END,
                         CASE WHEN event_id % 5 = 0 THEN 'set' WHEN event_id % 4 = 0 THEN 'kept' END FROM v JOIN c ON c.uuid = 'c-' || user_id""",
    "state_upsert": f"""
        WITH s AS (
            SELECT *, strftime(ts, '%Y-%m-%d %H:%M:%S') AS made, lead(event_id) OVER w AS u, strftime(lead(ts) OVER w, '%Y-%m-%d %H:%M:%S') AS c
            FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id % 2, event_id))
        SELECT {_uuid5(op.URL, "'u' || user_id || ':' || event_type || ':' || event_id")} AS uuid, 'u' || user_id AS entity_uuid, event_type AS attribute, 'v' || (event_id % 9) AS value,
               CAST(event_id AS VARCHAR) AS valid_from, CAST(u AS VARCHAR) AS valid_until, c AS closed_at, made AS created_at FROM s""",
    "logged_events": """
        SELECT 'OCCURRED_IN' AS kind, CAST(event_id AS VARCHAR) AS source, CAST(year(ts) AS VARCHAR) AS target, CAST(NULL AS VARCHAR) AS role FROM events
        UNION ALL SELECT 'TOOK_PLACE_AT', CAST(event_id AS VARCHAR), 'place ' || (user_id % 7), NULL FROM events
        UNION ALL SELECT 'PARTICIPATED', 'u' || user_id, CAST(event_id AS VARCHAR), event_type FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)
        UNION ALL SELECT 'CAUSED_BY', CAST(event_id AS VARCHAR), CAST(event_id - 1 AS VARCHAR), NULL FROM events e WHERE (event_id - 1) % 4 = 0 AND EXISTS (SELECT 1 FROM events p WHERE p.event_id = e.event_id - 1)""",
    "entity_upsert": """
        WITH o AS (SELECT 'c-' || c_custkey AS uuid, CASE WHEN c_custkey % 4 = 0 THEN c_name END AS name, CASE WHEN c_custkey % 6 = 0 THEN c_mktsegment ELSE '' END AS a FROM customer WHERE c_custkey % 2 = 0),
        n AS (SELECT 'c-' || c_custkey AS uuid, upper(c_name) AS name, lower(c_mktsegment) AS a, 'of ' || c_nationkey AS b FROM customer WHERE c_custkey % 3 <> 1)
        SELECT uuid, coalesce(o.name, n.name) AS name, CASE WHEN coalesce(o.a, '') <> '' THEN o.a ELSE coalesce(n.a, '') END AS aliases, b AS baseline_state FROM o FULL JOIN n USING (uuid)""",
    "name_promotion": """
        WITH e AS (SELECT n_nationkey AS k, n_name, CASE WHEN n_nationkey % 6 = 0 THEN ' ' ELSE n_name END AS name FROM nation)
        SELECT 'n-' || k AS uuid, CASE WHEN k % 3 = 0 THEN 'New ' || n_name ELSE name END AS name,
               CASE WHEN k % 3 = 0 AND k % 6 <> 0 AND n_name <> lower(n_name) THEN lower(n_name) || ',' || n_name ELSE lower(n_name) END AS aliases,
               CASE WHEN k % 3 = 0 AND k % 6 <> 0 THEN name END AS aliases_text FROM e""",
}
