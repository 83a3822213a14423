"""Queries of rubrics, edits, payloads, overlays and candidates over the driver's tables, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import lexicons as lx
from quillmill.functions import text as tx
from quillmill.operators import annotated, findings, learned, lexical, overlay, places, review
from quillmill.operators.lexical import paragraphs
from quillmill.plans import event_queries
from quillmill.plans import sqltext as q
from quillmill.plans.metric_queries import ORACLE_SQL as METRIC
from quillmill.sources.tables import table


def _raw_score(k: int) -> str:
    """A score as a reviewer may write it, by document: numbers beyond both ends, words, nothing."""
    return f"CASE WHEN (doc_id + {k}) % 5 = 0 THEN 'n/a' WHEN (doc_id + {k}) % 7 = 0 THEN NULL ELSE CAST((doc_id * {k + 3}) % 9 - 1 AS {{}}) END"


def rubric_scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "labels")
    return review.rubric_scores(rows.select(F.col("doc_id").alias("paragraph_id"), *[F.expr(_raw_score(k).format("STRING")).alias(name) for k, name in enumerate(review.RUBRIC)]))


def applied_edits(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    k = F.col("turn") % 5
    excerpt = F.when(k == 0, F.concat(F.lit(" "), F.substring("text", 1, 7))).when(k == 1, "no such words").otherwise("")
    sentence = F.when(k <= 2, F.concat("text", F.lit(" "))).otherwise("another")
    correction = F.when(F.col("conv_id") % 3 == 0, "").when(k == 4, F.col("text")).otherwise(F.concat(F.lit("new "), "conv_id"))
    return s.select("conv_id", "turn", review.applied_edit(F.col("text"), excerpt, sentence, correction).alias("e")).select("conv_id", "turn", "e.mode", F.md5("e.text").alias("text_md5"))


def _payloads(spark: SparkSession, d: str) -> DataFrame:
    """Deletion payloads as a model may write them, right in about a third."""
    return table(spark, d, "events").select("event_id", F.expr(_PAYLOAD.format("STRING")).alias("payload"))


#: Both engines' expression of a payload; {} is the name of the text type.
_PAYLOAD = """
    CASE WHEN event_id % 17 = 0 THEN '{{broken' ELSE concat(
        '{{"line_id": "l', CAST(event_id AS {0}), '", "line_start": ', CASE WHEN event_id % 5 = 0 THEN '"3"' WHEN event_id % 5 = 1 THEN '2.5' ELSE '7' END, ', "line_end": ', CASE WHEN event_id % 3 = 0 THEN 'null' ELSE '9' END,
        CASE WHEN event_id % 4 = 0 THEN '' ELSE ', "matched_source_span": "a b"' END, ', "deletion_type": "', CASE WHEN event_id % 6 = 0 THEN 'cut' WHEN event_id % 2 = 0 THEN 'clause' ELSE 'full_sentence' END,
        '", "delete_text": ', CASE WHEN event_id % 13 = 0 THEN '5' ELSE '"a"' END, ', "reason_summary": "r", "metric_tags": ', CASE WHEN event_id % 11 = 0 THEN '"x"' ELSE '["x"]' END,
        ', "confidence": ', CASE WHEN event_id % 7 = 0 THEN '1.5' WHEN event_id % 7 = 1 THEN '"0.9"' WHEN event_id % 7 = 2 THEN '0.5' ELSE '0.75' END, ', "ambiguity_flags": []}}') END"""


def payload_errors(spark: SparkSession, d: str) -> DataFrame:
    return _payloads(spark, d).select("event_id", F.array_join(review.payload_errors(F.col("payload")), ",").alias("errors"))


def accepted_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Three attempts at each item."""
    rows = _payloads(spark, d).select(F.floor(F.col("event_id") / 3).alias("item_id"), (F.col("event_id") % 3).cast("long").alias("attempt"), "payload")
    return review.accepted_attempts(rows)


def _issues(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(
        F.concat(F.lit("i"), "doc_id").alias("issue_id"), F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("lang")).alias("issue_type"), F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 20)).alias("anchor_text"), F.col("source").alias("source_tool")
    )


def objectives(spark: SparkSession, d: str) -> DataFrame:
    own = review.objectives(_issues(spark, d))
    return own.select("issue_id", "objective_id", "proposal_id", "status", F.col("hard_constraint.value").alias("hard_constraint"), F.array_join("soft_constraints", "|").alias("soft_constraints"), F.col("metric_targets.surprisal_range.max").cast("double").alias("most_surprisal"), "issue_type", "source_tool")


def coloured_diff(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    extracted = e.select(F.col("event_id").alias("position"), F.when(F.col("event_id") % 3 == 0, "event").when(F.col("event_id") % 3 == 1, "state").otherwise("relationship").alias("kind"), F.concat(F.lit("by "), "user_id").alias("details"))
    return review.coloured(event_queries.entity_resolution(spark, d), extracted)


def released_results(spark: SparkSession, d: str) -> DataFrame:
    """Turns as results of which some are still missing."""
    rows = table(spark, d, "conversations").filter("conv_id % 3 = 0 OR turn <> conv_id % 5 + 1")
    return review.released(rows.select(F.col("conv_id").alias("run_id"), F.col("turn").cast("long").alias("position")))


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_type").alias("manuscript_id"), F.col("user_id").alias("sentence_index"), F.col("event_id").alias("position"))
    return review.in_reading_order(rows)


def _words(spark: SparkSession, d: str) -> DataFrame:
    """Parts as words: ten to a sentence, fifty to a paragraph."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.concat(F.lit("t"), k).alias("token_id"), k.cast("long").alias("position"), F.concat(F.lit("s"), F.floor(k / 10)).alias("sentence_id"), F.concat(F.lit("p"), F.floor(k / 50)).alias("paragraph_id"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Orders as items of four edits files; some name a token twice, or one that isn't there."""
    k = F.col("o_orderkey")
    token = lambda n: F.concat(F.lit("t"), (k * n) % 2500)
    sentences = F.when(k % 5 == 0, F.array(F.concat(F.lit("s"), k % 300), F.lit("none"))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "orders").select(
        F.concat(F.lit("f"), k % 4).alias("file"), k.cast("string").alias("item"), F.when(k % 3 == 0, "vague_intensity").when(k % 3 == 1, "ambivalence").otherwise("other").alias("issue_type"),
        F.when(k % 7 == 0, "surprisal_scout").otherwise("burst_monitor").alias("detector"), F.concat(F.lit("p"), k % 60).alias("paragraph_id"), sentences.alias("sentence_ids"),
        F.when(k % 11 == 0, F.array().cast("array<string>")).otherwise(F.array(token(1), token(3), token(1))).alias("token_ids"),
    )


def word_confidence(spark: SparkSession, d: str) -> DataFrame:
    return overlay.word_confidence(_items(spark, d), _words(spark, d), 4)


def overall_confidence(spark: SparkSession, d: str) -> DataFrame:
    return overlay.overall_confidence(overlay.word_confidence(_items(spark, d), _words(spark, d), 4, "item"))


def overlay_scopes(spark: SparkSession, d: str) -> DataFrame:
    return overlay.scope_counts(_items(spark, d), _words(spark, d))


def overlay_missing(spark: SparkSession, d: str) -> DataFrame:
    return overlay.missing_tokens(_items(spark, d), _words(spark, d), "item")


def issue_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return overlay.type_counts(_items(spark, d))


def manuscript_endings(spark: SparkSession, d: str) -> DataFrame:
    rows = paragraphs(table(spark, d, "documents"))
    k, n = F.col("doc_id"), F.col("token_count")
    scores = lexical.signal_density(rows).select("doc_id", (k % 7).alias("score"), F.round((k % 5 - 3) / 4 + F.when(k % 2 == 0, 0.25).otherwise(0.0), 4).alias("sentiment"), n.alias("weight"))
    return places.endings(rows, scores, 4)


def highlights(spark: SparkSession, d: str) -> DataFrame:
    h = lambda c, kind, severity: F.struct(kind.alias("kind"), severity.alias("severity"), F.col(c).alias("message"))
    none = F.lit(None).cast("string")
    rows = table(spark, d, "documents").select(F.col("source").alias("metric"), F.array(h("lang", none, F.lit("high")), h("source", F.col("lang"), none)).alias("highlights"))
    return findings.flattened_highlights(rows)


def flattened_numbers(spark: SparkSession, d: str) -> DataFrame:
    json = F.expr("concat('{\"a\": ', event_id, ', \"b\": {\"c\": true, \"d\": [1, 2], \"e\": {\"f\": ', user_id, '.5}}, \"g\": \"x\"}')")
    return findings.flattened_numbers(table(spark, d, "events").select("event_id", json.alias("j")), "event_id", "j")


def cleaned_texts(spark: SparkSession, d: str) -> DataFrame:
    """The cleanings for voices and similes, of texts among marks."""
    text = F.concat(F.lit("# H\n> "), "text", F.lit(" ```a `b` c``` *y* [z](u) `q`"))
    return table(spark, d, "documents").select("doc_id", F.md5(tx.clean_for_voice(text)).alias("voice"), F.md5(tx.clean_for_similes(text)).alias("similes"))


def text_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.explode(tx.lines(F.col("text"))).alias("l")).select("doc_id", F.col("l.line_number").cast("long").alias("line_number"), F.md5("l.line").alias("line_md5"))


def numbered_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("group_id"), F.col("turn").alias("position"), F.when(F.col("turn") % 3 > 0, F.concat(F.lit("own"), "turn")).alias("paragraph_id"))
    return review.paragraph_ids(rows)


def zipf_means(spark: SparkSession, d: str) -> DataFrame:
    words = lexical.term_frequency(table(spark, d, "benchmark")).filter(~F.contains("word", F.lit("'"))).select("word", (F.length("word") % 7 + 0.5).cast("double").alias("zipf"))
    return annotated.zipf_means(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), words)


def lateral_terms(spark: SparkSession, d: str) -> DataFrame:
    """Nations as lemmas of their region's and of their own synsets, below three of the regions."""
    n = table(spark, d, "nation")
    lemmas = n.select(F.concat(F.lit("k"), F.col("n_nationkey") % 8).alias("synset"), F.col("n_name").alias("lemma"), F.col("n_nationkey").alias("position"))
    edges = n.select(F.concat(F.lit("k"), F.col("n_nationkey") % 8).alias("child"), F.concat(F.lit("k"), F.col("n_regionkey") + 8).alias("parent")).distinct()
    return annotated.lateral_terms(lemmas, edges, 6)


def band_candidates(spark: SparkSession, d: str) -> DataFrame:
    frequency = lexical.term_frequency(table(spark, d, "documents"))
    vocabulary = lexical.term_frequency(table(spark, d, "benchmark")).select(F.col("word").alias("term"), (F.length("word") * 0.45).alias("zipf"))
    return annotated.band_candidates(places.ranked_words(frequency, 20).select("word"), vocabulary, frequency, 5.0)


def drift_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The first vectors as overused words, all others as the vocabulary."""
    v = table(spark, d, "embeddings").select(F.concat(F.lit("w"), "vec_id").alias("word"), F.transform("embedding", lambda x: x.cast("double")).alias("v"), "vec_id")
    frequency = v.select("word", (F.col("vec_id") % 4).alias("count"))
    return annotated.drift_candidates(v.filter("vec_id < 5").select("word", "v"), v.select(F.col("word").alias("term"), "v"), frequency, 3)


def lda_documents(spark: SparkSession, d: str) -> DataFrame:
    return learned.lda_documents(paragraphs(table(spark, d, "documents")))


def topic_coherence(spark: SparkSession, d: str) -> DataFrame:
    rows = paragraphs(table(spark, d, "documents"))
    return learned.coherence(rows, learned.lda_topics(rows))


QUERIES = {
    f.__name__: f
    for f in (
        rubric_scores, applied_edits, payload_errors, accepted_attempts, objectives, coloured_diff, released_results, reading_order, word_confidence, overall_confidence, overlay_scopes, overlay_missing,
        issue_type_counts, manuscript_endings, highlights, flattened_numbers, cleaned_texts, text_lines, numbered_paragraphs, zipf_means, lateral_terms, band_candidates, drift_candidates, lda_documents, topic_coherence,
    )
}

_ERRORS = f"""
    p AS (SELECT event_id, {_PAYLOAD.format("VARCHAR")} AS payload FROM events),
    k AS (SELECT *, json_valid(payload) AS ok, CASE WHEN json_valid(payload) THEN CAST(payload AS JSON) END AS j FROM p),
    e AS (
        SELECT event_id, ok, try_cast(json_extract_string(j, '$.confidence') AS DOUBLE) AS confidence, CASE WHEN NOT ok THEN 'invalid_json' ELSE concat_ws(',',
            {", ".join(f"CASE WHEN NOT list_contains(json_keys(j), '{name}') THEN 'missing:{name}' END" for name in review.PAYLOAD)},
            CASE WHEN json_extract_string(j, '$.deletion_type') NOT IN ({q.words(review.DELETION_TYPES)}) THEN 'invalid:deletion_type' END,
            CASE WHEN json_type(j, '$.line_start') NOT IN ('UBIGINT', 'BIGINT', 'NULL') THEN 'invalid:line_start' END, CASE WHEN json_type(j, '$.line_end') NOT IN ('UBIGINT', 'BIGINT', 'NULL') THEN 'invalid:line_end' END,
            CASE WHEN json_type(j, '$.confidence') NOT IN ('UBIGINT', 'BIGINT', 'DOUBLE') OR CAST(json_extract_string(j, '$.confidence') AS DOUBLE) NOT BETWEEN 0 AND 1 THEN 'invalid:confidence' END,
            CASE WHEN json_type(j, '$.metric_tags') <> 'ARRAY' THEN 'invalid:metric_tags' END, CASE WHEN json_type(j, '$.ambiguity_flags') <> 'ARRAY' THEN 'invalid:ambiguity_flags' END,
            CASE WHEN coalesce(json_type(j, '$.matched_source_span'), '') <> 'VARCHAR' THEN 'invalid:matched_source_span' END, CASE WHEN json_type(j, '$.delete_text') <> 'VARCHAR' THEN 'invalid:delete_text' END,
            CASE WHEN json_type(j, '$.reason_summary') <> 'VARCHAR' THEN 'invalid:reason_summary' END) END AS errors FROM k)"""

_OVERLAY = """
    w AS (SELECT 't' || p_partkey AS token_id, CAST(p_partkey AS BIGINT) AS position, 's' || (p_partkey // 10) AS sentence_id, 'p' || (p_partkey // 50) AS paragraph_id FROM part),
    i AS (
        SELECT 'f' || (o_orderkey % 4) AS file, CAST(o_orderkey AS VARCHAR) AS item, CASE o_orderkey % 3 WHEN 0 THEN 'vague_intensity' WHEN 1 THEN 'ambivalence' ELSE 'other' END AS issue_type,
               o_orderkey % 7 = 0 AS scout, 'p' || (o_orderkey % 60) AS paragraph_id, CASE WHEN o_orderkey % 5 = 0 THEN 's' || (o_orderkey % 300) END AS named,
               CASE WHEN o_orderkey % 11 = 0 THEN [] ELSE ['t' || (o_orderkey % 2500), 't' || (o_orderkey * 3 % 2500)] END AS tokens FROM orders),
    f AS (SELECT DISTINCT file, unnest(tokens) AS token_id FROM i), t AS (SELECT DISTINCT file, item, unnest(tokens) AS token_id FROM i)"""

_LEVEL = "CASE WHEN coalesce(n, 0) <= 0 THEN 1.0 WHEN n / 4 <= 0.25 THEN 0.8 WHEN n / 4 <= 0.5 THEN 0.6 WHEN n / 4 <= 0.75 THEN 0.4 ELSE 0.2 END"


def _cleaned_sql(rules: list[tuple[str, str]]) -> str:
    text = "t"
    for pattern, to in rules:
        text = f"regexp_replace({text}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return text


ORACLE_SQL = {
    "rubric_scores": f"""
        SELECT *, {" + ".join(review.RUBRIC)} AS total_score FROM (
            SELECT doc_id AS paragraph_id, {", ".join(f"greatest(0, least(5, coalesce(TRY_CAST({_raw_score(k).format('VARCHAR')} AS INTEGER), 0))) AS {name}" for k, name in enumerate(review.RUBRIC))} FROM labels)""",
    "applied_edits": r"""
        WITH s AS (
            SELECT conv_id, turn, coalesce(text, '') AS t, turn % 5 AS k FROM conversations),
        p AS (
            SELECT *, regexp_replace(CASE k WHEN 0 THEN substr(t, 1, 7) WHEN 1 THEN 'no such words' ELSE '' END, '^\s+|\s+$', '', 'g') AS e,
                   regexp_replace(CASE WHEN k <= 2 THEN t ELSE 'another' END, '^\s+|\s+$', '', 'g') AS w, CASE WHEN conv_id % 3 = 0 THEN '' WHEN k = 4 THEN t ELSE 'new ' || conv_id END AS c FROM s),
        m AS (
            SELECT *, CASE WHEN e <> '' AND contains(t, e) THEN 'replaced_excerpt' WHEN w <> '' AND regexp_replace(t, '^\s+|\s+$', '', 'g') = w THEN CASE WHEN c <> '' AND c <> w THEN 'replaced_whole_sentence' ELSE 'no_change' END
                           WHEN c <> '' AND c <> t THEN 'fallback_replaced_whole_sentence' ELSE 'no_change' END AS mode FROM p)
        SELECT conv_id, turn, mode, md5(CASE mode WHEN 'replaced_excerpt' THEN substr(t, 1, instr(t, e) - 1) || c || substr(t, instr(t, e) + length(e)) WHEN 'no_change' THEN t ELSE c END) AS text_md5 FROM m""",
    "payload_errors": f"WITH {_ERRORS} SELECT event_id, errors FROM e",
    "accepted_attempts": f"""
        WITH {_ERRORS}
        SELECT event_id // 3 AS item_id, min(CASE WHEN errors = '' AND confidence >= 0.7 THEN event_id % 3 END) AS attempt, bool_or(errors = '' AND confidence < 0.7) AS low_confidence,
               count(*) FILTER (errors = '' AND confidence >= 0.7) = 0 AS manual_review FROM e GROUP BY ALL""",
    "objectives": """
        WITH i AS (SELECT 'i' || doc_id AS issue_id, CASE WHEN doc_id % 3 = 0 OR lang = '' THEN 'style' ELSE coalesce(lang, 'style') END AS issue_type, CASE WHEN doc_id % 2 = 0 THEN substr(text, 1, 20) END AS a, source FROM documents)
        SELECT issue_id, 'objective-' || issue_id AS objective_id, 'proposal-' || issue_id AS proposal_id, 'pending' AS status, CASE WHEN a <> '' THEN a ELSE 'Preserve anchored entities and claims.' END AS hard_constraint,
               'Maintain original authorial voice.|Prefer concise, direct phrasing.|Prioritize improvements for issue type ''' || issue_type || '''.' AS soft_constraints, CAST(0.8 AS DOUBLE) AS most_surprisal, issue_type, source AS source_tool FROM i""",
    "coloured_diff": f"""
        WITH RECURSIVE {event_queries._RESOLVED},
        y AS (
            SELECT temp_id, 0 AS i, 'name_promotion' AS summary, CASE outcome WHEN 'ontology' THEN 'Promote canonical name from ''' || old_name || ''' to ''' || name || '''.'
                WHEN 'generic_placeholder_upgrade' THEN 'Upgrading generic placeholder ''' || old_name || ''' to specific name ''' || name || '''.'
                ELSE 'Fuzzy match ' || format('{{:.1f}}', score) || '% from generic ''' || old_name || ''' to specific ''' || name || '''.' END AS details FROM resolved WHERE old_name IS NOT NULL
            UNION ALL SELECT temp_id, 1, 'is_new_mismatch', 'Extractor flagged is_new=true but ontology had an exact match.' FROM resolved WHERE is_new_mismatch)
        SELECT 'green' AS colour, 'New entity' AS summary, name || ' (' || type || ')' AS details FROM resolved WHERE outcome = 'new'
        UNION ALL SELECT 'green', CASE event_id % 3 WHEN 0 THEN 'New event' WHEN 1 THEN 'State change' ELSE 'Relationship' END, 'by ' || user_id FROM events
        UNION ALL SELECT 'yellow', summary, details FROM (SELECT * FROM y ORDER BY temp_id, i LIMIT 5)
        UNION ALL SELECT 'red', 'Conflicts', 'Fuzzy match score ' || format('{{:.1f}}', score) || '% exceeds threshold' FROM (SELECT * FROM resolved WHERE outcome = 'conflict' ORDER BY temp_id LIMIT 1)""",
    "released_results": """
        WITH r AS (SELECT conv_id AS run_id, CAST(turn AS BIGINT) AS position, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations WHERE conv_id % 3 = 0 OR turn <> conv_id % 5 + 1)
        SELECT run_id, position FROM r WHERE n = position""",
    "reading_order": "SELECT event_type AS manuscript_id, user_id AS sentence_index, event_id AS position, row_number() OVER (PARTITION BY event_type ORDER BY user_id, event_id) AS place FROM events",
    "word_confidence": f"""
        WITH {_OVERLAY}, c AS (SELECT token_id, count(*) AS n FROM f GROUP BY ALL)
        SELECT token_id, position, coalesce(n, 0) AS issues, CAST({_LEVEL} AS DOUBLE) AS confidence FROM w LEFT JOIN c USING (token_id)""",
    "overall_confidence": f"""
        WITH {_OVERLAY}, c AS (SELECT token_id, count(*) AS n FROM t GROUP BY ALL)
        SELECT count(*) AS words, sum(CAST(round(10 * {_LEVEL}) AS BIGINT)) / (10 * count(*)) AS confidence FROM w LEFT JOIN c USING (token_id)""",
    "overlay_scopes": f"""
        WITH {_OVERLAY},
        s AS (
            SELECT file, item, named AS id FROM i WHERE named IN (SELECT sentence_id FROM w)
            UNION SELECT file, item, sentence_id FROM t JOIN w USING (token_id) WHERE item NOT IN (SELECT item FROM i WHERE named IN (SELECT sentence_id FROM w)))
        SELECT 'word' AS scope, token_id AS id, count(*) AS count FROM f WHERE token_id IN (SELECT token_id FROM w) GROUP BY ALL
        UNION ALL SELECT 'sentence', id, count(*) FROM s GROUP BY ALL
        UNION ALL SELECT 'paragraph', paragraph_id, count(*) FROM i WHERE paragraph_id IN (SELECT paragraph_id FROM w) AND NOT (scout AND item IN (SELECT item FROM s)) GROUP BY ALL""",
    "overlay_missing": f"WITH {_OVERLAY} SELECT token_id, count(*) AS count FROM t WHERE token_id NOT IN (SELECT token_id FROM w) GROUP BY ALL",
    "issue_type_counts": f"WITH {_OVERLAY} SELECT count(*) FILTER (issue_type = 'negative_pacing') AS negative_pacing, count(*) FILTER (issue_type = 'vague_intensity') AS vague_intensity, count(*) FILTER (issue_type = 'ambivalence') AS ambivalence FROM i",
    "manuscript_endings": f"""
        WITH d AS ({METRIC["paragraph_signal_density"]}),
        s AS (
            SELECT manuscript_id, doc_id % 7 AS score, round((doc_id % 5 - 3) / 4 + CASE WHEN doc_id % 2 = 0 THEN 0.25 ELSE 0.0 END, 4) AS s, token_count AS w,
                   row_number() OVER (PARTITION BY manuscript_id ORDER BY doc_id DESC) AS n FROM d),
        e AS (
            SELECT manuscript_id, max(score) FILTER (n = 1) AS final, max(score) FILTER (n = 2) AS previous, round(sum(s * w) FILTER (n > 1) / sum(w) FILTER (n > 1), 6) AS body_sentiment,
                   max(s) FILTER (n = 1) AS final_sentiment FROM s GROUP BY ALL)
        SELECT *, coalesce(final >= 4 AND previous < 4, false) AS hard_cut, coalesce(body_sentiment <= -0.5 AND final_sentiment >= 0.3, false) AS drift FROM e""",
    "highlights": """
        SELECT source AS kind, 'high' AS severity, lang AS message, source AS source_metric FROM documents
        UNION ALL SELECT lang, 'info', source, source FROM documents""",
    "flattened_numbers": """
        SELECT event_id, 'a' AS path, CAST(event_id AS DOUBLE) AS "value" FROM events UNION ALL SELECT event_id, 'b.c', 1.0 FROM events UNION ALL SELECT event_id, 'b.e.f', user_id + 0.5 FROM events""",
    "cleaned_texts": f"""
        WITH d AS (SELECT doc_id, '# H' || chr(10) || '> ' || text || ' ```a `b` c``` *y* [z](u) `q`' AS t FROM documents)
        SELECT doc_id, md5(trim({_cleaned_sql(tx.VOICE_RULES)})) AS voice, md5({_cleaned_sql(tx.SIMILE_RULES)}) AS similes FROM d""",
    "text_lines": r"""
        WITH l AS (SELECT doc_id, unnest(l) AS v, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS l FROM documents))
        SELECT doc_id, n AS line_number, md5(regexp_replace(v, '^\s+|\s+$', '', 'g')) AS line_md5 FROM l WHERE regexp_replace(v, '^\s+|\s+$', '', 'g') <> ''""",
    "numbered_paragraphs": """
        SELECT conv_id AS group_id, turn AS position, CASE WHEN turn % 3 > 0 THEN 'own' || turn ELSE 'paragraph_' || lpad(CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS VARCHAR), 4, '0') END AS paragraph_id FROM conversations""",
    "zipf_means": f"""
        WITH f AS (SELECT DISTINCT word, length(word) % 7 + 0.5 AS z FROM (SELECT unnest({q.APOSTROPHE}) AS word FROM benchmark) WHERE NOT contains(word, '''')),
        t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z][A-Za-z''-]*')) AS word FROM documents),
        m AS (SELECT doc_id, round(avg(CAST(coalesce(z, 0) AS DOUBLE)), 6) AS m FROM t LEFT JOIN f USING (word) GROUP BY ALL)
        SELECT doc_id AS id, coalesce(m, 0.0) AS mean_zipf FROM documents LEFT JOIN m USING (doc_id)""",
    "lateral_terms": """
        WITH l AS (SELECT 'k' || (n_nationkey % 8) AS synset, replace(lower(n_name), '_', ' ') AS word, n_nationkey AS position FROM nation),
        e AS (SELECT DISTINCT 'k' || (n_nationkey % 8) AS child, 'k' || (n_regionkey + 8) AS parent FROM nation),
        m AS (
            SELECT l.word, l.position AS sense, 0 AS side, u.parent AS via, b.child AS other FROM l JOIN e u ON u.child = l.synset JOIN e b USING (parent)
            UNION ALL SELECT l.word, l.position, 1, l.synset, e.child FROM l JOIN e ON e.parent = l.synset),
        f AS (SELECT m.word, t.word AS term, min({'a': sense, 'b': side, 'c': via, 'd': other, 'e': t.position}) AS place FROM m JOIN l t ON t.synset = other WHERE t.word <> m.word GROUP BY ALL)
        SELECT word, term, row_number() OVER (PARTITION BY word ORDER BY place, term) AS rank FROM f QUALIFY rank <= 6""",
    "band_candidates": f"""
        WITH t AS ({METRIC["term_frequency"]}), w AS (SELECT word FROM t ORDER BY count DESC, word LIMIT 20),
        v AS (SELECT DISTINCT word AS term, length(word) * 0.45 AS z FROM (SELECT unnest({q.APOSTROPHE}) AS word FROM benchmark)),
        r AS (SELECT * FROM v WHERE z < 5.0 AND term NOT IN (SELECT word FROM t WHERE count > 1))
        SELECT word, term, row_number() OVER (PARTITION BY word ORDER BY z DESC, term) AS rank FROM w JOIN r ON word <> term QUALIFY rank <= 10""",
    "drift_candidates": """
        WITH v AS (SELECT vec_id, 'w' || vec_id AS w, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        m AS (SELECT a.w AS word, b.w AS term, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM v a JOIN v b ON a.w <> b.w WHERE a.vec_id < 5 AND b.vec_id % 4 <= 1)
        SELECT *, row_number() OVER (PARTITION BY word ORDER BY cosine DESC, term) AS rank FROM m QUALIFY rank <= 3""",
}
