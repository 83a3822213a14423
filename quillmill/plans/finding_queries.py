"""Queries of segments, findings, overlays, comparisons and similarity, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import lexicons as lx
from quillmill.functions import text as tx
from quillmill.operators import findings as op
from quillmill.operators import learned, lexical, segments, similarity
from quillmill.operators.lexical import paragraphs
from quillmill.plans import sqltext as q
from quillmill.plans.metric_queries import ORACLE_SQL as METRIC
from quillmill.sources.tables import table

#: Phrases that the driver's texts hold, beside the fixed ones.
PHRASES = [*lx.LOW_SIGNAL_PHRASES, *lx.HEDGES, "of the", "licensed under", "and. the"]
HEDGES = [*lx.HEDGES, "of the"]
#: The cosine from which the driver's vectors count as echoes.
ECHO = 0.4


def _over(f, *args, **kw):
    return lambda spark, d: f(paragraphs(table(spark, d, "documents")), *args, **kw)


def _vectors(f, *args):
    return lambda spark, d: f(table(spark, d, "embeddings"), *args)


def slop_reasons(spark: SparkSession, d: str) -> DataFrame:
    rows = paragraphs(table(spark, d, "documents"))
    return op.slop_reasons(rows, op.overused_words(rows), PHRASES, HEDGES)


def issue_bundle(spark: SparkSession, d: str) -> DataFrame:
    rows = paragraphs(table(spark, d, "documents"))
    return op.bundle(rows, op.issues(rows, op.overused_words(rows)))


def confidence_overlay(spark: SparkSession, d: str) -> DataFrame:
    return op.confidence_overlay(op.token_findings(paragraphs(table(spark, d, "documents"))))


def scope_counts(spark: SparkSession, d: str) -> DataFrame:
    return op.scope_counts(op.token_findings(paragraphs(table(spark, d, "documents"))))


def _pair(rows: DataFrame) -> list[str]:
    """The two manuscripts that are compared: the first two by name."""
    return [r[0] for r in rows.select("manuscript_id").distinct().orderBy("manuscript_id").limit(2).collect()] + [""] * 2


def metric_delta(spark: SparkSession, d: str) -> DataFrame:
    rows = paragraphs(table(spark, d, "documents"))
    a, b, *_ = _pair(rows)
    return op.metric_delta(op.flattened(op.run_metrics(rows.filter(F.col("manuscript_id").isin(a, b)))), a, b)


def new_resolved_highlights(spark: SparkSession, d: str) -> DataFrame:
    rows = paragraphs(table(spark, d, "documents"))
    a, b, *_ = _pair(rows)
    highlights = lexical.themes(rows.filter(F.col("manuscript_id").isin(a, b))).select("manuscript_id", F.concat(F.lit("themes|"), "theme").alias("highlight"))
    return op.changed(highlights, a, b)


def trend_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = paragraphs(table(spark, d, "documents"))
    a, b, *_ = _pair(rows)
    runs = op.run_metrics(rows)
    return op.trend(runs.filter(F.col("run_id") != b), runs.filter(F.col("run_id").isin(a, b))).select("run_id", "document_entropy", "mean_surprisal", "average_lexical_density")


def markdown_clean(spark: SparkSession, d: str) -> DataFrame:
    text = tx.clean_markdown(tx.fold_punctuation(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.sha2(text, 256).alias("content_hash"), F.char_length(text).cast("long").alias("n_chars"))


def span_tokens(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    spans = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.floor(F.char_length("text") / 60).cast("int"))).alias("k"))
    spans = spans.select("doc_id", F.col("k").cast("long").alias("span_id"), (F.col("k") * 60 + 10).cast("long").alias("span_start"), (F.col("k") * 60 + 40).cast("long").alias("span_end"))
    return segments.span_tokens(segments.token_offsets(paragraphs(docs)), spans)


def issue_alignment(spark: SparkSession, d: str) -> DataFrame:
    chunks = segments.sentence_chunks(paragraphs(table(spark, d, "documents")))
    issues = chunks.select("doc_id", "chunk_index", F.explode(F.array(*[F.lit(k).cast("long") for k in (0, 2, 99)])).alias("local_index"))
    return segments.aligned(chunks, issues)


def density_compare(spark: SparkSession, d: str) -> DataFrame:
    rows = paragraphs(table(spark, d, "documents"))

    def density(name: str) -> DataFrame:
        each = lexical.exploded(rows.filter(F.col("manuscript_id") == name), tx.tokens(F.col("text")))
        counts = each.groupBy("token").agg(F.count("*").alias("c"))
        total = counts.agg(F.sum("c")).first()[0] or 1
        return counts.filter(F.length("token") >= 3).select(F.col("token").alias("name"), (F.col("c") / total * 1000).alias("density"))

    a, b, *_ = _pair(rows)
    return op.compared_densities(density(a), density(b))


def sentence_hashes(spark: SparkSession, d: str) -> DataFrame:
    return segments.sentences(paragraphs(table(spark, d, "documents")))


QUERIES = {
    "near_dup_pairs": _over(similarity.near_duplicate_pairs),
    "near_dup_clusters": _over(similarity.near_duplicate_clusters),
    "lexicon_hits": _over(op.phrase_hits, PHRASES),
    "slop_reasons": slop_reasons,
    "reason_counts": lambda spark, d: op.reason_counts(slop_reasons(spark, d)),
    "lexicon_score": _over(op.ending_score),
    "sentiment": _over(op.sentiment, ["the", "of"], ["and", "in"], ["to", "on"]),
    "percentile_flags": _over(op.percentile_flags, HEDGES),
    "issue_bundle": issue_bundle,
    "confidence_overlay": confidence_overlay,
    "scope_counts": scope_counts,
    "metric_delta": metric_delta,
    "new_resolved_highlights": new_resolved_highlights,
    "trend_rows": trend_rows,
    "density_compare": density_compare,
    "markdown_clean": markdown_clean,
    "sentences": sentence_hashes,
    "sentence_chunks": _over(segments.sentence_chunks),
    "issue_alignment": issue_alignment,
    "paragraph_links": _over(segments.links),
    "word_chunks": _over(segments.word_chunks),
    "chapter_chunks": _over(segments.line_chunks),
    "chapter_or_word_chunks": _over(segments.chapter_chunks),
    "manuscript_chunks": _over(segments.manuscript_chunks, 500),
    "cluster_report": _over(similarity.cluster_report),
    "span_tokens": span_tokens,
    "echo_pairs": _vectors(similarity.echo_pairs, ECHO),
    "redundancy": _vectors(similarity.redundancy, ECHO),
    "topic_shift": _vectors(similarity.topic_shift),
    "linkage_clusters": _vectors(learned.linkage_clusters, ECHO),
    "lda_topics": _over(learned.lda_topics),
}

_PAIRS = f"""
    o AS (SELECT source AS manuscript_id, doc_id, list_distinct(own) AS t,
                 list_distinct(list_transform(range(1, len(own)), lambda i: own[i] || ' ' || own[i + 1])) AS g
          FROM (SELECT source, doc_id, {q.CONTENT} AS own FROM documents) WHERE len(own) >= {lx.LEAST_TOKENS}),
    x AS (SELECT a.manuscript_id, a.doc_id AS left_id, b.doc_id AS right_id, len(list_intersect(a.t, b.t)) AS nt, len(list_intersect(a.g, b.g)) AS ng,
                 len(a.t) + len(b.t) AS st, len(a.g) + len(b.g) AS sg
          FROM o a JOIN o b ON a.manuscript_id = b.manuscript_id AND a.doc_id < b.doc_id),
    y AS (SELECT *, nt / (st - nt) * 0.7 + ng / (sg - ng) * 0.3 AS s FROM x),
    pairs AS (SELECT manuscript_id, left_id, right_id, round(s, 4) AS similarity FROM y WHERE s >= {lx.PAIR_SIMILARITY} AND nt >= {lx.PAIR_SHARED})"""


def _contains(phrases: list[str]) -> str:
    return f"list_filter([{q.words(phrases)}], lambda p: contains(lower(text), p))"


_STRIPPED = """list_distinct(list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: lower(regexp_replace(w, '^[.,;:!?"''()]+|[.,;:!?"''()]+$', '', 'g'))), lambda w: w <> ''))"""
_OVERUSED = f"u AS (SELECT list(word) AS words FROM (SELECT word, count(*) AS c FROM (SELECT unnest({q.APOSTROPHE}) AS word FROM documents) WHERE length(word) >= 4 GROUP BY word ORDER BY c DESC, word LIMIT 20))"


def _slop(phrases: list[str], hedges: list[str]) -> str:
    return f"""
        SELECT source AS manuscript_id, doc_id,
               concat_ws(',', CASE WHEN a > 0 THEN 'low_signal_phrase' END, CASE WHEN b > 0 THEN 'hedge_density' END, CASE WHEN c >= 2 THEN 'lexical_overuse_cluster' END) AS reasons,
               CAST(a AS BIGINT) AS phrase_hits, CAST(b AS BIGINT) AS hedge_hits, CAST(c AS BIGINT) AS overused_hits
        FROM (SELECT source, doc_id, len({_contains(phrases)}) AS a, len({_contains(hedges)}) AS b, len(list_intersect({_STRIPPED}, words)) AS c FROM documents, u)
        WHERE a > 0 OR b > 0 OR c >= 2"""


_FINDERS = f"""
    {q.tokens("t", q.APOSTROPHE)},
    f AS (
        SELECT manuscript_id, doc_id, pos, list_filter([CASE WHEN length(token) <= 2 THEN 'short' END, CASE WHEN length(token) >= 12 THEN 'long' END,
               CASE WHEN token IN ({q.words(lx.STOPWORDS)}) THEN 'function' END,
               CASE WHEN token = lag(token) OVER (PARTITION BY doc_id ORDER BY pos) THEN 'repeated' END], lambda x: x IS NOT NULL) AS finders FROM t)"""

_RUNS = f"""
    e AS ({METRIC["document_entropy"]}), s AS ({METRIC["paragraph_surprisal"]}), d AS ({METRIC["paragraph_signal_density"]}),
    runs AS (
        SELECT manuscript_id AS run_id, document_entropy, token_count, mean_surprisal, average_lexical_density FROM e
        LEFT JOIN (SELECT manuscript_id, round(avg(adjusted_surprisal), 4) AS mean_surprisal FROM s WHERE token_count >= {lx.LEAST_TOKENS} GROUP BY ALL) USING (manuscript_id)
        LEFT JOIN (SELECT manuscript_id, round(avg(lexical_density), 4) AS average_lexical_density FROM d GROUP BY ALL) USING (manuscript_id))"""

_SENTENCES = "list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s) <> '')"


def _cleaned() -> str:
    line = "l"
    for pattern, to in tx.LINE_RULES:
        line = f"regexp_replace({line}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    text = "translate(text, '’‘—–', '''''--')"
    return f"array_to_string(list_transform(string_split(regexp_replace({text}, '(?s)```.*?```', '', 'g'), chr(10)), lambda l: trim({line})), chr(10))"


_CHUNKS = f"""
    n AS (SELECT doc_id, list_transform({_SENTENCES}, lambda s: len(list_filter(regexp_split_to_array(s, '\\s+'), lambda x: x <> ''))) AS n FROM documents),
    r(doc_id, i, words, chunk) AS (
        SELECT doc_id, 1, greatest(n[1], 1), 1 FROM n WHERE len(n) > 0
        UNION ALL
        SELECT r.doc_id, i + 1, CASE WHEN words + n[i + 1] > 120 THEN 0 ELSE words END + greatest(n[i + 1], 1), CASE WHEN words + n[i + 1] > 120 THEN chunk + 1 ELSE chunk END
        FROM r JOIN n USING (doc_id) WHERE i < len(n)),
    c AS (
        SELECT doc_id, CAST(chunk AS BIGINT) AS chunk_index, count(*) AS sentence_count, CAST(sum(n[i]) AS BIGINT) AS words, CAST(min(i) AS BIGINT) AS first_sentence, CAST(max(i) AS BIGINT) AS last_sentence
        FROM r JOIN n USING (doc_id) GROUP BY ALL)"""

_ECHO = f"""
    v AS (SELECT vec_id, label AS group_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    c AS (SELECT a.group_id, a.vec_id AS left_id, b.vec_id AS right_id, list_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.group_id = b.group_id AND a.vec_id < b.vec_id),
    pairs AS (SELECT group_id, left_id, right_id, round(c, 6) AS similarity FROM c WHERE c >= {ECHO})"""

_FIRST, _SECOND = ("(SELECT min(source) FROM documents)", "(SELECT min(source) FROM documents WHERE source > (SELECT min(source) FROM documents))")

ORACLE_SQL = {
    "near_dup_pairs": f"WITH {_PAIRS} SELECT * FROM pairs",
    "near_dup_clusters": f"""
        WITH RECURSIVE {_PAIRS},
        e AS (SELECT manuscript_id, left_id AS a, right_id AS b FROM pairs UNION SELECT manuscript_id, right_id, left_id FROM pairs),
        w(manuscript_id, node, reach) AS (SELECT manuscript_id, a, a FROM e UNION SELECT w.manuscript_id, node, b FROM w JOIN e ON reach = a),
        k AS (SELECT manuscript_id, node, min(reach) AS cluster_id FROM w GROUP BY ALL)
        SELECT manuscript_id, cluster_id, count(*) AS cluster_size, array_to_string(list(node ORDER BY node), ',') AS members FROM k GROUP BY ALL""",
    "cluster_report": f"""
        WITH RECURSIVE {_PAIRS},
        edges AS (SELECT manuscript_id, left_id AS a, right_id AS b FROM pairs UNION SELECT manuscript_id, right_id, left_id FROM pairs),
        walk(manuscript_id, node, reach) AS (SELECT manuscript_id, a, a FROM edges UNION SELECT walk.manuscript_id, node, b FROM walk JOIN edges ON reach = a),
        members AS (SELECT manuscript_id, node, min(reach) AS cluster_id FROM walk GROUP BY ALL),
        texts AS (SELECT members.*, text, list_distinct({q.CONTENT}) AS own FROM members JOIN documents ON doc_id = node),
        sized AS (SELECT manuscript_id, cluster_id, count(*) AS cluster_size, min({{'n': node, 't': substr(text, 1, 220)}}).t AS example FROM texts GROUP BY ALL),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY manuscript_id ORDER BY cluster_size DESC, cluster_id) AS rank FROM sized QUALIFY rank <= 12),
        often AS (SELECT cluster_id, token, count(*) AS n FROM (SELECT cluster_id, unnest(own) AS token FROM texts) GROUP BY ALL HAVING count(*) >= 2),
        first AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, token) AS place FROM often QUALIFY place <= 6),
        named AS (SELECT cluster_id, string_agg(token, ',' ORDER BY place) AS shared_tokens FROM first GROUP BY cluster_id)
        SELECT ranked.*, coalesce(shared_tokens, '') AS shared_tokens FROM ranked LEFT JOIN named USING (cluster_id)""",
    "lexicon_hits": f"SELECT source AS manuscript_id, doc_id, unnest({_contains(PHRASES)}) AS phrase FROM documents",
    "slop_reasons": f"WITH {_OVERUSED} {_slop(PHRASES, HEDGES)}",
    "reason_counts": f"""
        WITH {_OVERUSED}, s AS ({_slop(PHRASES, HEDGES)})
        SELECT manuscript_id, reason, count(*) AS count FROM (SELECT manuscript_id, unnest(string_split(reasons, ',')) AS reason FROM s) GROUP BY ALL""",
    "lexicon_score": f"""
        SELECT *, nouns + adjectives + 2 * phrases + 3 * patterns AS score FROM (
            SELECT source AS manuscript_id, doc_id, CAST(len(list_filter({q.APOSTROPHE}, lambda x: x IN ({q.words(lx.ABSTRACT_NOUNS)}))) AS BIGINT) AS nouns,
                   CAST(len(list_filter({q.APOSTROPHE}, lambda x: x IN ({q.words(lx.VAGUE_ADJECTIVES)}))) AS BIGINT) AS adjectives,
                   CAST(len({_contains(lx.ENDING_PHRASES)}) AS BIGINT) AS phrases,
                   {" + ".join(f"CAST(regexp_matches(text, '(?i){p.replace(chr(39), chr(39) * 2)}') AS BIGINT)" for p in lx.ENDING_PATTERNS)} AS patterns FROM documents)""",
    "sentiment": f"""
        WITH o AS (SELECT source AS manuscript_id, doc_id, {q.APOSTROPHE} AS own FROM documents),
        n AS (SELECT *, len(own) AS n, len(list_filter(own, lambda x: x IN ('the', 'of'))) - len(list_filter(own, lambda x: x IN ('and', 'in'))) AS s,
              len(list_filter(own, lambda x: x IN ('to', 'on'))) AS a FROM o),
        r AS (SELECT manuscript_id, doc_id, round(CASE WHEN n > 0 THEN s / n ELSE 0.0 END, 6) AS sentiment, round(CASE WHEN n > 0 THEN a / n ELSE 0.0 END, 6) AS ambivalence FROM n)
        SELECT *, ambivalence >= 0.08 AS is_ambivalent FROM r""",
    "percentile_flags": f"""
        WITH s AS (SELECT manuscript_id, doc_id, -surprisal AS v FROM ({METRIC["paragraph_surprisal"]}) WHERE token_count >= 2),
        b AS (SELECT manuscript_id, quantile_cont(v, 0.9) AS p90, quantile_cont(v, 0.97) AS p97 FROM s GROUP BY ALL),
        h AS (SELECT doc_id, len({_contains(HEDGES)}) > 0 AS has_turn FROM documents)
        SELECT manuscript_id, doc_id, v AS avg_logprob, round(p90, 6) AS threshold, round(p97, 6) AS outlier_threshold,
               CASE WHEN has_turn THEN 'high_logprob_plus_transition' ELSE 'high_logprob_extreme_outlier' END AS reason, CASE WHEN has_turn THEN 'medium' ELSE 'low' END AS severity
        FROM s JOIN b USING (manuscript_id) JOIN h USING (doc_id) WHERE v >= p90 AND (has_turn OR v >= p97)""",
    "issue_bundle": f"""
        WITH {_OVERUSED}, d AS ({METRIC["density_issues"]}), s AS ({_slop(lx.LOW_SIGNAL_PHRASES, lx.HEDGES)}),
        i AS (SELECT doc_id, 'density:' || unnest(string_split(reason, ',')) AS x FROM d UNION ALL SELECT doc_id, 'slop:' || unnest(string_split(reasons, ',')) FROM s),
        b AS (SELECT doc_id, count(*) AS n, array_to_string(list(x ORDER BY x), ',') AS l FROM i GROUP BY ALL)
        SELECT source AS manuscript_id, doc_id, coalesce(n, 0) AS issue_count, coalesce(l, '') AS issues FROM documents LEFT JOIN b USING (doc_id)""",
    "confidence_overlay": f"""
        WITH {_FINDERS}
        SELECT manuscript_id, doc_id, count(*) AS tokens, count(*) FILTER (len(finders) > 0) AS marked,
               sum(CASE len(finders) WHEN 0 THEN 10 WHEN 1 THEN 8 WHEN 2 THEN 6 WHEN 3 THEN 4 ELSE 2 END) / (10 * count(*)) AS confidence
        FROM f GROUP BY ALL""",
    "scope_counts": f"""
        WITH {_FINDERS}
        SELECT finder, count(*) AS words, count(DISTINCT doc_id) AS paragraphs FROM (SELECT doc_id, unnest(finders) AS finder FROM f) GROUP BY ALL""",
    "metric_delta": f"""
        WITH {_RUNS},
        l AS (UNPIVOT (SELECT run_id, document_entropy, CAST(token_count AS DOUBLE) AS token_count, mean_surprisal, average_lexical_density FROM runs)
              ON document_entropy, token_count, mean_surprisal, average_lexical_density INTO NAME metric VALUE "value")
        SELECT metric, round(b."value", 6) AS baseline, round(c."value", 6) AS current, round(c."value" - b."value", 6) AS delta
        FROM l b JOIN l c USING (metric) WHERE b.run_id = {_FIRST} AND c.run_id = {_SECOND}""",
    "new_resolved_highlights": f"""
        WITH t AS ({METRIC["themes_all"]}),
        c AS (SELECT 'themes|' || theme AS highlight FROM t WHERE manuscript_id = {_SECOND}), b AS (SELECT 'themes|' || theme AS highlight FROM t WHERE manuscript_id = {_FIRST})
        SELECT highlight, 'new' AS state FROM (SELECT * FROM c EXCEPT SELECT * FROM b)
        UNION ALL SELECT highlight, 'resolved' FROM (SELECT * FROM b EXCEPT SELECT * FROM c)""",
    "trend_rows": f"WITH {_RUNS} SELECT run_id, document_entropy, mean_surprisal, average_lexical_density FROM runs",
    "density_compare": f"""
        WITH {q.tokens("t", q.TOKENS)},
        n AS (SELECT manuscript_id, token, count(*) AS c FROM t WHERE manuscript_id IN ({_FIRST}, {_SECOND}) GROUP BY ALL),
        c AS (SELECT *, sum(c) OVER (PARTITION BY manuscript_id) AS total FROM n),
        d AS (SELECT manuscript_id, token AS name, c / total * 1000 AS density FROM c WHERE length(token) >= 3),
        j AS (SELECT name, coalesce(a.density, 0.0) AS a, coalesce(b.density, 0.0) AS b FROM (SELECT * FROM d WHERE manuscript_id = {_FIRST}) a
              FULL JOIN (SELECT * FROM d WHERE manuscript_id = {_SECOND}) b USING (name)),
        x AS (SELECT *, greatest(a, b) AS most, CASE WHEN greatest(a, b) > 0 THEN abs(a - b) / greatest(a, b) ELSE 0.0 END AS d FROM j)
        SELECT name, round(a, 6) AS left_density, round(b, 6) AS right_density, round(d, 6) AS difference, most > 0 AND d <= 0.1 AS is_collision FROM x""",
    "markdown_clean": f"SELECT doc_id, sha256(c) AS content_hash, length(c) AS n_chars FROM (SELECT doc_id, {_cleaned()} AS c FROM documents)",
    "sentences": f"""
        SELECT doc_id, CAST(i AS BIGINT) AS sentence_index, s AS sentence FROM (
            SELECT doc_id, unnest(l) AS s, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {_SENTENCES} AS l FROM documents))""",
    "sentence_chunks": f"WITH RECURSIVE {_CHUNKS} SELECT * FROM c",
    "issue_alignment": f"""
        WITH RECURSIVE {_CHUNKS}
        SELECT doc_id, chunk_index, CAST(l AS BIGINT) AS local_index, least(greatest(first_sentence + l - 1, first_sentence), last_sentence) AS sentence_index
        FROM c, (SELECT unnest([0, 2, 99]) AS l)""",
    "paragraph_links": """
        WITH n AS (SELECT source AS manuscript_id, doc_id, length(text) AS size, row_number() OVER w AS paragraph_index,
                          CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char
                   FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)),
        p AS (SELECT *, manuscript_id || '-p' || CASE WHEN paragraph_index < 10000 THEN lpad(CAST(paragraph_index AS VARCHAR), 4, '0') ELSE CAST(paragraph_index AS VARCHAR) END AS paragraph_id FROM n)
        SELECT manuscript_id, doc_id, paragraph_index, paragraph_id, lag(paragraph_id) OVER w AS prev_id, lead(paragraph_id) OVER w AS next_id, start_char, start_char + size AS end_char
        FROM p WINDOW w AS (PARTITION BY manuscript_id ORDER BY doc_id)""",
    "word_chunks": """
        WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS w FROM documents),
        k AS (SELECT doc_id, w, unnest(range(0, (len(w) - 1) // 200 + 1)) AS k FROM w WHERE len(w) > 0)
        SELECT doc_id, 'Chunk ' || (k + 1) AS label, CAST(len(w[k * 200 + 1:k * 200 + 200]) AS BIGINT) AS word_count, array_to_string(w[k * 200 + 1:k * 200 + 200], ' ') AS chunk FROM k""",
    "chapter_chunks": """
        WITH l AS (SELECT doc_id, unnest(l) AS v, unnest(range(0, len(l))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
        s AS (SELECT *, starts_with(trim(v), '#') AS h, CAST(sum(CAST(starts_with(trim(v), '#') AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) AS section FROM l)
        SELECT doc_id, section, coalesce(max(CASE WHEN h THEN trim(v) END), 'Chapter 1') AS label, count(*) AS lines, sha256(string_agg(v, chr(10) ORDER BY line)) AS content_hash FROM s GROUP BY ALL""",
    "chapter_or_word_chunks": r"""
        WITH l AS (SELECT doc_id, unnest(l) AS v, unnest(range(0, len(l))) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS l FROM documents)),
        s AS (SELECT *, starts_with(trim(v), '#') AS h, CAST(sum(CAST(starts_with(trim(v), '#') AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY line) AS BIGINT) AS section FROM l),
        c AS (SELECT doc_id, section, coalesce(max(CASE WHEN h THEN trim(v) END), 'Chapter 1') AS label, regexp_replace(string_agg(v, chr(10) ORDER BY line), '^\s+|\s+$', '', 'g') AS body FROM s GROUP BY ALL),
        n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS parts, row_number() OVER (PARTITION BY doc_id ORDER BY section) - 1 AS chunk FROM c),
        w AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM n WHERE parts = 1)),
        k AS (SELECT doc_id, w, unnest(range(0, (len(w) - 1) // 200 + 1)) AS k FROM w WHERE len(w) > 0)
        SELECT doc_id, chunk, label, CAST(len(regexp_extract_all(body, '[\p{L}\p{N}_]+')) AS BIGINT) AS word_count, sha256(body) AS content_hash FROM n WHERE parts > 1
        UNION ALL SELECT doc_id, k, 'Chunk ' || (k + 1), len(w[k * 200 + 1:k * 200 + 200]), sha256(array_to_string(w[k * 200 + 1:k * 200 + 200], ' ')) FROM k""",
    "manuscript_chunks": r"""
        WITH w AS (SELECT source, doc_id, unnest(w) AS w, unnest(range(0, len(w))) AS i FROM (SELECT source, doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS w FROM documents)),
        n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS g FROM w)
        SELECT source AS manuscript_id, g // 500 AS chunk, 'Chunk ' || (g // 500 + 1) AS label, count(*) AS word_count, min(g) AS start_token, max(g) AS end_token, min(doc_id) AS first_paragraph, max(doc_id) AS last_paragraph,
               sha256(string_agg(w, ' ' ORDER BY g)) AS content_hash FROM n GROUP BY ALL""",
    "span_tokens": """
        WITH p AS (SELECT doc_id, unnest(l) AS piece, unnest(range(0, len(l))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z'']+|[^A-Za-z'']+') AS l FROM documents)),
        o AS (SELECT *, CAST(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS fin FROM p),
        t AS (SELECT doc_id, i, piece AS token, fin - length(piece) AS start, fin FROM o WHERE regexp_matches(piece, '^[A-Za-z'']')),
        s AS (SELECT doc_id, k AS span_id, k * 60 + 10 AS a, k * 60 + 40 AS b FROM (SELECT doc_id, unnest(range(0, length(text) // 60 + 1)) AS k FROM documents))
        SELECT doc_id, span_id, count(*) AS tokens, min(start) AS first_char, max(fin) AS last_char, string_agg(token, ' ' ORDER BY i) AS words
        FROM t JOIN s USING (doc_id) WHERE fin > a AND start < b GROUP BY ALL""",
    "echo_pairs": f"WITH {_ECHO} SELECT * FROM pairs",
    "redundancy": f"""
        WITH {_ECHO},
        e AS (SELECT group_id, count(DISTINCT x) AS n FROM (SELECT group_id, unnest([left_id, right_id]) AS x FROM pairs) GROUP BY ALL),
        a AS (SELECT label AS group_id, count(*) AS vectors FROM embeddings GROUP BY ALL),
        s AS (SELECT group_id, vectors, coalesce(n, 0) AS echoing, 100 * coalesce(n, 0) / vectors AS share FROM a LEFT JOIN e USING (group_id))
        SELECT group_id, vectors, echoing, round(share, 4) AS redundancy, round(greatest(0.0, 100 - share), 4) AS semantic_entropy FROM s""",
    "topic_shift": """
        WITH v AS (SELECT label AS group_id, vec_id, CAST(embedding AS DOUBLE[]) AS v, CAST(lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS DOUBLE[]) AS b FROM embeddings),
        d AS (SELECT group_id, vec_id, round(list_sum(list_transform(range(1, len(v) + 1), lambda i: abs(v[i] - b[i]))), 6) AS distance FROM v WHERE b IS NOT NULL)
        SELECT *, distance >= 0.45 AS is_shift FROM d""",
}
