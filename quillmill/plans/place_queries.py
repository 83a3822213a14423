"""Queries of places, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as tx
from quillmill.operators import lexical, places, segments, windows
from quillmill.operators.lexical import paragraphs
from quillmill.plans import sqltext as q
from quillmill.plans.finding_queries import _CHUNKS, _cleaned
from quillmill.plans.metric_queries import ORACLE_SQL as METRIC
from quillmill.sources.tables import table


def word_ranks(spark: SparkSession, d: str) -> DataFrame:
    words = places.ranked_words(lexical.term_frequency(table(spark, d, "documents")))
    return places.without(words, spark.sql("SELECT * FROM VALUES ('the'), ('la') AS t(word)"))


def word_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return places.word_paragraphs(docs, places.ranked_words(lexical.term_frequency(docs)))


def blank_line_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return places.blank_line_paragraphs(paragraphs(table(spark, d, "documents")))


def line_of(spark: SparkSession, d: str) -> DataFrame:
    docs = paragraphs(table(spark, d, "documents"))
    return places.line_of(docs, docs.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.char_length("text").cast("long"), F.lit(100).cast("long"))).alias("position")))


def tail_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    rows = paragraphs(table(spark, d, "documents"))
    return places.tails(rows, lexical.signal_density(rows).withColumnRenamed("lexical_density", "score"))


def whole_word_counts(spark: SparkSession, d: str) -> DataFrame:
    return places.whole_word_counts(table(spark, d, "documents"), ["the", "of", "la", "und"])


def chunk_ranges(spark: SparkSession, d: str) -> DataFrame:
    chunks = segments.sentence_chunks(paragraphs(table(spark, d, "documents")))
    return places.chunk_ranges(chunks.select(F.col("doc_id").alias("group_id"), F.col("chunk_index").alias("chunk"), F.col("words").alias("n")))


def missing_ids(spark: SparkSession, d: str) -> DataFrame:
    return places.missing_ids(table(spark, d, "events").select(F.col("user_id").alias("id")), table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id")), "id")


def window_anchors(spark: SparkSession, d: str) -> DataFrame:
    words = windows.placed(paragraphs(table(spark, d, "documents")), tx.letter_tokens(F.col("text")))
    return places.window_anchor(words, 500, 250)


QUERIES = {f.__name__: f for f in (word_ranks, word_paragraphs, blank_line_paragraphs, line_of, tail_paragraphs, whole_word_counts, chunk_ranges, missing_ids, window_anchors)}

_RANKS = f"w AS (SELECT *, row_number() OVER (ORDER BY count DESC, word) AS rank FROM (SELECT word, count(*) AS count FROM (SELECT unnest({q.APOSTROPHE}) AS word FROM documents) GROUP BY word) QUALIFY rank <= 100)"

ORACLE_SQL = {
    "chunk_ranges": f"""
        WITH RECURSIVE {_CHUNKS}
        SELECT doc_id AS group_id, chunk_index AS chunk, CAST(sum(words) OVER w - words AS BIGINT) AS first_token, CAST(sum(words) OVER w - 1 AS BIGINT) AS last_token
        FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)""",
    "word_ranks": f"WITH {_RANKS} SELECT word, count, rank FROM w WHERE word NOT IN ('the', 'la')",
    "word_paragraphs": f"""
        WITH {_RANKS}, t AS (SELECT doc_id, unnest({q.APOSTROPHE}) AS word FROM documents),
        c AS (SELECT word, doc_id, count(*) AS count FROM t WHERE word IN (SELECT word FROM w) GROUP BY ALL)
        SELECT *, row_number() OVER (PARTITION BY word ORDER BY doc_id) AS n FROM c QUALIFY n <= 3""",
    "blank_line_paragraphs": f"""
        WITH l AS (SELECT doc_id, unnest(l) AS v, unnest(range(0, len(l))) AS line FROM (
            SELECT doc_id, string_split({_cleaned().replace("translate(text, '’‘—–', '''''--')", "text")}, chr(10)) AS l FROM documents)),
        g AS (SELECT *, sum(CAST(v = '' AS BIGINT)) OVER (PARTITION BY doc_id ORDER BY line) AS gap FROM l),
        r AS (SELECT doc_id, gap, CAST(min(line) AS BIGINT) AS first_line, count(*) AS lines, sha256(string_agg(v, chr(10) ORDER BY line)) AS content_hash FROM g WHERE v <> '' GROUP BY ALL)
        SELECT doc_id, first_line, lines, content_hash, row_number() OVER (PARTITION BY doc_id ORDER BY first_line) AS paragraph FROM r""",
    "line_of": """
        WITH l AS (SELECT doc_id, unnest(l) AS v, unnest(range(0, len(l))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
        s AS (SELECT doc_id, line, coalesce(sum(length(v) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)
        SELECT doc_id, CAST(k AS BIGINT) AS position, CAST(max(line) AS BIGINT) AS line
        FROM s JOIN (SELECT doc_id, unnest(range(0, length(text) + 1, 100)) AS k FROM documents) USING (doc_id) WHERE start <= k GROUP BY ALL""",
    "tail_paragraphs": f"""
        WITH d AS ({METRIC["paragraph_signal_density"]}),
        e AS (SELECT manuscript_id, doc_id, lexical_density AS score, row_number() OVER (PARTITION BY manuscript_id ORDER BY doc_id DESC) AS from_end FROM d QUALIFY from_end <= 2)
        SELECT *, lag(score) OVER (PARTITION BY manuscript_id ORDER BY doc_id) AS before FROM e""",
    "whole_word_counts": f"""
        WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda x: lower(x)) AS w FROM documents)
        SELECT doc_id, {", ".join(f"CAST(len(list_filter(w, lambda x: x = '{w}')) AS BIGINT) AS n_{w}" for w in ("the", "of", "la", "und"))} FROM w""",
    "missing_ids": "SELECT user_id AS id, count(*) AS count FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) GROUP BY ALL",
    "window_anchors": f"""
        WITH {q.tokens("t", q.LETTERS)},
        z AS (SELECT manuscript_id, doc_id, count(*) AS n FROM t GROUP BY ALL),
        o AS (SELECT doc_id, coalesce(sum(n) OVER (PARTITION BY manuscript_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM z),
        tot AS (SELECT manuscript_id, CAST(sum(n) AS BIGINT) AS total FROM z GROUP BY ALL),
        g AS (SELECT t.manuscript_id, doc_id, CAST(start + pos AS BIGINT) AS gpos FROM t JOIN o USING (doc_id)),
        w AS (SELECT manuscript_id, k AS "window", k * 250 AS a, least(k * 250 + 500, total) AS b
              FROM tot, LATERAL (SELECT unnest(range(0, greatest(0, CAST(ceil((total - 500) / 250) AS BIGINT)) + 1)) AS k) AS u),
        m AS (SELECT w.manuscript_id, "window", a, b, doc_id AS anchor FROM w JOIN g ON g.manuscript_id = w.manuscript_id AND gpos = (a + b) // 2)
        SELECT m.manuscript_id, "window", anchor, count(*) AS tokens, min(gpos) AS first_token, max(gpos) AS last_token
        FROM m JOIN g ON g.manuscript_id = m.manuscript_id AND g.doc_id = anchor AND gpos >= a AND gpos < b GROUP BY ALL""",
}
