"""Queries of corpus metrics over ``documents``, with DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import lexicons as lx
from quillmill.operators import lexical as op
from quillmill.operators import windows as win
from quillmill.plans import sqltext as q
from quillmill.sources.tables import table


def _over(f, *args, **kw):
    return lambda spark, d: f(op.paragraphs(table(spark, d, "documents")), *args, **kw)


def _against(spark: SparkSession, d: str) -> DataFrame:
    return op.frequency_against(table(spark, d, "documents"), table(spark, d, "benchmark"))


def _themes_tokens(spark: SparkSession, d: str) -> DataFrame:
    return op.theme_tokens(op.paragraphs(table(spark, d, "documents")))


QUERIES = {
    "paragraph_entropy": _over(op.paragraph_entropy),
    "document_entropy": _over(op.document_entropy),
    "paragraph_signal_density": _over(op.signal_density),
    "low_density_topk": _over(op.low_density),
    "paragraph_surprisal": _over(op.surprisal),
    "surprisal_topk": _over(op.surprisal_top),
    "themes_tokens": _themes_tokens,
    "themes_all": _over(op.themes),
    "repeated_bigrams": _over(op.repeated_patterns, 2),
    "repeated_trigrams": _over(op.repeated_patterns, 3),
    "paragraph_bursts": _over(op.bursts),
    "term_frequency": lambda spark, d: op.term_frequency(table(spark, d, "documents")),
    "word_freq_vs_reference": _against,
    "signal_density_ttr": _over(op.type_token_density),
    "density_issues": _over(op.density_issues),
    "entropy_windows": _over(win.entropy_windows),
    "entropy_depressions": _over(win.depressions),
    "burst_windows": _over(win.burst_terms),
    "burst_regions": _over(win.burst_regions),
}

_ENTROPY = "CASE WHEN n > 0 THEN log2(CAST(n AS DOUBLE)) - clogc / n ELSE 0.0 END"
_P = "p AS (SELECT source AS manuscript_id, count(*) AS paragraphs FROM documents GROUP BY source)"

_DENSITY = f"""
    SELECT source AS manuscript_id, doc_id, CAST(len(own) AS BIGINT) AS token_count,
           round(CASE WHEN len(own) > 0 THEN len(con) / len(own) ELSE 0.0 END, 4) AS lexical_density
    FROM (SELECT source, doc_id, {q.TOKENS} AS own, {q.CONTENT} AS con FROM documents)"""

_SURPRISAL = f"""
    WITH {q.tokens("a", q.LETTERS)}, {q.tokens("t", q.TOKENS)},
    c AS (SELECT manuscript_id, token, count(*) AS n FROM a GROUP BY ALL),
    s AS (SELECT manuscript_id, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY ALL),
    d AS (
        SELECT doc_id, count(*) AS n, sum(-log2(greatest(c.n / total, 1 / total))) AS bits
        FROM t JOIN c USING (manuscript_id, token) JOIN s USING (manuscript_id) GROUP BY doc_id)
    SELECT source AS manuscript_id, doc_id, coalesce(n, 0) AS token_count, round(coalesce(bits / n, 0.0), 4) AS surprisal,
           round(coalesce(bits / n, 0.0) * sqrt(coalesce(n, 0) / (coalesce(n, 0) + 12)), 4) AS adjusted_surprisal
    FROM documents LEFT JOIN d USING (doc_id)"""

_THEME_TOKENS = f"""
    SELECT manuscript_id, token AS theme, CAST(sum(c) AS BIGINT) AS count, count(*) AS spread, 'token' AS type,
           round(sum(c) * ln(1 + any_value(paragraphs) / count(*)), 4) AS score
    FROM (SELECT manuscript_id, doc_id, token, count(*) AS c FROM t
          WHERE length(token) >= 4 AND token NOT IN ({q.words(lx.THEME_BLOCKLIST)}) GROUP BY ALL)
    JOIN p USING (manuscript_id) GROUP BY manuscript_id, token
    HAVING count(*) >= 3 AND count(*) <= floor(any_value(paragraphs) * {lx.WIDE_SHARE})"""


def _grams(n: int, source: str = "t") -> str:
    """SQL rows (manuscript_id, doc_id, pos, gram) of n neighbours."""
    own = [f"lead(token, {k}) OVER w AS t{k}" for k in range(1, n)]
    rest = " || ".join(["token", *[f"' ' || t{k}" for k in range(1, n)]])
    names = ", ".join(["token", *[f"t{k}" for k in range(1, n)]])
    return f"""SELECT manuscript_id, doc_id, pos, {rest} AS gram, [{names}] AS parts
        FROM (SELECT *, {", ".join(own)} FROM {source} WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE t{n - 1} IS NOT NULL"""


def _patterns(n: int) -> str:
    return f"""
        WITH {q.tokens("t", q.TOKENS)},
        g AS ({_grams(n)}),
        s AS (
            SELECT manuscript_id, gram AS pattern, count(*) AS count, min({{'d': doc_id, 'p': pos}}) AS place FROM g
            WHERE len(list_filter(parts, lambda x: length(x) >= 4)) > 0
              AND len(list_filter(parts, lambda x: x NOT IN ({q.words(lx.STOPWORDS)}))) > 0 GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY manuscript_id ORDER BY count DESC, place) AS rank FROM s)
        SELECT manuscript_id, pattern, count, rank FROM r WHERE rank <= 20 AND count >= 2"""


_PLACED = """,
    z AS (SELECT manuscript_id, doc_id, count(*) AS n FROM t GROUP BY ALL),
    o AS (SELECT doc_id, coalesce(sum(n) OVER (PARTITION BY manuscript_id ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM z),
    tot AS (SELECT manuscript_id, CAST(sum(n) AS BIGINT) AS total FROM z GROUP BY ALL),
    g AS MATERIALIZED (SELECT t.manuscript_id, t.doc_id, CAST(start + pos AS BIGINT) AS gpos, token, total FROM t JOIN o USING (doc_id) JOIN tot USING (manuscript_id))"""

_ENTROPIES = f"""
    {q.tokens("t", q.ENTROPY)}{_PLACED},
    x AS (SELECT *, lead(token) OVER (PARTITION BY manuscript_id ORDER BY gpos) AS t2 FROM g),
    w AS (
        SELECT tot.manuscript_id, k AS "window", k * 250 AS a, least(k * 250 + 500, total) AS b
        FROM tot, LATERAL (SELECT unnest(range(0, greatest(0, CAST(ceil((total - 500) / 250) AS BIGINT)) + 1)) AS k) AS u),
    i AS (SELECT x.manuscript_id, "window", a, b, gpos, token, t2 FROM x JOIN w ON x.manuscript_id = w.manuscript_id AND gpos >= a AND gpos < b),
    c AS (
        SELECT manuscript_id, "window", a, b, 1 AS k, token AS term, count(*) AS c FROM i GROUP BY ALL
        UNION ALL SELECT manuscript_id, "window", a, b, 2, token || ' ' || t2, count(*) FROM i WHERE gpos + 1 < b AND t2 IS NOT NULL GROUP BY ALL),
    s AS (
        SELECT manuscript_id, "window", a, b, CAST(sum(c) FILTER (k = 1) AS BIGINT) AS n, sum(c * log2(CAST(c AS DOUBLE))) FILTER (k = 1) AS clogc, count(*) FILTER (k = 1) AS v,
               CAST(coalesce(sum(c) FILTER (k = 2), 0) AS BIGINT) AS n2, coalesce(sum(c * log2(CAST(c AS DOUBLE))) FILTER (k = 2), 0.0) AS clogc2 FROM c GROUP BY ALL),
    e AS (
        SELECT manuscript_id, "window", a AS start_token, b AS end_token, {_ENTROPY} AS entropy, CASE WHEN n2 > 0 THEN log2(CAST(n2 AS DOUBLE)) - clogc2 / n2 ELSE 0.0 END AS bigram_entropy, v / n AS ratio
        FROM s WHERE n >= 2)"""

_BURSTS = f"""
    {q.tokens("t", q.BURST_WORDS)}{_PLACED},
    v AS MATERIALIZED (
        SELECT manuscript_id, total, gpos, token, lead(token, 1) OVER o AS t2, lead(token, 2) OVER o AS t3, lead(gpos, 1) OVER o AS p2, lead(gpos, 2) OVER o AS p3
        FROM g WHERE length(token) >= 3 AND token NOT IN ({q.words(lx.STOPWORDS)}) WINDOW o AS (PARTITION BY manuscript_id ORDER BY gpos)),
    m AS MATERIALIZED (
        SELECT manuscript_id, total, gpos AS a, gpos AS b, 1 AS n, token AS term FROM v
        UNION ALL SELECT manuscript_id, total, gpos, p2, 2, token || ' ' || t2 FROM v WHERE t2 IS NOT NULL
        UNION ALL SELECT manuscript_id, total, gpos, p3, 3, token || ' ' || t2 || ' ' || t3 FROM v WHERE t3 IS NOT NULL),
    f AS (SELECT manuscript_id, n, term, count(*) AS global_count FROM m GROUP BY ALL),
    gr AS (SELECT manuscript_id, n, count(*) AS grams FROM m GROUP BY ALL),
    wn AS (SELECT manuscript_id, total, k AS "window" FROM tot, LATERAL (SELECT unnest(range(0, greatest(0, (total - 500) // 100) + 1)) AS k) AS u),
    cw AS (
        SELECT wn.manuscript_id, "window", count(gpos) AS c FROM wn
        LEFT JOIN (SELECT manuscript_id, gpos, unnest(range(greatest(0, (gpos - 400) // 100), gpos // 100 + 1)) AS k FROM v) x ON x.manuscript_id = wn.manuscript_id AND x.k = "window" GROUP BY ALL),
    tw AS MATERIALIZED (SELECT manuscript_id, n, "window", greatest(0, c - n + 1) AS t FROM cw, (SELECT unnest([1, 2, 3]) AS n)),
    i AS (
        SELECT manuscript_id, n, term, unnest(range(greatest(0, CAST(ceil((b - 499) / 100) AS BIGINT)), least(a // 100, greatest(0, (total - 500) // 100)) + 1)) AS "window" FROM m),
    l AS MATERIALIZED (SELECT manuscript_id, n, term, "window", c, t FROM (SELECT manuscript_id, n, term, "window", count(*) AS c FROM i GROUP BY ALL) JOIN tw USING (manuscript_id, n, "window")),
    s AS (SELECT manuscript_id, n, term, sum(c) AS s, sum(c * c) AS ss, count(*) AS held, max(c) AS peak_count, min({{'c': -c, 'w': "window"}}).w AS peak_window FROM l GROUP BY ALL),
    ms AS (SELECT manuscript_id, n, count(*) AS windows, sum(t) AS sum_totals FROM tw GROUP BY ALL),
    y AS MATERIALIZED (
        SELECT f.*, coalesce(s, 0) AS s, coalesce(held, 0) AS held, coalesce(peak_count, 0) AS peak_count, coalesce(peak_window, 0) AS peak_window, windows, sum_totals, global_count / grams AS rate,
               CASE WHEN windows > 1 THEN sqrt(round(greatest(0.0, (coalesce(ss, 0) - CAST(coalesce(s, 0) * coalesce(s, 0) AS DOUBLE) / windows) / (windows - 1)), 9)) ELSE 0.0 END AS deviation
        FROM f LEFT JOIN s USING (manuscript_id, n, term) JOIN gr USING (manuscript_id, n) JOIN ms USING (manuscript_id, n)),
    zs AS MATERIALIZED (SELECT l.*, (c - rate * t) / deviation AS z FROM l JOIN y USING (manuscript_id, n, term) WHERE deviation > 0)"""

ORACLE_SQL = {
    "paragraph_entropy": f"""
        WITH {q.tokens("t", q.TOKENS)},
        c AS (SELECT manuscript_id, doc_id, token, count(*) AS c FROM t GROUP BY ALL),
        e AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n, sum(c * log2(CAST(c AS DOUBLE))) AS clogc, count(*) AS v FROM c GROUP BY doc_id),
        r AS (SELECT source AS manuscript_id, d.doc_id, coalesce(n, 0) AS token_count, round(coalesce({_ENTROPY}, 0.0), 4) + 0.0 AS entropy, v
              FROM documents d LEFT JOIN e ON d.doc_id = e.doc_id)
        SELECT manuscript_id, doc_id, token_count, entropy, round(CASE WHEN v > 1 THEN entropy / log2(CAST(v AS DOUBLE)) ELSE 0.0 END, 4) AS normalized_entropy FROM r""",
    "document_entropy": f"""
        WITH {q.tokens("t", q.LETTERS)},
        c AS (SELECT manuscript_id, token, count(*) AS c FROM t GROUP BY ALL),
        e AS (SELECT manuscript_id, CAST(sum(c) AS BIGINT) AS n, count(*) AS v, sum(c * log2(CAST(c AS DOUBLE))) AS clogc FROM c GROUP BY ALL)
        SELECT manuscript_id, n AS token_count, v AS vocabulary, round({_ENTROPY}, 4) + 0.0 AS document_entropy FROM e""",
    "paragraph_signal_density": _DENSITY,
    "low_density_topk": f"""
        WITH d AS ({_DENSITY}),
        r AS (SELECT *, row_number() OVER (PARTITION BY manuscript_id ORDER BY lexical_density, doc_id) AS rank FROM d
              WHERE token_count >= {lx.LEAST_TOKENS} AND lexical_density < {lx.LOW_DENSITY})
        SELECT * FROM r WHERE rank <= 12""",
    "paragraph_surprisal": _SURPRISAL,
    "surprisal_topk": f"""
        WITH d AS ({_SURPRISAL}),
        r AS (SELECT *, row_number() OVER (PARTITION BY manuscript_id ORDER BY adjusted_surprisal DESC, doc_id) AS rank FROM d WHERE token_count >= {lx.LEAST_TOKENS})
        SELECT * FROM r WHERE rank <= 12""",
    "themes_tokens": f"""WITH {q.tokens("t", q.CONTENT)}, {_P} {_THEME_TOKENS}""",
    "themes_all": f"""
        WITH {q.tokens("t", q.CONTENT)}, {_P},
        g AS (SELECT manuscript_id, doc_id, gram, parts FROM ({_grams(2)}) UNION ALL SELECT manuscript_id, doc_id, gram, parts FROM ({_grams(3)})),
        h AS (SELECT manuscript_id, gram AS theme, count(*) AS count, count(DISTINCT doc_id) AS spread FROM g
              WHERE len(list_filter(parts, lambda x: x IN ({q.words(lx.THEME_BLOCKLIST)}))) = 0 GROUP BY ALL),
        u AS (
            {_THEME_TOKENS}
            UNION ALL
            SELECT manuscript_id, theme, count, spread, 'phrase', round(count * ln(1 + paragraphs / spread) * 1.35, 4) FROM h JOIN p USING (manuscript_id)
            WHERE count >= 2 AND spread >= 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY manuscript_id ORDER BY score DESC, type, theme) AS rank FROM u)
        SELECT * FROM r WHERE rank <= 20""",
    "repeated_bigrams": _patterns(2),
    "repeated_trigrams": _patterns(3),
    "paragraph_bursts": f"""
        WITH {q.tokens("t", q.CONTENT)}, {_P},
        c AS (SELECT manuscript_id, doc_id, token, count(*) AS c FROM t GROUP BY ALL),
        s AS (
            SELECT manuscript_id, token, count(*) AS df, max(c) AS peak, min({{'c': -c, 'd': doc_id}}).d AS place, CAST(any_value(paragraphs) AS DOUBLE) AS p,
                   sum(c) / CAST(any_value(paragraphs) AS DOUBLE) AS mean, sum(c * c) AS ss
            FROM c JOIN p USING (manuscript_id) GROUP BY manuscript_id, token
            HAVING count(*) >= {lx.BURST_DF} AND count(*) <= floor(any_value(paragraphs) * {lx.WIDE_SHARE}) AND max(c) >= 2),
        z AS (SELECT *, sqrt(ss / p - mean * mean) AS std FROM s),
        b AS (SELECT *, (peak - mean) / std AS z, round((peak - mean) / std * peak, 4) AS burst_strength FROM z WHERE std > 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY manuscript_id ORDER BY burst_strength DESC, token) AS rank FROM b WHERE z >= {lx.BURST_Z} AND burst_strength >= {lx.BURST_STRENGTH})
        SELECT manuscript_id, token, df AS document_frequency, peak AS peak_count, place AS peak_doc_id, round(z, 4) AS z_score, burst_strength, rank FROM r WHERE rank <= 25""",
    "term_frequency": f"SELECT word, count(*) AS count FROM (SELECT unnest({q.APOSTROPHE}) AS word FROM documents) GROUP BY word",
    "word_freq_vs_reference": f"""
        WITH a AS (SELECT word, count(*) AS n FROM (SELECT unnest({q.APOSTROPHE}) AS word FROM documents) GROUP BY word),
        b AS (SELECT word, count(*) AS r FROM (SELECT unnest({q.APOSTROPHE}) AS word FROM benchmark) GROUP BY word),
        s AS (SELECT (SELECT sum(n) FROM a) AS sn, (SELECT sum(r) FROM b) AS sr),
        x AS (SELECT word, n, coalesce(r, 0) AS r, n / sn * 1e6 AS rate, coalesce(r, 0) / sr * 1e6 AS other FROM a LEFT JOIN b USING (word), s)
        SELECT word, n AS count, round(rate, 2) AS per_million, r AS reference_count, round(other, 2) AS reference_per_million,
               round(CASE WHEN other > 0 THEN rate / other END, 2) AS relative FROM x""",
    "signal_density_ttr": f"""
        WITH d AS (SELECT source AS manuscript_id, doc_id, {q.APOSTROPHE} AS own FROM documents),
        e AS (SELECT *, len(own) AS n, len(list_distinct(own)) AS v, len(list_filter(own, lambda x: x NOT IN ({q.words(lx.DENSITY_STOPWORDS)}))) AS c FROM d)
        SELECT manuscript_id, doc_id, CAST(n AS BIGINT) AS token_count, round(CASE WHEN n > 0 THEN v / n ELSE 0.0 END, 4) AS lexical_density,
               round(CASE WHEN n > 0 THEN c / n ELSE 0.0 END, 4) AS content_density, round(CASE WHEN n > 0 THEN (n - c) / n ELSE 0.0 END, 4) AS stopword_ratio FROM e""",
    "entropy_windows": f"""
        WITH {_ENTROPIES}
        SELECT manuscript_id, "window", start_token, end_token, round(entropy, 4) + 0.0 AS entropy, round(bigram_entropy, 4) + 0.0 AS bigram_entropy, round(ratio, 4) AS type_token_ratio FROM e""",
    "entropy_depressions": f"""
        WITH {_ENTROPIES},
        mean AS (SELECT manuscript_id, avg(entropy) AS mean, stddev_pop(entropy) AS deviation FROM e GROUP BY ALL)
        SELECT manuscript_id, "window", round(entropy, 4) + 0.0 AS entropy, round(mean, 4) + 0.0 AS mean, round(deviation, 4) + 0.0 AS deviation
        FROM e JOIN mean USING (manuscript_id) WHERE entropy < mean - deviation""",
    "burst_windows": f"""
        WITH {_BURSTS},
        h AS (SELECT manuscript_id, n, term, max(z) AS z, count(*) FILTER (z >= 3.0) AS hits FROM zs GROUP BY ALL),
        lo AS (SELECT y.manuscript_id, y.n, y.term FROM y JOIN h USING (manuscript_id, n, term) WHERE h.z < 0 AND held < windows),
        ab AS (
            SELECT lo.manuscript_id, lo.n, lo.term, min(tw.t) AS t FROM lo JOIN tw USING (manuscript_id, n)
            LEFT JOIN l ON l.manuscript_id = lo.manuscript_id AND l.n = lo.n AND l.term = lo.term AND l."window" = tw."window" WHERE l.c IS NULL GROUP BY ALL)
        SELECT manuscript_id, term, CAST(n AS BIGINT) AS ngram_size, global_count, peak_count, peak_window,
               round(CASE WHEN deviation > 0 THEN greatest(h.z, CASE WHEN ab.t IS NOT NULL THEN (0 - rate * ab.t) / deviation END) ELSE 0.0 END, 4) + 0.0 AS max_z,
               round(CASE WHEN deviation > 0 THEN (CAST(s AS DOUBLE) / windows - rate * (CAST(sum_totals AS DOUBLE) / windows)) / deviation ELSE 0.0 END, 4) + 0.0 AS mean_z,
               CAST(coalesce(hits, 0) AS BIGINT) AS burst_windows
        FROM y LEFT JOIN h USING (manuscript_id, n, term) LEFT JOIN ab USING (manuscript_id, n, term)""",
    "burst_regions": f"""
        WITH {_BURSTS},
        x AS (SELECT manuscript_id, n, term, "window", round(z, 4) AS q FROM zs WHERE z >= 3.0),
        b AS (SELECT x.*, total, "window" * 100 AS first, least("window" * 100 + 500, total) - 1 AS last, least(500, total) AS reach FROM x JOIN tot USING (manuscript_id)),
        h AS (SELECT manuscript_id, gpos, doc_id FROM g),
        p AS (SELECT manuscript_id, doc_id, min(gpos) AS a, max(gpos) AS b FROM g GROUP BY ALL),
        r AS (
            SELECT b.*, h.doc_id AS paragraph, greatest(first, p.a) AS first_token, least(last, p.b) AS last_token, round((first + reach / 2) / total * 100, 6) AS progress
            FROM b JOIN h ON h.manuscript_id = b.manuscript_id AND gpos = first + reach // 2 JOIN p ON p.manuscript_id = b.manuscript_id AND p.doc_id = h.doc_id)
        SELECT manuscript_id, paragraph, first_token, last_token, count(*) AS bursts, max(q) AS max_z, round(sum(CAST(round(progress * 1e6) AS BIGINT)) / (1e6 * count(*)), 2) AS mean_progress,
               array_to_string(list(term || ' (' || n || ')' ORDER BY q DESC, term, n, "window")[1:5], ', ') AS top_terms
        FROM r GROUP BY ALL""",
}
ORACLE_SQL["density_issues"] = f"""
    WITH d AS ({ORACLE_SQL["signal_density_ttr"]})
    SELECT manuscript_id, doc_id, lexical_density, content_density,
           concat_ws(',', CASE WHEN lexical_density < 0.6 THEN 'lexical_density' END, CASE WHEN content_density < 0.55 THEN 'content_density' END) AS reason
    FROM d WHERE lexical_density < 0.6 OR content_density < 0.55"""
