"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import bpe, chat_format, embedding_dedup, exact_dedup, funnels, language_id, license_scan, lm_scoring, mixing, simhash, token_files, vector_codes, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(_table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.query(_table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.query(_table(spark, sf_dir, "conversations"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.query(_table(spark, sf_dir, "documents"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No source is shown more than three times for each time that the largest is shown."""
    return mixing.mixture(_table(spark, sf_dir, "documents"), repeat=3.0)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    location = token_files.write(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), end_id=2)
    return token_files.checksums(spark, location)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op12_funnels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnels.report(_table(spark, sf_dir, "clicks"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op4_language_id": op4_language_id,
    "op3_chat_format": op3_chat_format,
    "op5_simhash": op5_simhash,
    "op6_embedding_dedup": op6_embedding_dedup,
    "op7_mixing": op7_mixing,
    "op8_license_scan": op8_license_scan,
    "op9_bpe_round_trip": op9_bpe_round_trip,
    "op10_token_files": op10_token_files,
    "op11_warc": op11_warc,
    "op12_funnels": op12_funnels,
    "op13_vector_codes": op13_vector_codes,
}


def _funnel_sql() -> str:
    """Every funnel over the whole table: the next row of a kind and the next excluded one by ASOF joins, times ranked in lists."""
    out = ["e AS (SELECT DISTINCT client_id, kind, epoch_us(ts) AS t FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL)"]
    rows = []
    for f in funnels.FUNNELS:
        x = f.name
        out.append(f"{x}1 AS (SELECT client_id, t, 0 AS took FROM e WHERE kind = '{f.steps[0]}')")
        for s, kind in enumerate(f.steps[1:], 2):
            barred = ", ".join(f"'{k}'" for k in f.excluded)
            out.append(
                f"{x}{s} AS (SELECT p.client_id, p.t, p.t - p.before AS took FROM ("
                f"SELECT a.client_id, a.t AS before, k.t FROM {x}{s - 1} a ASOF JOIN (SELECT * FROM e WHERE kind = '{kind}') k ON a.client_id = k.client_id AND a.t < k.t) p "
                f"ASOF LEFT JOIN (SELECT * FROM e WHERE kind IN ({barred})) z ON p.client_id = z.client_id AND p.before < z.t "
                f"WHERE p.t - p.before <= {f.within} AND (z.t IS NULL OR z.t > p.t))"
            )
        rows += [f"SELECT '{x}' AS funnel, {s} AS step, client_id, took FROM {x}{s}" for s in range(1, len(f.steps) + 1)]
    out.append(f"u AS ({' UNION ALL '.join(rows)})")
    out.append("g AS (SELECT funnel, client_id, step, count(*) AS n, list_sort(list(took))[CAST(ceil(count(*) / 2) AS BIGINT)] AS t FROM u GROUP BY ALL)")
    counts = ", ".join(f"coalesce(max(CASE WHEN step = {s} THEN n END), 0) AS n{s}" for s in range(1, 5))
    times = ", ".join(f"max(CASE WHEN step = {s} THEN t END) AS t{s}" for s in range(2, 5))
    out.append(f"r AS (SELECT funnel, client_id, {counts}, CAST(max(step) AS INTEGER) AS deepest, {times} FROM g GROUP BY funnel, client_id)")
    return f"WITH {', '.join(out)} SELECT *, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM r"


def _codes_sql() -> str:
    """Two rounds of assignment and replacement, then the last assignment, every part against every entry."""
    v = vector_codes
    out = [
        "o AS (SELECT row_number() OVER (ORDER BY vec_id) AS row_id, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 "
        "AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"i AS (SELECT row_id, vec_id, label, list_transform(embedding, lambda x: CAST(floor({v.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS ints FROM o)",
        f"p AS (SELECT row_id, k AS part, ints[k * (len(ints) // {v.PARTS}) + 1 : (k + 1) * (len(ints) // {v.PARTS})] AS x FROM i, (SELECT unnest(range({v.PARTS})) AS k))",
        f"c0 AS (SELECT part, row_id - 1 AS entry, x AS c FROM p WHERE row_id <= {v.ENTRIES})",
    ]
    for r in range(v.ROUNDS + 1):
        out.append(
            f"d{r} AS (SELECT row_id, part, entry, x, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN c{r} USING (part)), "
            f"a{r} AS (SELECT row_id, part, arg_min(entry, (d, entry)) AS entry, CAST(min(d) AS BIGINT) AS d, any_value(x) AS x FROM d{r} GROUP BY row_id, part)"
        )
        if r < v.ROUNDS:
            out.append(
                f"m{r} AS (SELECT part, entry, k, sum(x[k]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS k) GROUP BY ALL), "
                f"n{r} AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS c FROM m{r} GROUP BY part, entry), "
                f"c{r + 1} AS (SELECT part, entry, coalesce(n{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN n{r} USING (part, entry))"
            )
    last = v.ROUNDS
    return (
        f"WITH {', '.join(out)}, h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{last}), "
        f"q AS (SELECT row_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY row_id) "
        "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM i JOIN q USING (row_id), h"
    )


def _licence_sql() -> str:
    """The scan over the same fixed templates, with the index as a list of values."""
    q = lambda x: "'" + str(x) + "'" if isinstance(x, str) else str(x)
    known = license_scan.templates()
    index = ", ".join(f"({q(w)}, {t}, {q(kind)}, {q(label)}, {i}, {strict}, {len(own)}, {need}, {sum(x for *_, x in own)})" for t, (kind, label, own, need) in enumerate(known) for i, w, strict in own)
    wanted = ", ".join(f"({q(label)}, {q(key)})" for label, _, keys in license_scan.NOTICES for key in keys)
    return rf"""
        WITH p(w, t, kind, label, position, strict, size, need, must) AS (VALUES {index}), k(label, wanted) AS (VALUES {wanted}),
        d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{license_scan.UPPER}', '{license_scan.UPPER.lower()}'),
                   '{license_scan.WORD_BREAK}'), lambda x: x <> '') AS words FROM documents),
        u AS (SELECT doc_id, unnest(words) AS w, unnest(range(0, len(words))) AS i FROM d),
        g AS (
            SELECT doc_id, t, kind, label, size, i - position AS start, count(*) AS n FROM u JOIN p USING (w)
            GROUP BY doc_id, t, kind, label, size, need, must, start HAVING n >= need AND sum(strict) = must),
        b AS (
            SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word, list_distinct(list(label)) AS labels
            FROM g WHERE kind = 'base' GROUP BY doc_id),
        v AS (
            SELECT g.doc_id, g.label, max(g.n / g.size) AS part FROM g WHERE kind = 'clause' AND NOT EXISTS (
                SELECT 1 FROM k WHERE k.label = g.label AND NOT EXISTS (
                    SELECT 1 FROM g AS o WHERE o.doc_id = g.doc_id AND o.kind = 'key' AND o.label = k.wanted)) GROUP BY ALL),
        x AS (SELECT doc_id, list(label) AS labels, max(part) AS part FROM v GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
               CAST(last_word AS BIGINT) AS last_word, array_to_string(list_sort(coalesce(b.labels, [])), ',') AS base_labels,
               array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(x.labels, [])))), ',') AS labels,
               round(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(part, 0.0) END, 6) AS score
        FROM d LEFT JOIN b USING (doc_id) LEFT JOIN x USING (doc_id)"""


ORACLE_SQL = {
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS len,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
            FROM documents),
        g AS (
            SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY len DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY text_sha256) AS group_size
            FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op3_chat_format": r"""
        WITH r AS (
            SELECT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
            FROM conversations),
        z AS (
            SELECT conv_id AS c, count(*) AS n, min(turn) AS low, max(turn) AS high, min(CASE WHEN role <> 'system' THEN turn END) AS speaks
            FROM r GROUP BY conv_id),
        m AS (
            SELECT r.*, n, speaks, CASE WHEN n <= 4096 THEN 0 ELSE CAST(floor((turn - low) / ceil((high - low + 1) * 1024.0 / n)) AS BIGINT) END AS part
            FROM r JOIN z ON conv_id = c),
        k AS (SELECT conv_id AS c, part AS p, count(*) AS held FROM m GROUP BY ALL),
        y AS (
            SELECT m.*, CASE WHEN held > 4096 THEN turn ELSE 0 END AS split,
                   CASE WHEN held > 4096 THEN CAST(('0x' || substr(md5(role || chr(10) || text), 1, 8)) AS BIGINT) % CAST(ceil(held / 1024.0) AS BIGINT) ELSE 0 END AS slot
            FROM m JOIN k ON conv_id = c AND part = p),
        t AS (
            SELECT conv_id, turn, role, text, part, split, slot FROM y
            UNION ALL
            SELECT y.conv_id, turn, role, text, q.part, q.split, q.slot
            FROM y JOIN (SELECT DISTINCT conv_id, part, split, slot FROM y) q ON y.conv_id = q.conv_id
            WHERE role = 'system' AND turn < speaks AND (y.part, y.split, y.slot) <> (q.part, q.split, q.slot)),
        s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
        p AS (
            SELECT t.*, speaker, text || '<|end|>' || chr(10) AS body,
                   '<|turn|>' || CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant'
                                      ELSE 'user:' || role END || chr(10) AS head
            FROM t JOIN s ON t.conv_id = s.conv_id),
        q AS (
            SELECT *, row_number() OVER w AS n, CAST(sum(length(head) + length(body)) OVER w AS BIGINT) AS fin FROM p
            WINDOW w AS (PARTITION BY conv_id, speaker, part, split, slot ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
        SELECT conv_id, speaker, part, split, slot, count(*) AS n_turns, string_agg(head || body, '' ORDER BY n) AS text,
               coalesce(string_agg(CASE WHEN role = speaker THEN (fin - length(body)) || '-' || fin END, ',' ORDER BY n), '') AS mask
        FROM q GROUP BY conv_id, speaker, part, split, slot""",
    "op7_mixing": r"""
        WITH d AS (
            SELECT doc_id, coalesce(source, '') AS source,
                   CAST(len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) + 1 AS BIGINT) AS tokens
            FROM documents),
        s AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS total FROM d GROUP BY source),
        a AS (SELECT max(total) AS most, least(1, ln(3.0) / ln(CAST(max(total) AS DOUBLE) / min(total))) AS e FROM s),
        g AS (
            SELECT source, total, CAST(round(pow(most, e) / pow(total, e) * total) AS BIGINT) AS goal FROM s, a),
        b AS (SELECT greatest(1, ceil(sum(goal) / 1000000.0)) AS blocks FROM g),
        x AS (
            SELECT d.*, total, goal, k AS pass, md5('7:' || k || ':' || doc_id) AS order_key
            FROM d JOIN g USING (source), LATERAL (SELECT unnest(range(0, goal // total + 1)) AS k) AS u),
        y AS (
            SELECT *, pass * total + sum(tokens) OVER (PARTITION BY source, pass ORDER BY order_key) AS fin FROM x)
        SELECT doc_id, source, pass, CAST(floor(CAST(fin - tokens AS DOUBLE) / goal * blocks) AS BIGINT) AS block,
               CAST(fin - tokens AS BIGINT) AS stream_start, tokens, order_key
        FROM y, b WHERE fin <= goal""",
    "op6_embedding_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
        e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
        w(node, reach) AS (SELECT vec_id, vec_id FROM v UNION SELECT node, b FROM w JOIN e ON reach = a),
        c AS (SELECT node, min(reach) AS component_id FROM w GROUP BY node),
        n AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM v JOIN c ON vec_id = node LEFT JOIN n ON vec_id = a""",
    "op8_license_scan": _licence_sql(),
    "op11_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        h AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS x, min(page_id) OVER (PARTITION BY html) AS first_id FROM p)
        SELECT page_id, payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + CAST(((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
               CASE WHEN page_id = first_id OR first_id IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id OR page_id IS NULL THEN first_id END AS refers_to
        FROM h""",
    "op12_funnels": _funnel_sql(),
    "op13_vector_codes": _codes_sql(),
}
