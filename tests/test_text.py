"""Column functions and segmentation against plain restatements."""

import math
import random
import re
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmill.functions import lexicons as lx
from quillmill.functions import text as tx
from quillmill.operators import annotated, events, findings, graph, learned, lexical, resolution, review, segments, similarity, windows, vector_index


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def py_tokens(text):
    own = [t.lower().replace("'", "") for t in re.findall(r"[A-Za-z]+(?:'[A-Za-z]+)?", text)]
    return [t for t in own if len(t) >= 2 and t not in lx.CONTRACTION_PARTS]


@pytest.mark.parametrize("text", ["Don't we've it's RE the s x", "", "Ünder größe naïve", "o'clock 'tis rock'n'roll", "İstanbul Kelvin K"])
def test_tokens(spark, text):
    assert one(spark, text, tx.tokens) == py_tokens(text)
    assert one(spark, text, lambda c: tx.content(tx.tokens(c))) == [t for t in py_tokens(text) if len(t) >= 3 and t not in lx.STOPWORDS]


def test_cleaning(spark):
    text = "# Head\n> quote\n- item *bold*\n1. first [link](http://x) ![i](y) `code` end\n```\ncode\n\nmore\n```\nplain"
    assert one(spark, text, tx.clean_markdown) == "Head\nquote\nitem bold\nfirst link end\n\nplain"
    assert one(spark, "’‘—–", tx.fold_punctuation) == "''--"
    assert one(spark, "## A\n- b `c` **d**", tx.clean_for_voice) == "A\nb `c` d"
    assert one(spark, "a ```x\ny``` `z` [q](r) ![s](t)", tx.clean_for_similes).split() == ["a", "q"]
    assert one(spark, "x ```a `b` c``` y ``", tx.clean_for_similes) == "x  y ``"


def test_splitting(spark):
    assert one(spark, "a\n\n b \n \n\n\nc\n", tx.paragraphs) == ["a", "b", "c"]
    assert one(spark, "One. Two!  Three? four.", tx.sentences) == ["One.", "Two!", "Three?", "four."]
    assert one(spark, "Hi, (there)! 'x'", tx.stripped_tokens) == ["hi", "there", "x"]
    assert one(spark, "well-known it's", tx.concordance_tokens) == ["well-known", "it's"]
    assert one(spark, "The the a big-big 12345", tx.search_terms) == ["the", "big", "12345"]
    assert one(spark, ["a", "b", "c"], lambda c: tx.ngrams(c, 2), "array<string>") == [["a", "b"], ["b", "c"]]
    assert one(spark, ["a"], lambda c: tx.ngrams(c, 2), "array<string>") == []
    assert one(spark, "Hopeless SILENCE", lambda c: tx.phrases_in(c, lx.LOW_SIGNAL_PHRASES)) == ["silence", "hope"]


@pytest.mark.parametrize("own", [[], ["a"], ["a", "a"], ["b", "a", "b", "c", "b", "a"]])
def test_runs_give_entropy(spark, own):
    r = one(spark, own, tx.runs, "array<string>")
    c = Counter(own)
    assert (r.n, r.vocabulary) == (len(own), len(c))
    assert math.isclose(r.clogc, sum(x * math.log2(x) for x in c.values()), abs_tol=1e-9)


def test_scalars(spark):
    name = "chapter:event"
    assert one(spark, name, lambda c: tx.uuid5(F.lit(uuid.NAMESPACE_DNS.hex), c)) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))
    assert [one(spark, x, tx.clamp_score) for x in ("7", "-1", "3", "x", None)] == [5, 0, 3, 0, 0]
    assert [one(spark, x, tx.year_of) for x in ("2031", "2024-05-06T07:08:09", "soon")] == [2031, 2024, None]
    assert one(spark, 'noise {"a": 1} tail', tx.json_in) == '{"a": 1}' and one(spark, "no {json", tx.json_in) is None
    assert one(spark, "http://x/v1/", tx.chat_url) == "http://x/v1/chat/completions" == one(spark, "http://x", tx.chat_url)
    assert one(spark, "a", tx.content_hash).startswith("sha256:ca978112")
    row = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, c array<double>")
    out = row.select(tx.cosine(F.col("a"), F.col("b")).alias("x"), tx.cosine(F.col("a"), F.col("c")).alias("y")).first()
    assert math.isclose(out.x, 2**-0.5) and out.y == 0.0


def rows(spark, texts, manuscript="m"):
    return spark.createDataFrame([(manuscript, i, t) for i, t in enumerate(texts)], "manuscript_id string, doc_id long, text string")


def test_bursts_edges(spark):
    """A token in exactly four paragraphs counts, one in three doesn't; the first paragraph at the peak is named."""
    texts = ["filler words here"] * 40
    for i in (3, 9, 12, 20):
        texts[i] = "zebra " * (6 if i in (9, 12) else 1)
    for i in (1, 2, 5):
        texts[i] = "yonder " * 6
    found = lexical.bursts(rows(spark, texts)).collect()
    assert [(r.token, r.document_frequency, r.peak_count, r.peak_doc_id) for r in found] == [("zebra", 4, 6, 9)]
    counts = [t.split().count("zebra") for t in texts]
    mean = sum(counts) / 40
    assert math.isclose(found[0].z_score, round((6 - mean) / math.sqrt(sum((c - mean) ** 2 for c in counts) / 40), 4), abs_tol=1e-4)


def test_near_duplicates_are_transitive(spark):
    base = [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(4) for j in range(6)]
    texts = [" ".join(base[a : a + 15]) for a in (0, 3, 6)] + ["unrelated " + " ".join(base[::5])]
    pairs = {(r.left_id, r.right_id) for r in similarity.near_duplicate_pairs(rows(spark, texts)).collect()}

    def alike(a, b):
        a, b = py_tokens(a), py_tokens(b)
        j = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
        return 0.7 * j(a, b) + 0.3 * j(list(zip(a, a[1:])), list(zip(b, b[1:]))) >= lx.PAIR_SIMILARITY and len(set(a) & set(b)) >= 5

    assert pairs == {(i, j) for i in range(4) for j in range(i + 1, 4) if alike(texts[i], texts[j])}
    assert pairs == {(0, 1), (1, 2)}
    assert [(r.cluster_size, r.members) for r in similarity.near_duplicate_clusters(rows(spark, texts)).collect()] == [(3, "0,1,2")]


@pytest.mark.parametrize("n", [0, 1, 2, 9, 10, 11, 25])
def test_windows_cover_all_tokens(spark, n):
    words = windows.placed(rows(spark, [" ".join(["w" * (i % 3 + 1) for i in range(n)])]), F.filter(F.split("text", " "), lambda t: t != ""))
    got = windows.in_windows(words, 10, 5, True).groupBy("window").agg(F.min("gpos").alias("a"), F.max("gpos").alias("b")).orderBy("window").collect()
    want, start = [], 0
    while n:
        end = min(start + 10, n)
        want.append((start, end - 1))
        if end == n:
            break
        start += 5
    assert [(r.a, r.b) for r in got] == want


def test_greedy_packing(spark):
    sentences = ["word " * k + "end." for k in (150, 10, 100, 30, 2)]
    got = segments.sentence_chunks(rows(spark, [" ".join(sentences)]), 120).orderBy("chunk_index").collect()
    assert [(r.first_sentence, r.last_sentence) for r in got] == [(1, 1), (2, 3), (4, 5)]


def test_links_and_directives(spark):
    got = segments.links(rows(spark, ["abc", "", "de"])).orderBy("doc_id").collect()
    assert [(r.paragraph_id, r.prev_id, r.next_id, r.start_char, r.end_char) for r in got] == [("m-p0001", None, "m-p0002", 0, 3), ("m-p0002", "m-p0001", "m-p0003", 5, 5), ("m-p0003", "m-p0002", None, 7, 9)]
    lines = rows(spark, ["# head\n- cull this\n+ not this\n2. that\nDelete all", "# head\nplain\n\nlines"]).select("doc_id", "text")
    assert [(r.doc_id, r.item_id, r.item) for r in review.directives(lines).orderBy("doc_id", "item_id").collect()] == [(0, "item_0002", "cull this"), (0, "item_0004", "that"), (0, "item_0005", "Delete all"), (1, "item_0002", "plain"), (1, "item_0004", "lines")]


def test_edits(spark):
    """Expected values are the reference's for the same calls: excerpt first, then the issue's own sentence, then the last resort."""
    rows = [
        ("a b c.", " b ", "", "X", "replaced_excerpt", "a X c."), ("b b", "b", "b b", "X", "replaced_excerpt", "X b"), (" a b c. ", "q", "a b c.", "X", "replaced_whole_sentence", "X"),
        ("a b c.", "q", "a b c.", "a b c.", "no_change", "a b c."), ("a b c.", "", "a b c.", "", "no_change", "a b c."), ("a b c.", "q", "zz", "X", "fallback_replaced_whole_sentence", "X"),
        ("a b c.", None, None, "a b c.", "no_change", "a b c."), ("a b c.", "q", "", None, "no_change", "a b c."),
    ]
    frame = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(rows)], "i int, t string, e string, s string, c string")
    out = frame.select("i", review.applied_edit(F.col("t"), F.col("e"), F.col("s"), F.col("c")).alias("o")).orderBy("i").collect()
    assert [(r.o.mode, r.o.text) for r in out] == [r[4:] for r in rows]


def test_payloads(spark):
    import json

    good = {"line_id": "l", "line_start": 1, "line_end": None, "matched_source_span": "a", "deletion_type": "full_sentence", "delete_text": "a", "reason_summary": "r", "metric_tags": [], "confidence": 1, "ambiguity_flags": ["x"]}
    cases = [
        (good, []), (good | {"confidence": 1.01}, ["invalid:confidence"]), (good | {"confidence": "1"}, ["invalid:confidence"]), (good | {"line_start": 2.5, "deletion_type": "trim"}, ["invalid:deletion_type", "invalid:line_start"]),
        ({k: v for k, v in good.items() if k not in ("line_end", "delete_text")}, ["missing:line_end", "missing:delete_text", "invalid:delete_text"]), (good | {"metric_tags": "x", "ambiguity_flags": None}, ["invalid:metric_tags", "invalid:ambiguity_flags"]),
        ("{no json", ["invalid_json"]),
    ]
    frame = spark.createDataFrame([(i, c if isinstance(c, str) else json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, p string")
    assert [r.e for r in frame.select("i", review.payload_errors(F.col("p")).alias("e")).orderBy("i").collect()] == [w for _, w in cases]
    assert review.RUBRIC[0] == "intent_and_contract" and review.RUBRIC[-1] == "edge_cases" and len(review.RUBRIC) == 10


def test_slop_reasons_and_severity(spark):
    rows = [("m", i, float(-i), ["moreover"] if i in (3, 60) else []) for i in range(100)] + [("m", 200, float("nan"), ["moreover"])]
    found = {r.doc_id: (r.reason, r.severity) for r in findings.slop_flags(spark.createDataFrame(rows, "manuscript_id string, doc_id long, avg_logprob double, transitions array<string>")).collect()}
    outlier, turn = ("high_logprob_extreme_outlier", "low"), ("high_logprob_plus_transition", "medium")
    assert found == {0: outlier, 1: outlier, 2: outlier, 3: turn}


def test_slop_reasons_search_each_text_once(spark):
    """Hits as by a plain count, whatever marks stand around words; no text is lower-cased once for each phrase, nor again for the filter."""
    texts = ["Maybe 'water' (water) WATER... it's stone,stone of the", "stone!? \u2028 .water. water\tstone", "...", "", None, "''it's'' kind of\nstone", "waterstone hope", "HOPE perhaps;water \u00a0 stone\u00a0"]
    over, low, hedge = ["water", "stone", "it's"], ["hope", "of the"], ["maybe", "kind of", "perhaps"]
    want = {}
    for i, t in enumerate(texts):
        own = {re.sub(r"""^[.,;:!?"'()]+|[.,;:!?"'()]+$""", "", x).lower() for x in re.split(r"[ \t\n\x0b\f\r]+", t or "")}
        counts = [sum(p in (t or "").lower() for p in low), sum(p in (t or "").lower() for p in hedge), len(own & set(over))]
        reasons = [n for n, fit in (("low_signal_phrase", counts[0]), ("hedge_density", counts[1]), ("lexical_overuse_cluster", counts[2] >= 2)) if fit]
        if reasons:
            want[i] = (",".join(reasons), *counts)
    found = findings.slop_reasons(spark.createDataFrame([("m", i, t) for i, t in enumerate(texts)], "manuscript_id string, doc_id long, text string"), over, low, hedge)
    assert {r.doc_id: (r.reasons, r.phrase_hits, r.hedge_hits, r.overused_hits) for r in found.collect()} == want and len(want) == 5
    assert found._jdf.queryExecution().optimizedPlan().toString().count("lower(text") == 1


def test_paths_and_highlights(spark):
    j = '{"a": {"b": 2.5, "c": true, "d": "x"}}'
    out = spark.createDataFrame([(j,)], "j string").select(*[findings.number_at(F.col("j"), p).alias(n) for p, n in (("a.b", "b"), ("a.c", "c"), ("a.d", "d"), ("a.x.y", "e"))]).first()
    assert tuple(out) == (2.5, None, None, None)
    deep = '{"a":' * 12 + "1" + "}" * 12
    assert [tuple(r) for r in findings.flattened_numbers(spark.createDataFrame([(1, deep)], "k int, j string"), "k", "j").collect()] == [(1, ".".join("a" * 12), 1.0)]


def test_fuzzy_ratios():
    lcs = lambda a, b: max((lcs(a[1:], b[1:]) + 1 if a[0] == b[0] else max(lcs(a[1:], b), lcs(a, b[1:]))) if a and b else 0, 0)
    for a, b in [("narrator", "narrat0r"), ("harbor", "arbour"), ("", "x"), ("", ""), ("abcabc", "cbacba")]:
        want = 100.0 if not a and not b else 200 * lcs(a, b) / (len(a) + len(b))
        assert math.isclose(graph.indel_ratio(a, b), want)
    assert graph.token_set_ratio("the old harbor", "harbor the old") == 100.0
    assert graph.partial_ratio("harbor", "the old harbor master") == 100.0


def test_resolution(spark):
    known = spark.createDataFrame([("u1", "Narrator", ["The Narrator", "X"], 0), ("u2", "Elara", ["X"], 1)], "uuid string, name string, aliases array<string>, position long")
    mentions = spark.createDataFrame([(1, " the narrator"), (2, "Narrat0r"), (3, "x"), (4, "Harbor Master")], "temp_id long, name string")
    assert {r.temp_id: r.uuid for r in graph.exact_resolution(mentions, known).collect()} == {1: "u1", 2: None, 3: "u2", 4: None}
    assert [r.g for r in spark.createDataFrame([("She",), ("the guard",), ("Elara",)], "n string").select(graph.is_generic(F.col("n")).alias("g")).collect()] == [True, True, False]


NARRATOR = ("uuid-n", "Narrator", "Character", ["The Narrator"], 0)
SHE = ("uuid-she", "She", "Character", [], 0)


@pytest.mark.parametrize(
    ("known", "threshold", "mentions", "want", "conflicts"),
    [
        ([NARRATOR], 0.85, [("Narrator", False)], [("ontology", "uuid-n", None, False)], 0),
        ([NARRATOR], 0.85, [("Narrator", True)], [("ontology", "uuid-n", None, True)], 0),
        ([NARRATOR], 0.6, [("Narrat0r", True)], [("conflict", "uuid-n", None, False)], 1),
        ([NARRATOR], 0.95, [("Harbor Master", True)], [("new", None, None, False)], 0),
        ([NARRATOR], 0.6, [("Narrator", True), ("Narrat0r", True)], [("ontology", "uuid-n", None, True), ("conflict", "uuid-n", None, False)], 1),
        ([SHE], 0.6, [("Elara", True)], [("generic_placeholder_upgrade", "uuid-she", "She", False)], 0),
    ],
)
def test_resolution_cascade(spark, known, threshold, mentions, want, conflicts):
    ontology = spark.createDataFrame(known, "uuid string, name string, type string, aliases array<string>, position long")
    frame = spark.createDataFrame([(i, n, "Character", new) for i, (n, new) in enumerate(mentions)], "temp_id long, name string, type string, is_new boolean")
    out = resolution.resolve(frame, ontology, threshold)
    assert [(r.outcome, r.uuid, r.old_name, r.is_new_mismatch) for r in out.orderBy("temp_id").collect()] == want
    assert resolution.metrics(out).first().fuzzy_conflicts == conflicts
    if conflicts:
        with pytest.raises(resolution.ResolutionConflict) as raised:
            resolution.checked(out)
        assert [r.temp_id for r in raised.value.conflicts] == [len(mentions) - 1]
    else:
        assert resolution.checked(out) is out


def test_near_names_lose_none(spark):
    import random

    rng = random.Random(4)
    names = ["".join(rng.choices("abcd ", k=rng.randrange(1, 9))) for _ in range(120)]
    known = spark.createDataFrame([(f"u{i}", n, i) for i, n in enumerate(names[:60])], "uuid string, name string, position long")
    asked = spark.createDataFrame(list(enumerate(names[60:])), "temp_id long, name string")
    for threshold in (0.6, 0.85, 1.0):
        found = {r.temp_id: (r.uuid, r.score) for r in resolution.near_names(asked, known, threshold).collect()}
        for i, n in enumerate(names[60:]):
            score, at = max((graph.indel_ratio(n, m), -k) for k, m in enumerate(names[:60]))
            assert found.get(i) == ((f"u{-at}", score) if score >= threshold * 100 else None)


def test_depth_has_no_limit_and_cycles_are_errors(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 101)], "node long, parent long")
    assert {r.node: r.depth for r in annotated.hypernym_depth(chain).collect()} == {i: i for i in range(1, 101)}
    with pytest.raises(ValueError):
        annotated.hypernym_depth(spark.createDataFrame([(1, 2), (2, 1)], "node long, parent long"))


def test_similes(spark):
    words = [("she", 1, "nsubj"), ("ran", 1, "ROOT"), ("like", 1, "prep"), ("the", 4, "det"), ("wind", 2, "pobj")]
    tokens = spark.createDataFrame([(1, 1, i, w, w, "X", d, h) for i, (w, h, d) in enumerate(words)], "doc_id long, sentence long, idx long, token string, lemma string, pos string, dep string, head long")
    found = annotated.similes(tokens)
    assert [(r.left_text, r.right_text) for r in found.collect()] == [("she ran like the wind", "like the wind")]
    vectors = spark.createDataFrame([("she ran like the wind", [1.0, 0.0]), ("like the wind", [0.8, 0.6])], "text string, v array<double>")
    assert [(r.gain, r.label) for r in annotated.rated_similes(found, vectors, ["blind as"]).collect()] == [(0.2, "WEAK_OR_FUNCTIONAL")]
    assert [r.label for r in annotated.rated_similes(found, vectors, ["the wind"]).collect()] == ["CLICHE"]


def test_linkage_of_components_equals_linkage_of_all(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vector_index, "BLOCK", 15)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 6))
    v = np.concatenate([c + 0.35 * rng.standard_normal((8, 6)) for c in centres])
    label = learned.average_linkage(v, 0.85)
    want = {i: int(x) for i, x in enumerate(label) if (label == x).sum() > 1}
    frame = spark.createDataFrame([(i, 0, x.tolist()) for i, x in enumerate(v)], "vec_id long, label int, embedding array<double>")
    assert {r.vec_id: r.cluster_id for r in learned.linkage_clusters(frame, 0.85).collect()} == want


def test_coherence_equals_brute_force(spark):
    import numpy as np

    texts = ["harbor boat water sailor storm harbor boat", "castle knight sword castle", "harbor storm knight boat water", "sword knight castle harbor sailor storm water boat sword", "empty"]
    topics = [(0, "harbor"), (0, "boat"), (0, "storm"), (1, "castle"), (1, "knight"), (1, "harbor")]
    size, windows = 4, []
    for t in texts:
        own = [w for w in py_tokens(t) if len(w) >= 3 and w not in lx.STOPWORDS]
        windows += [set(own[i : i + size]) for i in range(max(1, len(own) - size + 1)) if own]
    p = lambda *w: sum(all(x in win for x in w) for win in windows) / len(windows) + 1e-12
    want = {}
    for k in (0, 1):
        own = [w for t, w in topics if t == k]
        m = np.array([[math.log(p(a, b) / (p(a) * p(b))) / -math.log(p(a, b)) for b in own] for a in own])
        s = m.sum(axis=0)
        want[k] = float(np.mean([x @ s / np.linalg.norm(x) / np.linalg.norm(s) for x in m]))
    found = learned.coherence(rows(spark, texts), spark.createDataFrame(topics, "topic int, term string"), size)
    assert all(math.isclose(r.coherence, want[r.topic], abs_tol=1e-3) for r in found.collect())


def test_lda_reads_every_term(spark):
    texts = ["harbor boat water " * 5, "castle knight sword " * 5, "rareword harbor boat"]
    shares = learned.lda_documents(rows(spark, texts), 2).groupBy("doc_id").agg(F.sum("weight").alias("s")).collect()
    assert len(shares) == 3 and all(abs(r.s - 1) < 1e-4 for r in shares)
    assert "rareword" in {r.term for r in learned.lda_topics(rows(spark, texts), 2, k=7).collect()}


def test_topics_equal_plain_passes(spark, monkeypatch):
    """Blocks and shards give what one loop over all texts and a dense matrix of terms and topics gives."""
    import numpy as np
    from quillmill.operators import topics

    monkeypatch.setattr(topics, "TOKENS", 120)
    monkeypatch.setattr(topics, "TERMS", 40)
    monkeypatch.setattr(topics, "PAIRS", 25)
    rng = np.random.default_rng(8)
    own = [[f"{'abc'[i % 3]}{int(rng.zipf(1.6)) % 30}" for _ in range(int(rng.integers(1, 60)))] + [f"only{i}"] for i in range(45)]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(own)], "doc_id long, own array<string>")
    model = topics.Model(frame, 3, 7, 4)
    assert model.packed.count() > 5 and model.state.select("shard").distinct().count() > 3
    seeds = {r.w: r.h for r in frame.select(F.explode("own").alias("w")).distinct().withColumn("h", F.xxhash64("w")).collect()}
    words = sorted(seeds)
    weights, alpha = topics.first_weights(np.array([seeds[w] for w in words]), 3, 7), np.full(3, 1 / 3)
    counts = np.array([[x.count(w) for w in words] for x in own], float)

    def infer(beta):
        gamma = np.array([alpha + c.sum() / 3 for c in counts])
        for d, c in enumerate(counts):
            for _ in range(100):
                share = np.exp(topics.digamma(gamma[d]) - topics.digamma(gamma[d].sum()))
                now = alpha + share * (beta.T @ (c / (beta @ share)))
                far, gamma[d] = np.abs(now - gamma[d]).mean(), now
                if far <= 1e-3:
                    break
        return gamma

    for turn in range(1, 5):
        beta, rate = np.exp(topics.digamma(weights) - topics.digamma(weights.sum(axis=0))), (1024 + turn) ** -0.51
        gamma = infer(beta)
        logs = topics.digamma(gamma) - topics.digamma(gamma.sum(axis=1))[:, None]
        share = np.exp(logs)
        found = beta * ((counts / (share @ beta.T)).T @ share)
        weights = (1 - rate) * weights + rate * (found + 1 / 3)
        n, mean = len(own), logs.mean(axis=0)
        slope = n * (topics.digamma(alpha.sum()) - topics.digamma(alpha) + mean)
        q, c = -n * topics.trigamma(alpha), n * topics.trigamma(alpha.sum())
        alpha = alpha - rate * (slope - (slope / q).sum() / (1 / c + (1 / q).sum())) / q
    assert np.allclose(model.alpha, alpha, rtol=1e-4) and np.allclose(model.totals, weights.sum(axis=0), rtol=1e-5)
    want = infer(np.exp(topics.digamma(weights) - topics.digamma(weights.sum(axis=0))))
    got = {(r.doc_id, r.topic): r.weight for r in model.shares().collect()}
    assert all(abs(got[d, k] - x) < 1e-3 for d, row in enumerate(want / want.sum(axis=1)[:, None]) for k, x in enumerate(row)) and len(got) == want.size
    for r in model.top(5).collect():
        order = np.argsort(-weights[:, r.topic])
        assert abs(r.weight - weights[words.index(r.term), r.topic] / weights[:, r.topic].sum()) < 1e-5 and r.term in {words[i] for i in order[:6]}
    none = topics.Model(frame.filter("false"), 3, 7, 2)
    assert none.top(5).count() == 0 and none.shares().count() == 0


def test_bursts_report_every_term(spark):
    found = {r.term: (r.global_count, r.max_z, r.burst_windows) for r in windows.burst_terms(rows(spark, ["harbor boat harbor"])).collect()}
    assert found == {"harbor": (2, 0.0, 0), "boat": (1, 0.0, 0), "harbor boat": (1, 0.0, 0), "boat harbor": (1, 0.0, 0), "harbor boat harbor": (1, 0.0, 0)}
    assert one(spark, "Don't stop: it's well-known, 42 Naïve!", tx.entropy_tokens) == ["do", "n't", "stop", "it", "'s", "wellknown", "nave"]


def test_events_applied_twice_give_the_same(spark):
    batch = spark.createDataFrame([("ch", "e1", 0, "first"), ("ch", "e2", 1, None)], "chapter_id string, event_id string, position long, description string")
    stored = events.event_rows(batch.limit(0))
    once = events.upsert_events(stored, batch)
    assert sorted(map(str, once.collect())) == sorted(map(str, events.upsert_events(once, batch).collect()))
    assert {r.uuid for r in once.collect()} == {str(uuid.uuid5(uuid.NAMESPACE_DNS, f"ch:{e}")) for e in ("e1", "e2")}
    none = spark.createDataFrame([], "uuid string, entity_uuid string, attribute string, value string, valid_from string, valid_until string, closed_at string, created_at string")
    changes = spark.createDataFrame([("u", "mood", "e1", "glad", 0, "t0"), ("u", "mood", "e2", "sad", 1, "t1")], "entity_uuid string, attribute string, event_id string, value string, position long, at string")
    first = events.apply_states(none, changes.filter("position = 0"))
    both = events.apply_states(first, changes)
    assert {(r.value, r.valid_until, r.closed_at) for r in both.collect()} == {("glad", "e2", "t1"), ("sad", None, None)}
    assert sorted(map(str, both.collect())) == sorted(map(str, events.apply_states(both, changes).collect()))
    with pytest.raises(Exception, match="Unsupported timestamp"):
        names = "uid string, timestamp string, location_name string, parent_uid string"
        events.logged(spark.createDataFrame([("e", "soon", "x", None)], names), spark.createDataFrame([], "event_uid string, uid string, role string"), spark.createDataFrame([], "uid string"), spark.createDataFrame([], "uid string")).collect()


def test_state_history_is_idempotent(spark):
    changes = spark.createDataFrame([("e", "mood", 1, "a"), ("e", "mood", 3, "b"), ("e", "age", 2, "c")], "entity string, attribute string, at long, event string")
    once = sorted(map(tuple, graph.state_history(changes, ["entity", "attribute"], "at", "event").collect()))
    assert once == sorted(map(tuple, graph.state_history(changes.union(changes), ["entity", "attribute"], "at", "event").collect()))
    assert sum(r[-1] for r in once) == 2


def test_average_linkage():
    import numpy as np

    v = np.array([[1, 0], [0.99, 0.1], [0, 1], [0.05, 1], [-1, 0], [0, 0]], float)
    assert learned.average_linkage(v, 0.9).tolist() == [0, 0, 2, 2, 4, 5]


def test_empty_tables(spark):
    none = rows(spark, [])
    for f in (lexical.paragraph_entropy, lexical.surprisal, lexical.themes, lexical.bursts, windows.entropy_windows, windows.burst_terms, segments.links, segments.sentence_chunks, similarity.near_duplicate_clusters, findings.ending_score):
        assert f(none).count() == 0


def test_near_duplicates_meet_by_what_they_share(spark, monkeypatch):
    """All similar pairs, at any share of tokens and of bigrams, though few of the others meet."""
    rng = random.Random(5)
    word = lambda i: "w" + chr(97 + i // 26 % 26) + chr(97 + i % 26) + "x"
    texts = []
    for _ in range(12):
        base = [word(rng.randrange(500)) for _ in range(rng.choice([9, 20, 120]))]
        texts.append(base)
        for share in (0.02, 0.1, 0.15, 0.2, 0.3, 0.45):
            texts.append([word(rng.randrange(500)) if rng.random() < share else w for w in base])
        texts += [rng.sample(base, len(base)), rng.sample(base, len(base) * 9 // 10), base + base, base[: len(base) * 6 // 10]]
    sets = [(set(t), {f"{x} {y}" for x, y in zip(t, t[1:])}) for t in texts]
    jaccard = lambda x, y: len(x & y) / (len(x) + len(y) - len(x & y))
    expected = {}
    for j in range(len(texts)):
        for i in range(j):
            score = jaccard(sets[i][0], sets[j][0]) * 0.7 + jaccard(sets[i][1], sets[j][1]) * 0.3
            if min(len(texts[i]), len(texts[j])) >= 8 and score >= 0.58 and len(sets[i][0] & sets[j][0]) >= 5:
                expected[i, j] = round(score, 4)
    kept = []
    monkeypatch.setattr(similarity, "saved", lambda df, own=similarity.saved: kept.append(own(df)) or kept[-1])
    found = {(r.left_id, r.right_id): r.similarity for r in similarity.near_duplicate_pairs(rows(spark, [" ".join(t) for t in texts])).collect()}
    assert found.keys() == expected.keys() and all(abs(found[p] - expected[p]) < 1e-4 for p in expected)
    assert len(expected) <= kept[1].count() < len(texts) * (len(texts) - 1) / 2 / 4


def test_tokens_of_spans_are_shuffled_once(spark):
    texts = ["é don't 😀 stop " + "abc " * 200, "", None, "x" * 700]
    tokens = segments.token_offsets(rows(spark, texts))
    assert "Exchange" not in tokens._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r)[1:] for r in tokens.filter("doc_id = 0 AND token_index < 2").orderBy("token_index").collect()] == [(0, "don't", 2, 7), (1, "stop", 10, 14)]
    spans = spark.createDataFrame([(0, 0, 0, 600), (0, 1, 250, 260), (3, 2, 100, 650), (3, 3, 300, 301), (1, 4, 0, 9)], "doc_id long, span_id long, span_start long, span_end long")
    found = {r.span_id: (r.tokens, r.first_char, r.last_char) for r in segments.span_tokens(tokens, spans).collect()}
    assert found == {0: (149, 2, 602), 1: (3, 251, 262), 2: (1, 0, 700), 3: (1, 0, 700)}


def test_values_are_counted_within_their_rows(spark):
    """No exchange of paragraphs' words; only a paragraph that comes as several rows is added up."""
    schema = "manuscript_id string, doc_id long, text string"
    count = lambda rows: {tuple(r) for r in lexical.counted(spark.createDataFrame(rows, schema), F.split("text", " ")).collect()}
    rows = [("a", 1, "x y x z x"), ("a", 2, "y"), ("b", 3, None), (None, 4, "z z"), ("a", 5, "é é e")]
    want = {("a", 1, "x", 3), ("a", 1, "y", 1), ("a", 1, "z", 1), ("a", 2, "y", 1), (None, 4, "z", 2), ("a", 5, "é", 2), ("a", 5, "e", 1)}
    assert count(rows) == want
    assert count([*rows, ("a", 2, "y q"), (None, 4, "z")]) == want - {("a", 2, "y", 1), (None, 4, "z", 2)} | {("a", 2, "y", 2), ("a", 2, "q", 1), (None, 4, "z", 3)}
    for f in (lexical.themes, lexical.bursts):
        plan = f(spark.createDataFrame(rows, schema))._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in plan.splitlines() if "hashpartitioning" in x and "doc_id" in x]


def test_paragraphs_alike_by_chance_do_not_meet_and_copies_travel_together(spark, monkeypatch):
    """Texts that share a few rare words aren't compared; a group of copies is compared in parts that each have a paragraph once."""
    rng = random.Random(8)
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3)) + "qz"
    common = [word(i) for i in range(40)]
    texts = [[*rng.sample(common, 20), *[word(1000 + 10 * i + k) for k in range(10)], word(9000 + i % 30), word(9000 + i // 2 % 30)] for i in range(60)]
    group = [word(12000 + k) for k in range(30)]
    texts += [[w if rng.random() > 0.05 else word(13000 + 31 * i + k) for k, w in enumerate(group)] for i in range(30)] + [["two", "words"] * 5] * 2
    sets = [(set(t), set(zip(t, t[1:]))) for t in texts]
    jaccard = lambda x, y: len(x & y) / len(x | y)
    score = {(i, j): jaccard(sets[i][0], sets[j][0]) * 0.7 + jaccard(sets[i][1], sets[j][1]) * 0.3 for j in range(len(texts)) for i in range(j) if len(sets[i][0] & sets[j][0]) >= 5}
    expected = {p: round(s, 4) for p, s in score.items() if s >= 0.58}
    kept = []
    monkeypatch.setattr(similarity, "saved", lambda df, own=similarity.saved: kept.append(own(df)) or kept[-1])
    monkeypatch.setattr(similarity, "PART", 7)
    frame = rows(spark, [" ".join(t) for t in texts])
    found = {(r.left_id, r.right_id): r.similarity for r in similarity.near_duplicate_pairs(frame).collect()}
    assert found.keys() == expected.keys() and all(abs(found[p] - expected[p]) < 1e-4 for p in expected)
    met, sent = kept[1].count(), kept[-1].count()
    assert len(expected) > 400 and met <= len(expected) + 10 and sent < len(expected)
