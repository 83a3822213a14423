"""Properties that hold for any text."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillmill.functions import lexicons as lx
from quillmill.operators import findings, graph, lexical, segments

TEXTS = st.lists(st.text(alphabet="abAB é'.!?\n#-12", max_size=60), min_size=1, max_size=12)
ANY = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def rows(spark, texts):
    return spark.createDataFrame([("m", i, t) for i, t in enumerate(texts)], "manuscript_id string, doc_id long, text string")


@ANY
@given(TEXTS)
def test_entropy_and_density_bounds(spark, texts):
    for r in lexical.paragraph_entropy(rows(spark, texts)).collect():
        assert 0 <= r.normalized_entropy <= 1.001 and 0 <= r.entropy <= math.log2(max(1, r.token_count)) + 1e-3
    for r in lexical.type_token_density(rows(spark, texts)).collect():
        assert 0 <= r.lexical_density <= 1 and (r.token_count == 0 or abs(r.content_density + r.stopword_ratio - 1) < 1e-3)


@ANY
@given(TEXTS)
def test_token_offsets_point_at_tokens(spark, texts):
    for r in segments.token_offsets(rows(spark, texts)).collect():
        assert texts[r.doc_id][r.start : r.end] == r.token


@ANY
@given(TEXTS)
def test_chunks_hold_all_sentences(spark, texts):
    counts = {r.doc_id: r["count"] for r in segments.sentences(rows(spark, texts)).groupBy("doc_id").count().collect()}
    got = {}
    for r in segments.sentence_chunks(rows(spark, texts), 5).orderBy("doc_id", "chunk_index").collect():
        assert r.first_sentence == got.get(r.doc_id, 0) + 1
        got[r.doc_id] = r.last_sentence
    assert got == counts


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", max_size=12), st.text(alphabet="abc", max_size=12))
def test_ratios_are_symmetric_and_bounded(a, b):
    for f in (graph.indel_ratio, graph.token_set_ratio, graph.partial_ratio):
        assert 0 <= f(a, b) <= 100 and math.isclose(f(a, b), f(b, a)) and f(a, a) == 100.0


def test_delta_is_antisymmetric(spark):
    m = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 3.5), ("a", "y", 1.0)], "run_id string, metric string, value double")
    there, back = findings.metric_delta(m, "a", "b").collect(), findings.metric_delta(m, "b", "a").collect()
    assert [r.metric for r in there] == ["x"] and there[0].delta == -back[0].delta == 2.5


def test_fixed_lists_have_no_repeats():
    for name in ("STOPWORDS", "THEME_BLOCKLIST", "DENSITY_STOPWORDS", "ENDING_PHRASES"):
        own = getattr(lx, name)
        assert len(own) == len(set(own))
