"""Vector index, linkage and retrieval against all pairs."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillmill.operators import learned, resolution, retrieval, vector_index


def vectors(spark, x, groups=None, ids=None):
    rows = [(int(ids[i]) if ids is not None else i, [float(v) for v in row] if row is not None else None, int(groups[i]) if groups is not None else 0) for i, row in enumerate(x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def clouds(seed, n, d, centres, spread):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, d))
    return (c[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, d))).astype(np.float64)


@pytest.mark.parametrize("threshold", [0.3, 0.85, 0.99])
@pytest.mark.parametrize("block", [1_000, 17])
def test_within_loses_nothing(spark, threshold, block, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", block)
    x = np.concatenate([clouds(1, 300, 12, 15, 0.3), np.zeros((2, 12)), np.repeat(clouds(2, 1, 12, 1, 0.1), 30, axis=0), clouds(3, 60, 12, 60, 1.0)])
    group = np.arange(len(x)) % 3
    pairs, sizes = vector_index.within(vector_index.build(vectors(spark, x, group), "vec_id", "embedding", "label"), threshold)
    size = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    cosine = unit @ unit.T
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if group[i] == group[j] and cosine[i, j] >= threshold}
    found = [(r.a, r.b) for r in pairs.collect()]
    assert len(found) == len(set(found)) and set(found) == want
    all_pairs = sum(n * (n - 1) // 2 for n in Counter(group.tolist()).values())
    assert vector_index.comparisons(sizes) <= all_pairs
    if threshold == 0.99:
        assert vector_index.comparisons(sizes) < all_pairs / 3  # cells rule most of them out


def test_exactly_at_the_threshold(spark):
    x = [[3.0, 4.0], [4.0, 3.0], [1.0, 0.0], None, [float("nan"), 1.0], [], [1.0], [0.0, 0.0]]
    pairs, _ = vector_index.within(vector_index.build(vectors(spark, x), "vec_id", "embedding"), 0.96)
    assert [(r.a, r.b) for r in pairs.collect()] == [(0, 1)]
    assert vector_index.within(vector_index.build(vectors(spark, []), "vec_id", "embedding"), 0.5)[0].count() == 0
    with pytest.raises(ValueError, match="above 0"):
        vector_index.within(vector_index.build(vectors(spark, x), "vec_id", "embedding"), 0.0)


@pytest.mark.parametrize("block", [1_000, 9])
@pytest.mark.parametrize("k", [1, 4, 500])
def test_top_loses_nothing(spark, k, block, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", block)
    x = np.concatenate([clouds(5, 150, 6, 8, 0.2), np.zeros((2, 6)), np.repeat([[1.0, 0, 0, 0, 0, 0]], 8, axis=0)])
    q = np.concatenate([x[:5], clouds(6, 6, 6, 6, 1.0), np.zeros((1, 6)), [[1.0, 0, 0, 0, 0, 0]]])
    index = vector_index.build(vectors(spark, x), "vec_id", "embedding")
    asked = vectors(spark, q).withColumnRenamed("vec_id", "query")
    unit = lambda m: np.divide(m, n, out=np.zeros_like(m), where=n > 0) if (n := np.linalg.norm(m, axis=1, keepdims=True)) is not None else m
    cosine = np.floor(unit(q) @ unit(x).T * 1e6 + 0.5) / 1e6
    for others in (False, True):
        got = {}
        for r in vector_index.top(index, asked, "query", "embedding", k, others).collect():
            got.setdefault(r["query"], []).append((r["rank"], r["item"], r.cosine))
        for i in range(len(q)):
            best = sorted((-cosine[i, j], j) for j in range(len(x)) if not (others and i == j))[:k]
            own = sorted(got[i])
            assert [(n, j) for n, j, _ in own] == [(n + 1, j) for n, (_, j) in enumerate(best)] and np.allclose([c for _, _, c in own], [-c for c, _ in best], atol=1e-6)


def test_visits_of_every_cell_stay_small():
    """A batch whose vectors visit every cell is never laid out whole."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000)), pa.array([[0.5] * 64] * 10_000)], ["query", "v"])
    before, most, sent = pa.total_allocated_bytes(), 0, 0
    for few in vector_index._few(iter([batch])):
        at, cell = np.nonzero(np.ones((few.num_rows, 100), bool))
        for part in vector_index._sent(few, ["query", "v"], at, cell):
            most, sent = max(most, pa.total_allocated_bytes() - before), sent + part.num_rows
    assert sent == 1_000_000 and most < 20e6


def by_matrix(x, threshold):
    """Average linkage that always joins the nearest two clusters, with all averages held."""
    size = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    parts = {i: [i] for i in range(len(x))}
    while len(parts) > 1:
        best = max(((round(float((unit[parts[i]] @ unit[parts[j]].T).mean()), 10), -i, -j) for i in parts for j in parts if i < j))
        if best[0] < threshold:
            break
        parts[-best[1]] += parts.pop(-best[2])
    label = np.zeros(len(x), int)
    for i, own in parts.items():
        label[own] = i
    return label


@pytest.mark.parametrize("seed", range(6))
def test_linkage_equals_joining_the_nearest(seed):
    x = clouds(seed, 40, 4, 6, 0.4)
    if seed % 2:
        x = np.round(x)  # many ties and equal vectors
        x[::7] = x[0]
    for threshold in (0.3, 0.7, 0.9):
        assert learned.average_linkage(x, threshold).tolist() == by_matrix(x, threshold).tolist()


def test_linkage_of_a_large_component():
    """30,000 vectors, for which all distances would take 7 GB."""
    x = clouds(4, 30_000, 8, 300, 0.05)
    label = learned.average_linkage(x, 0.8)
    assert 2 <= len(set(label.tolist())) <= 300 and all(label[label] == label)


def test_vector_conflicts(spark):
    known = spark.createDataFrame([("u1", "Ada Stone", "Character", [1.0, 0.0]), ("u2", "Old Mill", "Location", [0.0, 1.0])], "uuid string, name string, type string, v array<double>")
    rows = [(1, "the tall man", "Character", True, [0.99, 0.05]), (2, "Mill", "Character", True, [0.0, 2.0]), (3, "Someone", None, True, [0.0, 1.0]), (4, "Else", None, False, [0.0, 1.0]), (5, "Far", None, True, [-1.0, 0.1]), (6, "Null", None, True, None)]
    found = {r.temp_id: (r.uuid, r.must_ask) for r in resolution.vector_conflicts(spark.createDataFrame(rows, "temp_id long, name string, type string, is_new boolean, v array<double>"), known).collect()}
    assert found == {1: ("u1", True), 3: ("u2", False)}


def bm25(texts, query, k):
    """Every text scored."""
    own = [re.findall("[a-z0-9']+", (t or "").lower()) for t in texts]
    mean = sum(map(len, own)) / len(own)
    out = []
    for i, words in enumerate(own):
        counts, score = Counter(words), 0.0
        for t in set(re.findall("[a-z0-9']+", query.lower())):
            df = sum(t in w for w in own)
            if counts[t]:
                score += math.log(1 + (len(own) - df + 0.5) / (df + 0.5)) * counts[t] / (counts[t] + 1.2 * (0.25 + 0.75 * len(words) / mean))
        if counts.keys() & set(re.findall("[a-z0-9']+", query.lower())):
            out.append((-round(score, 6), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


@pytest.mark.parametrize("k", [1, 3, 1_000])
def test_bm25_equals_scoring_every_text(spark, k, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 8)
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words, p=(p := np.arange(60, 0, -1) ** 2.0) / p.sum(), size=rng.integers(1, 60))) for _ in range(200)]
    for i in range(64, 72):
        texts[i] += " needle" * (i - 60)
    texts += [None, "", "!!"]
    asked = ["needle w1", "w0 w1 w2 w3", "W59 w58, w59", "unknown", ""]
    index = retrieval.build(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found, opened = retrieval.search(index, spark.createDataFrame(list(enumerate(asked)), "query long, text string"), k)
    got = {}
    for r in found.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["item"], r.score))
    for i, q in enumerate(asked):
        want = bm25(texts, q, k)
        assert [x[0] for x in got.get(i, [])] == [x[0] for x in want] and np.allclose([x[1] for x in got.get(i, [])], [x[1] for x in want], atol=2e-6)
    counts = {r["query"]: (r.blocks, r.opened) for r in opened.collect()}
    assert all(o <= b for b, o in counts.values())
    if k == 1:
        assert counts[0][1] < counts[0][0]  # the blocks that can't have the best text stay closed


def test_hybrid_and_its_degraded_modes(spark):
    items = spark.createDataFrame([(1, "red house", [1.0, 0.0]), (2, "blue house", [0.8, 0.6]), (3, "green tree", [0.0, 1.0])], "doc_id long, text string, v array<double>")
    asked = spark.createDataFrame([("a", "house tree", [0.0, 1.0])], "query string, text string, v array<double>")
    words, vecs = retrieval.build(items), vector_index.build(items, "doc_id", "v")
    both = retrieval.hybrid(asked, 3, words, vecs).orderBy("rank").collect()
    assert [r.item for r in both] == [3, 1, 2] and {r.mode for r in both} == {"hybrid"} and both[0].score == round(2 / 61, 9)
    with pytest.warns(UserWarning, match="text only"):
        assert [r.item for r in retrieval.hybrid(asked, 1, words, None).collect()] == [3]
    with pytest.warns(UserWarning, match="vector only"):
        assert {r.mode for r in retrieval.hybrid(asked, 2, None, vecs).collect()} == {"vector only"}
    with pytest.raises(retrieval.RetrievalError):
        retrieval.hybrid(asked, 1, None, None)


def test_bm25_scores_blocks_where_they_lie(spark, monkeypatch):
    """Copies that tie across blocks, repeated items and bunches of two queries; no row for a query and a text of it is shuffled."""
    monkeypatch.setattr(retrieval, "BLOCK", 5)
    monkeypatch.setattr(retrieval, "BUNCH", 2)
    texts = ["a b", "a b c", "b c d d", "a b", "e", "a a b"] * 7
    asked = ["a", "b d", "c e", "a b", "e", "d d d", "a"]
    index = retrieval.build(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    found, _ = retrieval.search(index, spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(asked)], "query string, text string"), 4)
    got = {}
    for r in found.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["item"], r.score))
    for i, q in enumerate(asked):
        assert got[f"q{i}"] == [(j, pytest.approx(s, abs=2e-6)) for j, s in bm25(texts, q, 4)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" in plan and "explode(docs" not in plan
    one = retrieval.search(retrieval.build(spark.createDataFrame([(1, "x y"), (1, "x z"), (2, None)], "doc_id long, text string")), spark.createDataFrame([(0, "x")], "query long, text string"), 5)[0]
    assert [(r["item"], r["rank"]) for r in one.orderBy("rank").collect()] == [(1, 1), (1, 2)]
