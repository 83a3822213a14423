import numpy as np
import pytest

from quillmill.llm import embedding_dedup, queries
from quillmill.llm.grouped import roots


def brute(ids, vectors, threshold=0.9):
    """(n_links, component) of each row; a row that can't link has vector None."""
    own = [i for i, v in enumerate(vectors) if v is not None]
    x = np.array([vectors[i] for i in own], np.float64)
    norm = np.linalg.norm(x, axis=1)
    near = x @ x.T / np.outer(norm, norm) >= threshold
    np.fill_diagonal(near, True)
    root = roots(len(own), *np.nonzero(near))
    out = {i: (0, ids[i]) for i in range(len(ids))}
    for k, i in enumerate(own):
        out[i] = (int(near[k].sum()) - 1, min(ids[own[m]] for m in np.flatnonzero(root == root[k])))
    return out


def test_recall_on_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    want = brute([r.vec_id for r in rows], [r.embedding for r in rows])
    want = {r.vec_id: want[i] for i, r in enumerate(rows)}
    found = {r.vec_id: (r.n_links, r.component_id) for r in queries.op6_embedding_dedup(spark, "/root/testdata/sf0.001").collect()}
    assert found.keys() == want.keys()
    assert all(found[k][0] <= want[k][0] for k in want)  # never a link below the threshold
    assert sum(x[0] for x in found.values()) >= 0.98 * sum(x[0] for x in want.values())
    assert sum(found[k][1] == want[k][1] for k in want) >= 0.98 * len(want)


@pytest.mark.parametrize("block", [1_500, 20])
def test_crowd_and_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(2)
    centre = rng.standard_normal(16)
    vectors = [(centre + 0.1 * rng.standard_normal(16)).tolist() for _ in range(120)] + [centre.tolist()] * 60 + rng.standard_normal((80, 16)).tolist()
    ids = list(range(len(vectors)))[::-1]
    want = brute(ids, vectors)
    frame = spark.createDataFrame(list(zip(ids, vectors)), "vec_id long, embedding array<double>")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame).collect()}
    exact = sum(found[i] == want[k] for k, i in enumerate(ids))
    assert exact >= 0.97 * len(ids) and all(found[i][0] <= want[k][0] for k, i in enumerate(ids))


def test_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0], 3), (2, [2.0, 0.0], 3), (2, [2.0, 0.0], 3), (3, None, 1), (4, [0.0, 0.0], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1),
        (7, [None, 1.0], 1), (8, [], 1), (9, [1.0, 0.0, 0.0], 1), (None, [-0.0, 3.0], 1), (11, [0.0, 3.0], 1), (12, [-1.0, 0.0], 1),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n int")
    found = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in embedding_dedup.near_duplicates(frame).collect())
    single = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 12)]
    assert found == sorted([(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (0, 1, 11, False), (11, 1, 11, True), *single])
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_very_large_and_small_components(spark):
    rows = [(1, [1e160, 2e160]), (2, [1e160, 2.1e160]), (3, [1e-170, 2e-170]), (4, [1e-320, -2e-320]), (5, [3e160, -6e160])]
    found = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert found == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (1, 4), 5: (1, 4)}


@pytest.mark.parametrize(("bits", "n"), [(9, 3_000), (13, 2_000)])
def test_recall_with_as_many_bits_as_large_tables_have(spark, monkeypatch, bits, n):
    """Pairs near the threshold, found with the bits and tables of 65,000 and of a million vectors."""
    shape = embedding_dedup.shape
    monkeypatch.setattr(embedding_dedup, "shape", lambda _, threshold, recall: shape(128 << bits, threshold, recall))
    rng = np.random.default_rng(bits)
    base = rng.standard_normal((n // 2, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.standard_normal(base.shape)
    other -= (other * base).sum(axis=1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    cosine = rng.uniform(0.895, 0.92, (len(base), 1))
    vectors = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * other])
    want = brute(list(range(len(vectors))), list(vectors))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(frame).collect()}
    assert all(found[i] <= want[i][0] for i in want)
    assert sum(found.values()) >= 0.98 * sum(w[0] for w in want.values())


def test_shape():
    assert embedding_dedup.shape(0) == embedding_dedup.shape(500)
    assert embedding_dedup.shape(10**6)[0] == 13
