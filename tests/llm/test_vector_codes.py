import hashlib
import math

import numpy as np
import pytest

from quillmill.llm import queries, vector_codes

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"


def brute(rows, parts=16, entries=64, rounds=2):
    """Lloyd's rounds over all parts anew, in whole numbers."""
    own = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    own.sort(key=lambda r: (r[0], r[1]))
    d = len(own[0][1]) // parts
    x = np.array([r[1] for r in own], np.int64).reshape(len(own), parts, d)
    books = x[:entries].transpose(1, 0, 2).copy()
    off = lambda: ((x[:, :, None, :] - books[None]) ** 2).sum(3)
    for _ in range(rounds):
        at = off().argmin(2)
        for p in range(parts):
            for e in range(books.shape[1]):
                if (at[:, p] == e).any():
                    mine = x[at[:, p] == e, p]
                    books[p, e] = mine.sum(0) // len(mine)
    at, error = off().argmin(2), off().min(2).sum(1)
    label = {}
    for r, e in zip(own, error):
        label[r[2]] = label.get(r[2], 0) + int(e)
    sha = hashlib.sha256(",".join(str(v) for v in books.ravel()).encode()).hexdigest()
    return sorted((r[0], "".join(f"{e:02x}" for e in a), int(e), label[r[2]], sha) for r, a, e in zip(own, at, error))


def found(df):
    return sorted(tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in df.collect())


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert found(queries.op13_vector_codes(spark, SF)) == brute(rows)


@pytest.mark.parametrize("few", [100_000, 0])
def test_odd_rows(spark, few, monkeypatch):
    monkeypatch.setattr(vector_codes, "FEW_LABELS", few)
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(32).astype("f4").tolist(), [None, 1, 2][i % 3]) for i in range(90)]
    rows += [(200 + i, rows[3][1], 1) for i in range(60)] + [(7, rows[7][1], 2)]  # a crowd of equal vectors, a repeated row
    odd = [(300, None, 1), (301, [None] * 32, 1), (302, [float("nan")] * 32, 1), (303, [float("inf")] * 32, 2), (304, [], 1)]
    table = spark.createDataFrame(rows + odd, VECTORS).selectExpr("*", "1 AS ints", "2 AS code", "3 AS moved", "4 AS error").repartition(5)
    assert found(vector_codes.codes(table)) == brute(rows)
    other = spark.createDataFrame(rows + [(400, [0.5] * 16, 1), (401, [float(1 << 18)] * 32, 1)], VECTORS)  # another length, too large: left out, as said
    assert found(vector_codes.codes(other)) == brute(rows)


def test_few_or_no_vectors(spark):
    assert vector_codes.codes(spark.createDataFrame([], VECTORS)).collect() == []
    assert vector_codes.codes(spark.createDataFrame([(1, None, 1)], VECTORS)).collect() == []
    rows = [(5, [0.1 * k for k in range(16)], None), (2, [-0.3 * k for k in range(16)], None)]
    assert found(vector_codes.codes(spark.createDataFrame(rows, VECTORS))) == brute(rows)
    with pytest.raises(ValueError, match="don't divide"):
        vector_codes.codes(spark.createDataFrame([(1, [1.0] * 10, 1)], VECTORS))


def test_a_settled_round_moves_nothing(spark):
    """Vectors on their entries never change: after the first round no sums are sent."""
    rows = [(i, [float(i % 8)] * 16, 1) for i in range(80)]
    table, moved = spark.createDataFrame(rows, VECTORS), []
    put = vector_codes.work.put

    def watched(df, tag):
        out = put(df, tag)
        moved.append(out.filter("moved IS NOT NULL").count())
        return out

    vector_codes.work.put = watched
    try:
        vector_codes.learn(table, entries=8, rounds=3)
    finally:
        vector_codes.work.put = put
    assert moved[0] > 0 and moved[1:] == [0, 0]


def test_large_components_stay_exact():
    rng = np.random.default_rng(2)
    parts, book = rng.integers(-(1 << 26), 1 << 26, (50, 4)), rng.integers(-(1 << 26), 1 << 26, (9, 4))
    at, off = vector_codes.nearest(parts, book)
    all_ = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, c)) for c in book] for x in parts]
    assert at.tolist() == [x.index(min(x)) for x in all_] and off.tolist() == [min(x) for x in all_]


def test_decode(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    table = spark.createDataFrame(rows, VECTORS)
    coded, books = vector_codes.encode(table)
    whole = {r[0]: np.floor(np.float64(r[1]) * 256) for r in rows}
    for r in vector_codes.decode(coded, books).collect():
        assert int(((np.array(r.approx) * 256 - whole[r.vec_id]) ** 2).sum()) == r.error
