"""Language identification and language-model scores."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmill.llm import language_id, lm_scoring, queries

SF = "/root/testdata/sf0.01"


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) + ["\n"]


def brute_scores(rows):
    """doc_id -> (held_out, n_tokens, n_known, train_tokens, base_score, score with exact membership)."""
    own = {i: _words(t) for i, t in rows}
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i in own}
    c, pairs = Counter(), Counter()
    for i, w in own.items():
        if not held[i]:
            c.update(w)
            pairs.update(zip(["\n", *w], w))
    n, v = sum(c.values()), len(c)
    prior = len(pairs) / max(1, v)

    def count(x):  # the mean of the counts of its level
        k = math.floor(math.log(x) / math.log(1.5) + 1e-9)
        own = [y for y in range(1, 2 * x + 3) if 1.5**k - 1e-9 <= y < 1.5 ** (k + 1) - 1e-9]
        return sum(own) / len(own)

    level = {x: count(x) for x in set(pairs.values())} | {0: 0.0}
    out = {}
    for i, w in own.items():
        base = score = 0.0
        for a, b in zip(["\n", *w], w):
            p = (c[b] + 0.5) / (n + 0.5 * (v + 1))
            base += math.log10(p)
            score += math.log10((min(level[pairs[a, b]], c[a], c[b]) + prior * p) / (c[a] + prior) if prior else p)
        out[i] = (held[i], len(w), sum(c[x] > 0 for x in w), n, base, score)
    return out


def test_lm_scores(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", 200_000)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_scores(rows)
    found = {r.doc_id: tuple(r)[1:] for r in queries.op2_lm_scoring(spark, SF).collect()}
    assert found.keys() == want.keys()
    for i, w in want.items():
        f = found[i]
        assert f[:4] == w[:4] and math.isclose(f[4], w[4], rel_tol=1e-9)
        assert f[5] >= w[5] - 1e-6 * abs(w[5])  # the filter's false hits can only raise a probability
    assert sum(f[5] for f in found.values()) - sum(w[5] for w in want.values()) <= 0.005 * -sum(w[5] for w in want.values())
    held = [f for f in found.values() if f[0]]
    assert sum(f[5] for f in held) > sum(f[4] for f in held)


def test_lm_odd_rows(spark, docs):
    rows = [(1, None), (2, ""), (3, "A a\x0bb"), (3, "A a\x0bb"), (None, "zz"), (4, "word " * 40_000), (9, "É é")]
    frame = docs(rows, "block long, shard int")
    want = brute_scores([r for k, r in enumerate(rows) if k != 3])
    assert lm_scoring.score(frame).count() == len(rows)
    found = {r.doc_id: r for r in lm_scoring.score(frame.dropDuplicates(["doc_id"])).collect()}
    for i, w in want.items():
        assert tuple(found[i])[1:5] == w[:4] and math.isclose(found[i].base_score, w[4], rel_tol=1e-9)
    assert lm_scoring.score(docs([])).count() == 0


def test_filter_has_no_false_misses_and_few_false_hits():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(0, 1 << lm_scoring.KEY_BITS, 20_000, dtype=np.uint64))
    counts = np.minimum(rng.zipf(1.5, len(keys)), 10**6)
    shards, entries = 3, int(lm_scoring.levels(counts).sum())
    size = 64 * (entries * lm_scoring.BITS // (64 * shards) + 1)
    shard = lm_scoring.shard_of(keys, shards)
    bits = b"".join(lm_scoring.LogFrequencyFilter.segment(keys[shard == s], counts[shard == s], size) for s in range(shards))
    f = lm_scoring.LogFrequencyFilter(np.frombuffer(bits, np.uint8), shards, size)
    assert (f.level(keys) >= lm_scoring.levels(counts)).all()
    assert (f.level(keys) > lm_scoring.levels(counts)).mean() < 0.03
    other = np.setdiff1d(rng.integers(0, 1 << lm_scoring.KEY_BITS, 20_000, dtype=np.uint64), keys)
    assert (f.level(other) > 0).mean() < 0.03


def test_lm_probabilities_sum_to_one(spark):
    """Scores of texts of one and two tokens give all probabilities after a token; counts up to 3 are exact."""
    rows = [(i, t) for i, t in enumerate(["a b a b c", "a c a d", "b a e", "d d d a", "e a b", "c c a b e"]) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = [i for i in range(1000, 4000) if zlib.crc32(str(i).encode()) % 5 == 1]
    vocabulary = ["a", "b", "c", "d", "e", "unknown"]
    asked = [(held.pop(), f"{h} {w}") for h in vocabulary for w in vocabulary] + [(held.pop(), h) for h in vocabulary]
    frame = spark.createDataFrame(rows + asked, "doc_id long, text string")
    score = {r.doc_id: r.score for r in lm_scoring.score(frame).collect()}
    of = {t: score[i] for i, t in asked}
    own = [_words(t) for _, t in rows]
    c, pairs = Counter(w for x in own for w in x), Counter(p for x in own for p in zip(["\n", *x], x))
    n, v, prior = sum(c.values()), len(c), len(pairs) / len(c)
    p = lambda h, w: (pairs[h, w] + prior * (c[w] + 0.5) / (n + 0.5 * (v + 1))) / (c[h] + prior)
    assert max(pairs.values()) <= 3
    for h in vocabulary:
        # P(h w end) / P(h end) * P(end | h) / P(end | w) = P(w | h)
        after = [10 ** (of[f"{h} {w}"] - of[h]) * p(h, "\n") / p(w, "\n") for w in vocabulary]
        assert abs(sum(after) + p(h, "\n") - 1) < 1e-9


def test_keys_survive_packing():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 1000, dtype=np.uint64))
    assert (lm_scoring._grow_keys(lm_scoring._squeeze_keys(keys)) == keys).all()
    assert len(lm_scoring._grow_keys(lm_scoring._squeeze_keys(keys[:0]))) == 0


def test_language_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    found = queries.op4_language_id(spark, SF).collect()
    assert {r.doc_id for r in found} == truth.keys()
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in found) <= 0.005 * len(found) and all(0 <= r.score <= 1 for r in found)


def test_language_odd_rows(spark, docs):
    rows = [(i, f"the house and the river number {i} with words of this kind", "en") for i in range(40)]
    rows += [(100 + i, f"das haus und der fluss nummer {i} mit worten dieser art", "de") for i in range(40)]
    rows += [(200, None, "en"), (201, "", "de"), (202, "123 !? ²", "de"), (203, "der fluss und das haus " * 20_000, None), (None, "the river and the house", "en"), (7, "the house", "en"), (7, "the house", "en")]
    frame = docs(rows, "lang string, score double, rejected boolean")
    found = [(r.doc_id, r.lang_pred, r.score) for r in language_id.query(frame).collect()]
    by = {x[0]: x[1:] for x in found}
    assert len(found) == len(rows) and by[200] == by[201] == by[202] == ("und", 0.0)
    assert by[203][0] == "de" and by[None][0] == "en" and by[7][0] == "en"
    assert language_id.query(docs([])).count() == 0
    assert {r.lang_pred for r in language_id.query(docs([(1, "some text", None)])).collect()} == {"und"}


@pytest.mark.parametrize("text", ["", "a", "ab", "x" * (2 * language_id.STEP + 5)])
def test_grams_cover_whole_texts(text):
    n = sum(map(len, language_id._grams(text)))
    size = len(" ".join(text.split())) + 2
    assert n == sum(max(0, size - k + 1) for k in language_id.ORDERS)


def test_language_prediction_equals_plain_formula(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.learn(docs)
    buckets = model.embeddings.shape[0]
    rows = docs.select("doc_id", "text").collect()
    found = {r.doc_id: r for r in language_id.predict(docs, model, ["doc_id"]).collect()}
    for r in rows:
        if not any(map(str.isalpha, r.text or "")):
            assert found[r.doc_id].lang_pred == "und" and found[r.doc_id].score == 0
            continue
        raw = b" " + b" ".join(r.text.encode().lower().split()) + b" "
        total, n = np.zeros(model.embeddings.shape[1]), 0
        for size in (2, 3, 4):
            for k in range(len(raw) - size + 1):
                h = raw[k]
                for c in raw[k + 1 : k + size]:
                    h = (h * 0x01000193 + c) % 2**32
                h = ((h ^ h >> 15) * (0x85EBCA6B + 2 * size)) % 2**32
                total += model.embeddings[h * buckets >> 32]
                n += 1
        x = (total / n @ model.weights + model.bias) / model.temperature
        p = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
        assert abs(found[r.doc_id].score - p.max()) < 1e-4 and (found[r.doc_id].lang_pred == model.languages[int(p.argmax())] or np.sort(p)[-1] - np.sort(p)[-2] < 1e-4)


def test_every_label_can_be_learned(spark, docs):
    rows = [(k * 10 + i, (chr(0x4E00 + 3 * k) + chr(0x4E01 + 3 * k) + " ") * (8 + i), f"l{k:03}") for k in range(300) for i in range(6)]
    assert len(language_id.learn(docs(rows)).languages) == 300


@pytest.mark.parametrize("ids", [range(0, 400, 10), range(0, 200, 5), range(40)])
def test_rows_are_held_back_whatever_their_ids(docs, ids):
    """Ids in steps of 5 or 10: of each label some rows train and some calibrate; a label with one row trains."""
    words = {"en": "the house and the garden were quiet", "de": "der garten und das haus waren still", "fr": "le jardin et la maison"}
    rows = [(i, f"{words[lang]} {i}", lang) for k, i in enumerate(ids) for lang in [["en", "de"][k % 2]]] + [(10_001, words["fr"], "fr")]
    own = language_id.sample(docs(rows), F.lit(True))
    held = {lang: [h for x, _, h in own if x == lang] for lang in words}
    assert all(0 < sum(held[x]) < len(held[x]) for x in ("en", "de")) and held["fr"] == [False]
    model = language_id.learn(docs(rows))
    assert {r.doc_id: r.lang_pred for r in language_id.predict(docs(rows), model, ["doc_id"]).collect() if r.doc_id != 10_001} == {r[0]: r[2] for r in rows[:-1]}
