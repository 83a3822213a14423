import hashlib
import math
import re
from collections import Counter
from itertools import combinations

import corpus_pipeline
import numpy as np
import pytest

from quillmill.llm import near_copies, work

SF = "/root/testdata/sf0.01"


def _sets(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else []))
    return out


def _groups(sets, similarity=0.8):
    label = list(range(len(sets)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in combinations(range(len(sets)), 2):
        a, b = sets[i], sets[j]
        if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and len(a & b) >= similarity * len(a | b):
            label[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def test_near_copies_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(docs.select("doc_id", "text").collect())
    want = {rows[g].doc_id for g in _groups(_sets([r.text for r in rows]))}
    found = [r.doc_id for r in near_copies.deduplicate(docs).select("doc_id").collect()]
    assert len(found) == len(set(found)) and len(want ^ set(found)) <= 1


def test_shards_pairs_come_out_of_a_tree(monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**64, (6, 4), np.uint64)
    flips = np.packbits(rng.random((120, 256)) < 0.13, axis=1).view(np.uint64)
    values = np.concatenate([base[rng.integers(0, 6, 120)] ^ flips, base, base[:2]])
    trees = []

    class Tree(near_copies.BKTree):
        def __init__(self, own):
            super().__init__(own)
            trees.append(self)

    monkeypatch.setattr(near_copies, "BKTree", Tree)
    a, b, d = near_copies.near_pairs(values, 62)
    far = near_copies.distance(values[:, None], values[None])
    x, y = np.nonzero(np.triu(far <= 62, 1))
    assert len(trees) == 1 and len(trees[0].nodes) == len(values) and len(x) > 500
    assert (a == x).all() and (b == y).all() and (d == far[x, y]).all()


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_near_copies_in_a_crowd(spark, docs, monkeypatch, few):
    monkeypatch.setattr(near_copies, "BLOCK", 25)
    monkeypatch.setattr(work, "FEW", few)
    rng = np.random.default_rng(6)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
    rows = []
    for i in range(90):  # each differs from the base in one word
        words = list(base)
        words[int(rng.integers(300))] = f"v{i}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"u{x}" for x in rng.integers(0, 10**6, 300))) for i in range(60)]
    found = {r.doc_id for r in near_copies.deduplicate(docs(rows)).collect()}
    assert found == {0} | {1000 + i for i in range(60)}


def _families(rng, sizes, words=240):
    """Families of an original and members of which many are near the threshold: to the original, to each other, or to neither."""
    rows = []
    for size in sizes:
        base = [f"w{x}" for x in rng.integers(0, 10**7, words)]
        for i in range(size):
            own = list(base)
            for at in rng.choice(words, int(rng.integers(3, 9)) if i else 0, replace=False):
                own[at] = f"v{rng.integers(0, 10**9)}"
            rows.append(" ".join(own))
    return rows


@pytest.mark.parametrize(("items", "block"), [(1_000, 1_000), (50_000, 1_000), (50_000, 40)])
def test_near_copies_of_families_at_the_threshold(spark, docs, monkeypatch, items, block):
    """Groups equal brute force but for the candidates' recall, with the shape of tables of eight times ``items``, in any order of rows."""
    shape = near_copies.shape
    monkeypatch.setattr(near_copies, "shape", lambda n, *a: shape(8 * items, *a))
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = np.random.default_rng(items + block)
    texts = _families(rng, [2] * 60 + [3] * 20 + [8] * 8 + [40] * 3 + [200])
    sets = _sets(texts)
    want = _groups(sets)
    tight = sum(1 for i, j in combinations(range(len(sets)), 2) if 0.75 <= len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.85)
    assert tight > 1_000
    for seed in (1, 2):
        order = np.random.default_rng(seed).permutation(len(texts))
        found = {r.doc_id for r in near_copies.deduplicate(docs([(int(i), texts[i]) for i in order]).repartition(7)).collect()}
        assert set(want) <= found  # nothing is joined that is not similar
        assert len(found) - len(set(want)) <= 0.03 * (len(texts) - len(set(want)))


def test_near_copies_odd_rows(spark, docs):
    rows = [(5, None), (6, ""), (7, "a b"), (8, "A  b"), (8, "A  b"), (None, "a b"), (None, "q r s t u v w"), (9, "x " * 30_000)]
    frame = docs(rows, "row string, d string, sig string")
    kept = near_copies.deduplicate(frame)
    assert kept.columns == frame.columns and Counter(r.doc_id for r in kept.collect()) == Counter([5, 7, None, 9])
    assert near_copies.deduplicate(docs([])).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    sizes = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        sizes[name] = docs.count()
        if name != "bpe":
            assert docs.columns == names
    assert sizes["language_id"] >= 990 and sizes["exact_dedup"] < sizes["language_id"] and sizes["simhash_dedup"] < sizes["exact_dedup"]
    assert sizes["mixing"] >= sizes["simhash_dedup"] and sizes["bpe"] == sizes["mixing"]
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 100


def test_pipeline_odd_rows(spark, docs):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "some words here", "en", "a"), (3, "some words here", "en", "a"), (None, "other text there", "en", None)]
    out = docs(rows)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
    assert sorted(x.doc_id or 0 for x in out.collect())[0] == 0
    empty = docs([])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def _brute_mixture(rows, repeat, seed=7):
    """doc_id -> showings, by the definition: natural shares to the least exponent that keeps the limit."""
    total = Counter()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) + 1 for r in rows}
    for r in rows:
        total[r.source] += size[r.doc_id]
    most, least = max(total.values()), min(total.values())
    e = 1 - math.log(repeat) / math.log(most / least) if most / least > repeat else 0.0
    goal = {s: round(most ** (1 - e) / t ** (1 - e) * t) for s, t in total.items()}
    times = Counter()
    for source in total:
        own = [r for r in rows if r.source == source]
        whole, rest = divmod(goal[source], total[source])
        order = sorted(own, key=lambda r: hashlib.md5(f"{seed}:{whole}:{r.doc_id}".encode()).hexdigest())
        used = 0
        for r in order:
            used += size[r.doc_id]
            times[r.doc_id] += whole + (used <= rest)
    return times


def test_pipeline_equals_brute_force(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = corpus_pipeline.known_language(spark, docs, sf).select("doc_id", "text", "source").collect()
    assert len(known) >= docs.count() - 1  # the tables hold no text in an unknown language
    best = {}
    for r in known:
        key = re.sub(r"[\x20\x09-\x0D]+", "", r.text)
        best[key] = min(best.get(key, r), r, key=lambda x: (-len(x.text), x.doc_id))
    rows = sorted(best.values(), key=lambda r: r.doc_id)
    groups = _groups(_sets([r.text for r in rows]))
    rows = [r for i, r in enumerate(rows) if groups[i] == i]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for doc_id, n in _brute_mixture(rows, corpus_pipeline.REPEAT).items():
        text = next(r.text for r in rows if r.doc_id == doc_id)
        ids = t.encode(text, add_special_tokens=False).ids
        want[doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += n
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == want


@pytest.mark.parametrize("block", [1_000, 7])
def test_short_texts_are_found(spark, docs, block, monkeypatch):
    """Pairs at a similarity of exactly or just above 0.8, by size of set: all of small sets, 0.95 of the others together; nothing else goes."""
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = np.random.default_rng(11)
    rows, pairs = [], {}
    for n in (4, 5, 6, 9, 12, 20, 30, 37, 60, 150, 400):
        lost = max((x for x in range(n) if (n - x) / n >= 0.8), default=0)
        for k in range(30 if n <= near_copies.MEET else 100 if n < 400 else 60):
            words = [f"{n}x{k}w{i}r{rng.integers(1_000)}" for i in range(n + 4)]
            rows.append((len(rows), " ".join(words)))
            rows.append((len(rows), " ".join(words[:-lost] if lost else [*words[:-1], words[-1]])))
            pairs[len(rows) - 1] = n
    rows += [(len(rows) + k, f"one two three four five {k} other words here {k}") for k in range(60)]  # a shingle that many share, in texts that aren't alike
    stays = {r.doc_id for r in near_copies.deduplicate(docs(rows)).collect()}
    gone = set(range(len(rows))) - stays
    assert gone <= pairs.keys()
    shares = {}
    for n in sorted(set(pairs.values())):
        own = [i for i, m in pairs.items() if m == n]
        shares[n] = sum(i in gone for i in own) / len(own)
    large = [x for n, x in shares.items() if n > near_copies.MEET]
    assert all(x == 1.0 for n, x in shares.items() if n <= near_copies.MEET), shares
    assert min(large) >= 0.92 and sum(large) / len(large) >= 0.95, shares  # of 60 to 100 pairs each at the very threshold, 0.97 expected
