import random
import re

import numpy as np
import pytest
import xxhash

from quillmill.llm import queries, simhash
from quillmill.llm.components import components
from quillmill.llm.grouped import roots


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius=2):
    label = {i: i for i in ids}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in zip(ids, fps):
        for j, b in zip(ids, fps):
            if i < j and (a ^ b).bit_count() <= radius:
                label[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \n", "one", "One two", "a b c", "a b c d a b c d", "É É é x y z", "w " * 70_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text or "") == brute_fingerprint(text)


def test_bk_tree_finds_all_pairs():
    rng = random.Random(3)
    values = {rng.getrandbits(64) for _ in range(150)}
    for x in list(values):
        values |= {x ^ 1 << rng.randrange(64), x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)}
    values = sorted(values)
    a, b = simhash.BKTree(np.array(values, np.uint64)).pairs(2)
    want = {(x, y) for x in values for y in values if x < y and (x ^ y).bit_count() <= 2}
    assert {tuple(sorted((values[i], values[j]))) for i, j in zip(a, b)} == want


@pytest.mark.parametrize("limit", [1_000, 3])
def test_links_join_all(spark, limit, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", limit)
    rng = random.Random(5)
    values = {0, 1, (1 << 64) - 1, (1 << 63)}
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(8):
            values.add(x)
            x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    values = sorted(x - (1 << 64) if x >> 63 else x for x in values)
    frame = spark.createDataFrame([(x,) for x in values], "fp long")
    found = {r.node: r.component for r in components(simhash.links(frame)).collect()}
    assert {x: found.get(x, x) for x in values} == brute_components(values, [x & (1 << 64) - 1 for x in values])


def test_links_come_from_trees_of_many_nodes(spark):
    rng = random.Random(12)
    values = {rng.getrandbits(64) for _ in range(3_000)}
    near = {x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for x in sorted(values)[:400]}
    values = sorted(x - (1 << 64) if x >> 63 else x for x in values | near)
    assert simhash.run_bits(len(values)) == 4 and simhash.run_bits(10**12) == 21 and simhash.run_bits(5) == 1
    frame = spark.createDataFrame([(x,) for x in values], "fp long")
    found = {r.node: r.component for r in components(simhash.links(frame)).collect()}
    assert {x: found.get(x, x) for x in values} == brute_components(values, [x & (1 << 64) - 1 for x in values])


def test_components(spark):
    rng = random.Random(9)
    pairs = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(200)] + [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    at = {x: i for i, x in enumerate(sorted({x for p in pairs for x in p}))}
    names = sorted(at)
    root = roots(len(at), np.array([at[a] for a, _ in pairs]), np.array([at[b] for _, b in pairs]))
    assert found == {x: names[root[at[x]]] for x in names}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in docs]
    want = brute_components([r.doc_id for r in docs], fps)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash(spark, "/root/testdata/sf0.001").collect()}
    assert found == {r.doc_id: (f"{f:016x}", want[r.doc_id]) for r, f in zip(docs, fps)}


def test_odd_rows(spark, docs):
    rows = [(5, None), (6, ""), (7, "a b c d"), (8, "A b  c\td"), (8, "A b  c\td"), (None, "a b c d"), (9, "x " * 50_000), (10, "something else entirely here")]
    frame = docs(rows, "fp long, lang string")
    found = sorted(((r.doc_id or -1, r.component_id) for r in simhash.query(frame).collect()))
    assert found == [(-1, 7), (5, 5), (6, 5), (7, 7), (8, 7), (8, 7), (9, 9), (10, 10)]
    kept = simhash.deduplicate(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [5, 7, 9, 10]
    assert simhash.query(docs([])).count() == 0 and simhash.deduplicate(docs([])).count() == 0
