"""Whole results where a shortcut would lose some."""

import math

import numpy as np
import pytest
from test_models import brute_scores

from quillmill.llm import language_id, lm_scoring, near_copies

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("block", [1_000, 150])
def test_near_copies_of_an_original_that_resemble_each_other_less(spark, docs, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rng = np.random.default_rng(8)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 1_101):  # 4 to 6 changed words: a Jaccard similarity of 0.816 to 0.874 to the original, about 0.66 to 0.77 to each other
        words, k = list(base), 4 + i % 3
        for at in 5 + rng.permutation(29)[:k] * 10 + rng.integers(0, 5, k):
            words[at] = f"v{i}x{at}"
        rows.append((i, " ".join(words)))
    rows += [(5_000 + i, " ".join(f"u{x}" for x in rng.integers(0, 10**6, 300))) for i in range(60)]
    assert {r.doc_id for r in near_copies.deduplicate(docs(rows)).collect()} == {0} | {5_000 + i for i in range(60)}


def test_lm_scores_keep_all_bigrams_at_any_size(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "MAX_BITS", 1 << 14, raising=False)  # a size that the corpus is far beyond
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = brute_scores([tuple(r) for r in docs.collect()])
    found = {r.doc_id: r.score for r in lm_scoring.score(docs).collect()}
    assert all(found[i] >= w[5] - 1e-6 * abs(w[5]) for i, w in want.items())
    assert math.fsum(found.values()) - math.fsum(w[5] for w in want.values()) <= 0.005 * -math.fsum(w[5] for w in want.values())


def test_near_copies_with_unequal_repeats(spark, docs):
    line = "one two three four five six seven eight nine ten "
    rest = " ".join(f"r{i}" for i in range(40))
    rows = [(1, line * 5 + rest), (2, line * 8 + rest), (3, "x " * 6), (4, "x " * 30_000), (5, " ".join(f"s{i}" for i in range(50)))]
    assert {r.doc_id for r in near_copies.deduplicate(docs(rows)).collect()} == {1, 3, 5}


STRANGE = [
    "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä",
    "wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa",
    "все люди рождаются свободными и равными в своем достоинстве и правах они наделены разумом и совестью",
    "bütün insanlar hür haysiyet ve haklar bakımından eşit doğarlar akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler",
    "xqzv kjwq zzxv qqpl wvxk jjqz bxvq kkzw qxzj vwqk",
]


@pytest.mark.parametrize("learned", [("en", "de"), ("en", "de", "es", "fr")])
def test_texts_in_unlearned_languages_are_rejected(spark, docs, learned):
    known = spark.read.parquet(f"{SF}/documents.parquet").filter(f"lang IN {learned}")
    frame = known.select("doc_id", "text", "lang").unionByName(docs([(10**6 + i, t) for i, t in enumerate(STRANGE)], "lang string"))
    found = {r.doc_id: r.rejected for r in language_id.query(frame).collect()}
    assert all(found.pop(10**6 + i) for i in range(len(STRANGE)))
    assert sum(found.values()) <= 0.005 * len(found)
