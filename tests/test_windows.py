"""Windows against a direct restatement, word by word and window by window."""

import random
import re
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmill.functions import lexicons as lx
from quillmill.operators import lexical, places, windows


def table(spark, texts, manuscript="m"):
    return spark.createDataFrame([(manuscript, i, t) for i, t in enumerate(texts)], "manuscript_id string, doc_id long, text string")


def spoken(text):
    """Words of letters a-z after contraction parts and marks are split off."""
    apart = re.sub(r"(n't|'(?:s|m|d|ll|re|ve))\b", r" \1", text.lower())
    return [t for t in re.split(r"[\s.,;:!?\"()\[\]{}<>…“”«»—–/|]+", apart) if re.fullmatch("[a-z]+", t)]


def is_content(word):
    return len(word) >= 3 and word not in lx.STOPWORDS


def brute(texts, size, step, threshold):
    """All windows, every term's count in each, z-scores of each window with its own total."""
    words = [(i, w) for i, t in enumerate(texts) for w in spoken(t)]
    if not words:
        return {}, {}
    starts = [0] if len(words) <= size else range(0, len(words) - size + 1, step)
    grams = lambda own, n: list(zip(*[own[k:] for k in range(n)]))
    whole = [w for _, w in words if is_content(w)]
    inside = [[w for _, w in words[s : s + size] if is_content(w)] for s in starts]
    terms, regions = {}, {}
    for n in (1, 2, 3):
        counts = [Counter(grams(own, n)) for own in inside]
        totals = [max(len(own) - n + 1, 0) for own in inside]
        all_ = Counter(grams(whole, n))
        for term, g in all_.items():
            local = [c[term] for c in counts]
            deviation = statistics.stdev(local) if len(local) > 1 else 0
            z = [(x - g / sum(all_.values()) * t) / deviation if deviation > 1e-6 else 0.0 for x, t in zip(local, totals)]
            terms[" ".join(term)] = (n, g, max(local), local.index(max(local)), max(z), statistics.fmean(z), sum(x >= threshold for x in z))
            for k, (x, s) in enumerate(zip(z, starts)):
                if x >= threshold:
                    reach = min(size, len(words))
                    paragraph = words[s + reach // 2][0]
                    own = [i for i in range(s, s + reach) if words[i][0] == paragraph]
                    regions.setdefault((paragraph, own[0], own[-1]), []).append((round(x, 4), (s + reach / 2) / len(words) * 100, " ".join(term), n, k))
    return terms, regions


def mixed(seed, paragraphs, stops):
    """Paragraphs of common, rare and stop words, contractions and marks; the topic moves, so windows hold differing shares of content words."""
    rng = random.Random(seed)
    out = []
    for i in range(paragraphs):
        topic = ["harbor", "castle", "meadow", "engine"][i * 4 // paragraphs]
        words = [rng.choice([topic, f"word{chr(97 + rng.randrange(20))}", "silver", "don't", "well-known", *(["the", "of", "it"] * (stops if i % 3 else 1))]) for _ in range(rng.randrange(0, 40))]
        out.append(", ".join(words) + rng.choice([".", "", "! 42"]))
    return out


@pytest.mark.parametrize("seed, paragraphs, size, step", [(1, 60, 50, 10), (2, 40, 100, 30), (3, 3, 500, 100), (4, 80, 40, 40), (5, 50, 60, 7)])
@pytest.mark.parametrize("block", [2, 256])
def test_bursts(spark, seed, paragraphs, size, step, block, monkeypatch):
    monkeypatch.setattr(windows, "BLOCK", block)
    texts = mixed(seed, paragraphs, 1 + seed)
    terms, regions = brute(texts, size, step, 1.5)
    got = {r.term: r for r in windows.burst_terms(table(spark, texts), size, step, 1.5).collect()}
    assert got.keys() == terms.keys()
    for term, (n, g, peak, place, high, mean, over) in terms.items():
        r = got[term]
        assert (r.ngram_size, r.global_count, r.peak_count, r.peak_window, r.burst_windows) == (n, g, peak, place, over), term
        assert abs(r.max_z - high) < 1e-4 and abs(r.mean_z - mean) < 1e-4, (term, r, high, mean)
    found = {(r.paragraph, r.first_token, r.last_token): r for r in windows.burst_regions(table(spark, texts), size, step, 1.5).collect()}
    assert found.keys() == regions.keys()
    for place, own in regions.items():
        r = found[place]
        best = sorted(own, key=lambda x: (-x[0], x[2], x[3], x[4]))[:5]
        assert r.bursts == len(own) and abs(r.max_z - best[0][0]) < 1e-9 and abs(r.mean_progress - statistics.fmean(x[1] for x in own)) < 0.0051
        assert r.top_terms == ", ".join(f"{t} ({n})" for _, _, t, n, _ in best)


def test_windows_without_a_term_can_be_the_highest(spark):
    """A term that only crowded windows hold: its greatest z-score is that of a window without it and almost without content words."""
    texts = ["the of it and " * 25] * 3 + ["zebra lion tiger otter badger " * 20] * 2 + ["zebra"] + ["the of it and " * 25]
    terms, _ = brute(texts, 50, 25, 3.0)
    got = {r.term: r.max_z for r in windows.burst_terms(table(spark, texts), 50, 25, 3.0).collect()}
    assert all(abs(got[t] - x[4]) < 1e-4 for t, x in terms.items())
    tail = ["lion " * 40 + "the " * 60, "lion " * 9 + "the " * 1, "zebra lion zebra lion " * 30, "zebra lion"]
    terms, _ = brute(tail, 50, 40, 3.0)
    got = {r.term: r.max_z for r in windows.burst_terms(table(spark, tail), 50, 40, 3.0).collect()}
    assert all(abs(got[t] - x[4]) < 1e-4 for t, x in terms.items())


def test_terms_across_long_gaps(spark, monkeypatch):
    """Neighbouring content words with more stop words between them than a block and a window hold are a term all the same, in no window."""
    monkeypatch.setattr(windows, "BLOCK", 1)
    texts = ["lion " + "the " * 70 + "tiger", "of " * 50, "otter " + "it " * 30]
    terms, _ = brute(texts, 20, 10, 3.0)
    got = {r.term: (r.ngram_size, r.global_count, r.peak_count) for r in windows.burst_terms(table(spark, texts), 20, 10).collect()}
    assert got == {t: x[:3] for t, x in terms.items()} and got["lion tiger otter"] == (3, 1, 0)


def test_threshold_and_odd_rows(spark):
    with pytest.raises(ValueError, match="above 0"):
        windows.burst_terms(table(spark, ["a b"]), threshold=0)
    odd = table(spark, [None, "", "42 ...", "lion"]).union(table(spark, ["orphan"], None)).union(table(spark, ["lion"]).limit(1))
    got = {r.term: r.global_count for r in windows.burst_terms(odd).collect()}
    assert got == {"lion": 2, "lion lion": 1}
    assert windows.burst_regions(table(spark, [])).count() == 0


@pytest.mark.parametrize("block", [1, 256])
def test_entropy_windows(spark, block, monkeypatch):
    import math

    from quillmill.functions import text as tx

    monkeypatch.setattr(windows, "BLOCK", block)
    texts = mixed(9, 40, 2)
    words = [w for r in table(spark, texts).select("doc_id", tx.entropy_tokens(F.col("text")).alias("own")).orderBy("doc_id").collect() for w in r.own]
    got = {r.window: r for r in windows.entropy_windows(table(spark, texts), 60, 25).collect()}

    def entropy(own):
        counts = Counter(own)
        return -sum(c / len(own) * math.log2(c / len(own)) for c in counts.values()) if own else 0.0

    start, seen = 0, 0
    while True:
        own = words[start : start + 60]
        if len(own) < 2:
            break
        r = got[start // 25]
        assert (r.start_token, r.end_token) == (start, start + len(own))
        assert abs(r.entropy - entropy(own)) < 1e-4 and abs(r.bigram_entropy - entropy(list(zip(own, own[1:])))) < 1e-4
        seen += 1
        if start + 60 >= len(words):
            break
        start += 25
    assert len(got) == seen


def test_only_the_first_bursts_of_a_window_leave_it(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(windows, "saved", lambda df, own=windows.saved: kept.append(own(df)) or kept[-1])
    found = windows.burst_regions(table(spark, mixed(7, 60, 2)), 50, 10, 1.5, k=2)
    assert found.agg(F.max("bursts")).first()[0] > 2
    assert kept[-1].groupBy("manuscript_id", "window").count().agg(F.max("count")).first()[0] <= 2


@pytest.mark.parametrize("size,step", [(10, 5), (7, 3), (4, 6)])
def test_anchors_are_those_of_the_windows_written_out(spark, size, step):
    """The middle word's paragraph by every word of every window, over paragraphs of no, one and many words; no word is written out."""
    lengths = {"a": [3, 0, 1, 25, 1, 1, 7], "b": [2], "c": [40], "d": [1] * 23}
    texts = [(m, 100 * k + i, " ".join(["w"] * n)) for k, (m, own) in enumerate(lengths.items()) for i, n in enumerate(own)]
    words = windows.placed(spark.createDataFrame(texts, "manuscript_id string, doc_id long, text string"), F.filter(F.split("text", " "), lambda t: t != ""))
    each = {}
    for r in windows.in_windows(words, size, step, True).collect():
        each.setdefault((r.manuscript_id, r.window), {})[r.gpos] = r.doc_id
    want = []
    for (m, w), own in each.items():
        anchor = own.get((min(own) + max(own) + 1) // 2)
        inside = [g for g, d in own.items() if d == anchor]
        if inside:
            want.append((m, w, anchor, len(inside), min(inside), max(inside)))
    found = places.window_anchor(words, size, step)
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1


def test_only_frequent_patterns_are_counted_as_texts(spark):
    """Ties at the last place go to the earlier, a null manuscript is one of its own; patterns meet only after their hashes were counted."""
    texts = {"m": ["mist over water", "mist over water and mist over stone", "long stone wall long stone wall", "deep well", "grey wall deep well"] + ["once upon hills"] * 3 + [f"pair{c} {c}walk here" for c in "abcdefgh" for _ in range(2)], None: ["mist over hills", "mist over hills"], "n": ["lone words here"]}
    each = [(m, 100 * i + j, t) for i, (m, own) in enumerate(texts.items()) for j, t in enumerate(own)]
    want = []
    for m in texts:
        counts, first = Counter(), {}
        for _, d, t in [e for e in each if e[0] == m]:
            own = [x for x in re.findall("[A-Za-z]+", t.lower()) if len(x) >= 2]
            for p, g in enumerate(zip(own, own[1:])):
                if any(len(x) >= 4 for x in g) and any(x not in lx.STOPWORDS for x in g):
                    counts[" ".join(g)] += 1
                    first.setdefault(" ".join(g), (d, p))
        best = sorted(counts, key=lambda g: (-counts[g], first[g]))[:4]
        want += [(str(m), g, counts[g], i + 1) for i, g in enumerate(best) if counts[g] >= 2]
    found = lexical.repeated_patterns(spark.createDataFrame(each, "manuscript_id string, doc_id long, text string"), 2, 4)
    assert sorted((str(r.manuscript_id), r.pattern, r["count"], r["rank"]) for r in found.collect()) == sorted(want) and len(want) == 6
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()


def test_terms_meet_in_lots_and_not_as_rows(spark, monkeypatch):
    """Many lots, sent in many parts, of manuscripts of several sizes; no row for a term of a block is joined or exchanged."""
    own = {"a": mixed(11, 30, 1), "b": mixed(12, 8, 2), "c": ["lion tiger"], "d": mixed(13, 20, 3)}
    rows = table(spark, [], "a")
    for name, texts in own.items():
        rows = rows.union(table(spark, texts, name).withColumn("doc_id", F.col("doc_id") + 1000 * ord(name[0])))
    monkeypatch.setattr(windows, "BLOCK", 3)
    monkeypatch.setattr(windows, "LOT", 60)
    monkeypatch.setattr(windows, "HELD", 50)
    found, regions = windows.burst_terms(rows, 50, 10, 1.5), windows.burst_regions(rows, 50, 10, 1.5)
    got, where = found.collect(), regions.collect()
    for name, texts in own.items():
        terms, places_ = brute(texts, 50, 10, 1.5)
        assert {r.term: (r.global_count, r.peak_count, r.peak_window, r.burst_windows) for r in got if r.manuscript_id == name} == {t: (x[1], x[2], x[3], x[6]) for t, x in terms.items()}
        assert {(r.paragraph - 1000 * ord(name), r.first_token, r.last_token): r.bursts for r in where if r.manuscript_id == name} == {k: len(v) for k, v in places_.items()}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" in plan and not re.search(r"(Join|Aggregate)[^\n]*term#", plan)
