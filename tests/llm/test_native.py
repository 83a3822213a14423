"""The operators made of built-in functions only: licence scans, chat formatting, mixing, exact deduplication."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from quillmill.llm import chat_format, exact_dedup, license_scan, mixing, queries

SF = "/root/testdata/sf0.001"


def test_exact_dedup(spark, docs):
    rows = [(4, "a b", "x"), (3, "ab"), (2, "a\tb"), (9, None), (8, " "), (7, "c"), (7, "c"), (None, "c"), (6, "A b"), (1, "a\xa0b")]
    found = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.annotate(docs(rows, "digest string, len int, row int")).collect())
    assert found == [(0, 7, 3, False), (1, 1, 1, True), (2, 2, 3, True), (3, 2, 3, False), (4, 2, 3, False), (6, 6, 1, True), (7, 7, 3, False), (7, 7, 3, True), (8, 8, 2, True), (9, 8, 2, False)]
    frame = docs(rows, "digest string, len int, row int")
    kept = exact_dedup.deduplicate(frame)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 6, 7, 8]
    assert exact_dedup.annotate(docs([])).count() == 0 and exact_dedup.deduplicate(docs([])).count() == 0


def test_exact_dedup_index_persists(spark, docs, tmp_path):
    where = f"file://{tmp_path}/index"
    first = exact_dedup.annotate(docs([(1, "a"), (2, "b")]), exact_dedup.DigestIndex(spark, where, 4))
    assert first.filter("kept").count() == 2
    index = exact_dedup.DigestIndex(spark, where, 4)  # opened again by its place
    found = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.annotate(docs([(5, "a "), (6, "c"), (7, "c")]), index).collect()}
    assert found == {5: (1, False), 6: (6, True), 7: (6, False)}
    assert index.known().count() == 3


def test_exact_dedup_text_sha(spark, docs):
    row = exact_dedup.annotate(docs([(1, " É\x0b x")])).first()
    assert row.text_sha256 == hashlib.sha256("Éx".encode()).hexdigest()


MIT = next(clauses for label, clauses, _ in license_scan.NOTICES if label == "mit-text")


def brute_licences(texts):
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    indexed = lambda text: [(i, w) for i, w in enumerate(text.split()) if w not in license_scan.FUNCTION_WORDS]
    templates = [("base", label, indexed(p), [], []) for p, label in license_scan.BASE.items()]

    def fixed(text, keys):
        """Numbers, and a key phrase's words where the clause has it."""
        own = [(i, w) for i, w in indexed(text) if w.isdigit()]
        for key in keys:
            for at in re.finditer(rf"\b{key}\b", text):
                first = len(text[: at.start()].split())
                own += [(first + i, w) for i, w in indexed(key)]
        return own

    templates += [("clause", label, indexed(p), keys, fixed(p, keys)) for label, clauses, keys in license_scan.NOTICES for p in clauses]
    stands = lambda own, at, t: sum(0 <= at + i < len(own) and own[at + i] == w for i, w in t)
    for own in words:
        places, base, labels, score = [], set(), set(), 0.0
        known = set(own)
        for kind, label, t, keys, must in templates:
            if sum(w in known for _, w in t) < license_scan.ENOUGH * len(t):
                continue
            for at in range(-140, len(own)):
                n = stands(own, at, t)
                if kind == "base" and n == len(t):
                    places.append(at)
                    base.add(label)
                    score = 1.0
                elif kind == "clause" and n >= license_scan.ENOUGH * len(t) and stands(own, at, must) == len(must):
                    if all(any(stands(own, b, indexed(k)) == len(indexed(k)) for b in range(-90, len(own))) for k in keys):
                        labels.add(label)
                        score = max(score, n / len(t))
        yield (len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), round(score, 6))


def test_licence_versions_are_told_apart(spark, docs):
    """A version number, or a key phrase elsewhere in the file, doesn't make a notice of version 3 one of version 2."""
    notice = license_scan._GNU.format("general public license", 3)
    texts = [notice + ". Parts are licensed under the Apache License, Version 2.0", notice + ". The tool needs version 2 of the compiler", notice.replace("version 3", "version 2"), license_scan._FREEDOM, license_scan._FREEDOM_3 + " version 3", license_scan._DISCLAIMED + " Redistribution and use ... the following conditions are met"]
    found = [r.labels for r in license_scan.scan(docs(list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert found == ["apache,apache-2.0,gpl,gpl-3.0", "gpl,gpl-3.0", "gpl,gpl-2.0", "gpl", "gpl,gpl-3.0", "bsd"]
    assert found == [x[5] for x in brute_licences(texts)]


def test_licence_scan_equals_brute_force(spark, docs):
    texts = [
        None, "", "MIT License", "mit-license, MIT\nLICENSE mit license", "cc by-nc 4.0 licensed under CC BY-NC 4.0.", "xmit license", "the apache software license", "é apache license é",
        "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "gnu general public public license", "mit\x00license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this Software and associated documentation files (the Software), to deal in the Software without restriction",
        "released under the mit license " * 300, "Redistribution and use in source and binary forms are permitted provided that the following conditions are met",
        # the whole MIT text among ordinary words that other licences use, some of them rarer than its own
        " ".join(MIT) + " source terms compliance version endorse altered binary law worldwide attribution", "source " * 9 + "licensed under the apache license version 2 0",
        "Permission is hereby granted to deal without restriction. " + MIT[1].replace("merge", "x").replace("publish", "y"),
    ]
    frame = docs([(i, t, "x", "y", "z") for i, t in enumerate(texts)], "row string, words string, hits string")
    found = {r.doc_id: tuple(r)[1:] for r in license_scan.scan(frame).collect()}
    assert found == dict(enumerate(brute_licences(texts)))
    assert "mit-text" in found[15][5] and "apache-2.0" in found[16][5] and "mit-text" in found[17][5]
    twice = docs([(3, "MIT License"), (3, "MIT License"), (None, "cc by"), (4, None)])
    assert sorted((r.doc_id or 0, r.labels) for r in license_scan.scan(twice).collect()) == [(0, "cc-by"), (3, "mit"), (3, "mit"), (4, "")]
    assert license_scan.scan(docs([])).count() == 0


def test_licence_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: tuple(r)[1:] for r in queries.op8_license_scan(spark, SF).collect()}
    assert found == dict(zip([r.doc_id for r in rows], brute_licences([r.text for r in rows])))


def test_chat_rotation(spark):
    rows = [
        (1, 0, "system", "be kind", 1), (1, 2, "bob", "hi <|turn|>", 1), (1, 1, "ann", "hello", 1), (1, None, None, None, 1), (2, 0, "system", "alone", 1), (None, 0, "ann", "x", 1),
        (3, 0, "ann", "first", 1), (3, 200, "bob", "later", 1),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    found = {(r.conv_id, r.speaker, r.part): r for r in chat_format.rotate(frame).collect()}
    assert set(found) == {(1, s, 0) for s in ("ann", "bob", "unknown")} | {(None, "ann", 0)} | {(3, s, 0) for s in ("ann", "bob")}
    bob = found[1, "bob", 0]
    assert bob.text == "<|turn|>system\nbe kind<|end|>\n<|turn|>user:ann\nhello<|end|>\n<|turn|>assistant\nhi < |turn|><|end|>\n<|turn|>user:unknown\n<|end|>\n"
    assert [bob.text[m.start : m.end] for m in bob.mask] == ["hi < |turn|><|end|>\n"]
    assert found[3, "ann", 0].text == "<|turn|>assistant\nfirst<|end|>\n<|turn|>user:bob\nlater<|end|>\n"
    assert chat_format.rotate(frame.limit(0)).count() == 0


@pytest.mark.parametrize("numbers", ["dense", "stamps", "few", "none"])
def test_chat_long_dialogues(spark, monkeypatch, numbers):
    """Rows stay bounded, every turn is in one part, and the opening system turn begins every part."""
    monkeypatch.setattr(chat_format, "WHOLE", 64)
    monkeypatch.setattr(chat_format, "PART", 16)
    turn = {"dense": lambda i: i, "stamps": lambda i: 1_700_000_000 + 37 * i, "few": lambda i: i % 3, "none": lambda i: None}[numbers]
    rows = [(1, -1, "system", "be kind")] + [(1, turn(i), "ann" if i % 2 else "bob", f"text {i:05}" if i != 5 else "long " * 50_000) for i in range(1, 900)]
    rows += [(2, 10**9 * i, "ann", f"y{i}") for i in range(60)]
    parts = chat_format.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    whole = [r for r in parts if r.conv_id == 2]
    assert len(whole) == 1 and whole[0].n_turns == 60
    for speaker in ("ann", "bob"):
        own = [r for r in parts if (r.conv_id, r.speaker) == (1, speaker)]
        assert max(r.n_turns for r in own) <= 2 * 64 and len({(r.part, r.split, r.slot) for r in own}) == len(own)
        assert all(r.text.startswith("<|turn|>system\nbe kind<|end|>\n") for r in own)
        assert sorted(r.text[m.start : m.end] for r in own for m in r.mask) == sorted(f"{x[3]}{chat_format.CLOSE}" for x in rows if x[0] == 1 and x[2] == speaker)
        if numbers in ("dense", "stamps"):
            own.sort(key=lambda r: r.part)
            assert all(r.n_turns <= 18 for r in own)
            said = [line for r in own for line in r.text.split("\n") if line.startswith("text")]
            assert said == sorted(said) and len(said) == 898


def test_mixing_budget(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    shown = mixing.mixture(documents, entropy=3.5, budget=200_000, block_tokens=20_000).collect()
    total, own = defaultdict(int), defaultdict(int)
    for r in documents.collect():
        total[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) + 1
    for r in shown:
        own[r.source] += r.tokens
    _, sources = mixing.plan(documents, entropy=3.5, budget=200_000)
    goals = {r.source: (r.weight, r.goal) for r in sources.collect()}
    assert abs(sum(w for w, _ in goals.values()) - 1) < 1e-9
    h = -sum(w * math.log2(w) for w, _ in goals.values())
    assert h >= 3.5 - 1e-9
    share = [t / sum(total.values()) for t in total.values()]
    if -sum(x * math.log2(x) for x in share) < 3.5:
        assert abs(h - 3.5) < 1e-6
    longest = defaultdict(int)
    for r in shown:
        longest[r.source] = max(longest[r.source], r.tokens)
    for source, (_, goal) in goals.items():
        assert own[source] <= goal and goal - own[source] <= total[source]
    for source in goals:  # a source's showings lie end to end
        at = 0
        for r in sorted((r for r in shown if r.source == source), key=lambda r: r.stream_start):
            assert r.stream_start == at
            at += r.tokens
    assert {r.block for r in shown} == set(range(10))


@pytest.mark.parametrize("repeat", [1.0, 2.5, 1000.0])
def test_mixing_shows_all_and_keeps_limit(spark, repeat):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    times = Counter(r.doc_id for r in mixing.mixture(documents, repeat=repeat).collect())
    assert len(times) == documents.count() and max(times.values()) <= math.ceil(repeat)
    real = Counter(r.doc_id for r in mixing.realise(documents, repeat=repeat).collect())
    assert real == times


def test_mixing_odd_rows(spark, docs):
    rows = [(1, None, "en", None), (2, "", "en", "a"), (2, "", "en", "a"), (None, "x y z", None, "b"), (3, "w " * 5000, None, "b")]
    frame = docs(rows, "lang string, source string, goal int, row int")
    assert mixing.realise(frame, repeat=2.0).columns == frame.columns
    assert {r.doc_id for r in mixing.realise(frame, repeat=2.0).collect()} == {1, 2, 3, None}
    assert mixing.mixture(docs([]), repeat=2.0).count() == 0 and mixing.realise(docs([]), entropy=1.0).count() == 0
