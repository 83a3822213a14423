import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillmill.llm import bpe, queries, token_files

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = [
    "", " ", "a  b \n c", "\n \nx  y <|endoftext|> z ", "a\x1cb c", "é x̀ y   z", "İSTANBUL ΣΑΣ it's don'T", "x's'll 'T 12345 ½² aª",
    " x  y", "日本 語 text", "ŉ ſ K Å", "\x85 a\x85b", "''' '' '", "no-cut-" * 900, "word " * 3000, "the same passage here, " * 400,
]


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    path = public_tokenizers.path(request.param)
    return bpe.Encoder(bpe.read_tokenizer(path)), Tokenizer.from_file(path)


def _same(pair, text):
    ours, theirs = pair
    ids = theirs.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ours.encode(text), "<u4").tolist() == ids
    assert ours.decode(ours.encode(text)).decode() == theirs.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ODD)
def test_equals_library(pair, text):
    assert pair[0].engine
    _same(pair, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=12), st.sampled_from([" ", "  ", "\n", " \n", "'s", "the", "ça", "<|endoftext|>", "x" * 700])), max_size=30))
def test_equals_library_on_any_text(pair, parts):
    _same(pair, "".join(parts))


def test_chunks_are_content_defined():
    rng = np.random.default_rng(1)
    words = ["".join(chr(97 + x) for x in rng.integers(0, 26, 6)) for _ in range(4000)]
    a = " ".join(words).encode()
    b = b"another start, " + a
    cut = lambda raw: {raw[x:y] for x, y in zip([0, *bpe.chunk_ends(raw)], bpe.chunk_ends(raw))}
    assert len(cut(a) & cut(b)) >= len(cut(a)) - 2


def test_round_trip_query(spark, docs):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, None), (99, None), (None, "x y")]
    t = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    found = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs(rows), public_tokenizers.path(FILES[0])).collect())
    want = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append((-1 if i is None else i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert found == sorted(want)


def test_encode_then_decode(spark, docs):
    path = public_tokenizers.path(FILES[0])
    back = bpe.decode(bpe.encode(docs([(1, "Hello there"), (2, None)]), path), path)
    assert sorted(tuple(r) for r in back.collect()) == [(1, "Hello there"), (2, "")]


def test_empty_tables(spark, docs):
    path = public_tokenizers.path(FILES[1])
    assert bpe.digests(docs([]), path).count() == 0
    assert token_files.checksums(spark, token_files.write(docs([]), path, 2)).count() == 0


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [0, 1, 7, 64, 1000])
def test_planes(bits, n):
    ids = np.random.default_rng(n).integers(0, 50_000, n).astype("<u4")
    blob = token_files.pack(ids, bits, block=64)
    assert (token_files.unpack(blob) == ids).all()
    if n:
        assert (token_files.unpack(blob, only=n // 64 - (n % 64 == 0)) == ids[64 * ((n - 1) // 64) :]).all()


@pytest.mark.parametrize("bits", [False, True])
def test_token_files(spark, docs, bits, monkeypatch):
    monkeypatch.setattr(token_files, "SEGMENT", 50)
    rows = [(7 * i % 1000, f"text number {i} " * (i % 9)) for i in range(300)] + [(-3, None), (5000, "x"), (5000, "x")]
    path = public_tokenizers.path(FILES[1])
    t = Tokenizer.from_file(path)
    where = token_files.write(docs(rows), path, 2, bits=bits)
    start, want = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_files.checksums(spark, where).collect()) == sorted(want)
    assert {(r.doc_id, r.start, len(r.ids)) for r in token_files.read(spark, where).collect()} == {x[:3] for x in want}


def test_queries_run(spark):
    for name in ("op9_bpe_round_trip", "op10_token_files"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 200
