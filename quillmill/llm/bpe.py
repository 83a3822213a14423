"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of its bytes has some zero bits, so that a passage gives the same chunks in every
document. A chunk is encoded once in a worker, without its two ends. Where chunks meet, the text from the last safe cut
of one to the first safe cut of the next is encoded anew; a safe cut is a place where the pre-tokenizer always starts a
new piece, so the tokens on both sides of the repaired stretch agree exactly with those of the whole text. A chunk
without a safe cut joins the stretch, which then reaches on to the next chunk.

Caches hold a bounded number of entries and bytes for each worker and only save time. A global table of chunks would
move every text through a shuffle; here texts stay where they are read.

Null texts count as empty and give no ids. Rows with equal or null doc_id each give their own row. An empty table
gives an empty result. Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Entries of a worker's cache of pieces; characters of the longest piece kept.
PIECES, PIECE_CHARS = 500_000, 64
#: A chunk ends where so many bits of the hash are zero (2,048 bytes on average), has at least so many bytes; bytes of a worker's chunks.
CHUNK_BITS, CHUNK_LEAST, CHUNK_BYTES = 11, 256, 24_000_000

#: The pre-tokenizers' patterns.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
#: Beyond these, libraries may hold different editions of Unicode, and composing or lower-casing isn't plain.
_RARE = re.compile("[^\x00-\u017f]|\u0130")

_CUT = re.compile(r" (?=\S)")
_UNSURE = re.compile(r" (?:\s|\Z)")
_OTHER_SPACE = re.compile("[\x1c-\x1f]")


class Pieces(dict):
    """Ids (little-endian unsigned 32-bit) of pieces that are encoded alike wherever they stand."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(piece) <= PIECE_CHARS:
            if len(self) >= PIECES:
                self.clear()
            self[piece] = ids
        return ids


def merger(model: dict, of: dict[str, bytes], halves: Iterable[bytes] = ()):
    """A fast merge engine for a vocabulary whose merges stand in the order of their ids, else None.

    ``of`` has the byte string of each of the vocabulary's first tokens, ``halves`` those that are no token by
    themselves; a merge's string is that of its two parts.
    """
    import tiktoken

    strings, base = dict(of), len(of)
    for k, (a, b) in enumerate(map(tuple, model["merges"])):
        if model["vocab"].get(a + b) != base + k:
            return None
        strings[a + b] = strings[a] + strings[b]
    ranks = {s: model["vocab"][t] for t, s in strings.items()} | {s: 1_000_000 + k for k, s in enumerate(halves)}
    return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe


class Encoder:
    """Whole texts to ids and back, equal to the tokenizers library's result for byte-level and word-end BPE files.

    Pieces of common characters go through a merge engine over the same merges, all others through the library.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.drops_space = self.tokenizer.normalizer is not None  # white space only separates words
        model = json.loads(tokenizer_json)["model"]
        stand_in = byte_stand_ins()
        if self.drops_space:
            # a byte, or a byte that ends a word, is two bytes of disjoint ranges, which no merge can take apart
            inner = [bytes([x // 8, 128 + x % 8]) for x in range(256)]
            final = [bytes([x // 8 + 32, 128 + x % 8]) for x in range(256)]
            of = {c: inner[x] for c, x in stand_in.items()} | {c + "</w>": final[x] for c, x in stand_in.items()}
            self.inner, self.final = inner.__getitem__, final.__getitem__
            self.engine = merger(model, of, [bytes([x]) for x in (*range(64), *range(128, 136))])
        else:
            self.engine = merger(model, {c: bytes([x]) for c, x in stand_in.items()})
        self.pieces = Pieces(self._word if self.drops_space else self._spaced)
        self.chunks: dict[bytes, tuple[str, bytes, str]] = {}
        self.chunk_bytes = 0
        self.specials = sorted({t.content[:2] for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.table: list[bytes] | None = None

    def _spaced(self, piece: str) -> bytes:
        """Ids of a space and a piece."""
        if self.engine and not _RARE.search(piece):
            return array("I", self.engine.encode_ordinary(" " + piece)).tobytes()
        return self.whole(" " + piece)

    def _word(self, piece: str) -> bytes:
        """Ids of what stands between white space."""
        if not self.engine or _RARE.search(piece):
            return self.whole(piece)
        out: list[int] = []
        for word in _WORD.findall(piece.lower()):
            raw = word.encode()
            out += self.engine.encode_single_piece(b"".join(map(self.inner, raw[:-1])) + self.final(raw[-1]))
        return array("I", out).tobytes()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.specials):  # a special token's string may stand here, and reaches across cuts
            return self.whole(text)
        if self.drops_space:
            if _OTHER_SPACE.search(text):  # white space for Python, not for the library
                return self.whole(text)
            return b"".join(map(self.pieces.__getitem__, text.split()))
        return self._chunked(text)

    def _stretch(self, text: str) -> bytes:
        """A text from one safe cut, or the start, to another, or the end."""
        first, *rest = text.split(" ") if not _UNSURE.search(text) else _CUT.split(text)
        return (self.whole(first) if first else b"") + b"".join(map(self.pieces.__getitem__, rest))

    def _chunk(self, raw: bytes) -> tuple[str, bytes, str]:
        """What stands before the first safe cut, the ids up to the last one, and what stands after it."""
        found = self.chunks.get(raw)
        if found is None:
            text = raw.decode()
            cuts = _CUT.search(text)
            if cuts is None:
                found = (text, b"", "")
            else:
                first, last = cuts.start(), text.rfind(" ")
                while text[last + 1 : last + 2].isspace() or last + 1 == len(text):
                    last = text.rfind(" ", 0, last)
                found = (text[:first], self._stretch(text[first:last]) if last > first else b"", text[last:])
            size = 2 * len(raw) + len(found[1])
            if self.chunk_bytes + size > CHUNK_BYTES:
                self.chunks.clear()
                self.chunk_bytes = 0
            if size <= CHUNK_BYTES:
                self.chunks[raw] = found
                self.chunk_bytes += size
        return found

    def _chunked(self, text: str) -> bytes:
        raw, at, open_, out = text.encode(), 0, "", []
        for end in chunk_ends(raw):
            before, ids, after = self._chunk(raw[at:end])
            at = end
            open_ += before
            if after:  # the chunk has a safe cut: the stretch that is open ends at its first
                out += (self._stretch(open_), ids)
                open_ = after
        out.append(self._stretch(open_))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """The decoded text in UTF-8, special tokens included."""
        if self.drops_space:
            return self.tokenizer.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False).encode()
        if self.table is None:
            self.table = byte_table(self.tokenizer)
        raw = b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode(errors="replace").encode()


def chunk_ends(raw: bytes) -> list[int]:
    """Ends of the content-defined chunks of ``raw``, never within a character."""
    n = len(raw)
    if n <= 2 * CHUNK_LEAST:
        return [n] if n else []
    b = np.frombuffer(raw, np.uint8)
    h, factor, width = b.astype(np.uint32), 0x9E3779B1, 1
    while width < 8:  # a hash of each 8 bytes by doubling
        h = h[:-width] * np.uint32(factor) + h[width:]
        factor, width = factor * factor & 0xFFFFFFFF, 2 * width
    h *= np.uint32(0x85EBCA6B)
    ends = np.flatnonzero(h >> np.uint32(32 - CHUNK_BITS) == 0) + width
    ends = ends[(ends < n)]
    ends = ends[(b[ends] & 0xC0) != 0x80]
    out, last = [], 0
    for e in ends.tolist():
        if e - last >= CHUNK_LEAST:
            out.append(e)
            last = e
    return [*out, n]


def byte_stand_ins() -> dict[str, int]:
    """The printable stand-in of each byte in a byte-level vocabulary, in the order of the vocabulary's first ids."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}


def byte_table(tokenizer) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary."""
    byte = byte_stand_ins()
    added = {i: t.content.encode() for i, t in tokenizer.get_added_tokens_decoder().items()}
    out = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for token, i in tokenizer.get_vocab(with_added_tokens=True).items():
        out[i] = added[i] if i in added else bytes(byte[c] for c in token)
    return out


_encoders: dict[str, Encoder] = {}


def encoder(tokenizer_json: str) -> Encoder:
    """The worker's encoder for a tokenizer file; a worker keeps it between tasks."""
    key = hashlib.sha256(tokenizer_json.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(tokenizer_json)
    return _encoders[key]


def read_tokenizer(path: str) -> str:
    """The tokenizer file, read on the driver, so that executors need no copy of it."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit)."""
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))  # a tokenizer file is a few MB

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared.value)
        for batch in batches:
            ids = [e.encode(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, ids binary")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, text of rows (doc_id, ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(shared.value)
        for batch in batches:
            texts = [e.decode(x or b"").decode() for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, "doc_id long, text string")


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, so that ids never leave the worker."""
    shared = docs.sparkSession.sparkContext.broadcast(read_tokenizer(tokenizer_path))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, sha = encoder(shared.value), hashlib.sha256
        for batch in batches:
            n, a, b = [], [], []
            for text in batch.column("text"):
                ids = e.encode(text.as_py() or "")
                n.append(len(ids) // 4)
                a.append(sha(ids).hexdigest())
                b.append(sha(e.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names)

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
