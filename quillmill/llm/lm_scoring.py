"""Language-model scores from a log-frequency Bloom filter of quantised bigram counts over exact unigrams.

Documents are read once, in blocks of some megabytes. A block holds its token sequences as numbers of its own
vocabulary. Its vocabulary with counts, and its distinct bigrams with counts, are dealt by hash to shards, where exact
totals over the whole corpus are made; each block gets back the totals of its vocabulary. A word is a row of each
block at most, so that frequent words make no large group.

All bigrams of the training text enter the filter, however large the corpus: an n-gram of count c is inserted at levels 1 to
1 + floor(log_b(c)), so a count is read by probing level after level until one is missing, as the mean of the counts of
its level (exact up to 3). Each shard has a segment of the filter for its range of bigrams, of ``BITS`` bits an
insertion, so the filter grows with the corpus at a fixed rate of false hits. A segment is built where its counts are
and is probed there for the bigrams of each block, whose levels go back to the block with the totals; no segment is sent
anywhere.

The probability of a token w after h is (c(h, w) + K p(w)) / (c(h) + K): a Dirichlet prior of weight K around the
smoothed unigram p, so that a context's bigrams count for c(h) / (c(h) + K). K is the mean number of different
tokens after a token. As p sums to 1 over the vocabulary and one unknown token, and c(h, w) to c(h), the probabilities
after any context sum to 1, but for the quantisation of counts above 3 and the filter's false hits; neither can lift a
count over those of its two tokens. What a shard holds is its share of the blocks' counts: partitions must follow the
input, as in any shuffle.

Null and empty texts are the end token alone. A null doc_id counts as the text ''. Rows with equal doc_id each give
their own row. Without training text every probability is 1. An empty table gives an empty result. Columns besides
``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm import token_files, work
from quillmill.llm.grouped import groups

#: Text of a block; more where there are many shards, so that a shard's part of a block is no sliver, up to what a worker can hold.
BLOCK_BYTES, SLIVER_BYTES, MOST_BYTES, END = 3_000_000, 10_000, 24_000_000, b"\n"
BITS, HASHES, BASE = 16, 5, 1.5
KEY_BITS, LEAST_BITS = 48, 4096

_BLOCKS = "block long, shard int, doc_ids array<long>, train binary, lengths binary, seq binary, words binary, counts binary, keys binary, key_counts binary"
_TOTALS = "block long, shard int, totals binary, levels binary, known long, tokens long, types long"


class _Numbers(dict):
    def __missing__(self, token: bytes) -> int:
        self[token] = n = len(self)
        return n


def _squeeze(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x if isinstance(x, bytes) else x.tobytes())


def _grow(x: bytes, kind: str | None = None):
    raw = zstandard.ZstdDecompressor().decompress(x)
    return raw if kind is None else np.frombuffer(raw, kind)


def _squeeze_keys(keys: np.ndarray) -> bytes:
    """Ascending keys as byte planes of their differences."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return _squeeze(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T))


def _grow_keys(x: bytes) -> np.ndarray:
    planes = _grow(x, "u1").reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").ravel(), dtype=np.uint64)


def _bigrams(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Keys of ``KEY_BITS`` bits of pairs of token hashes."""
    x = before * np.uint64(0x9E3779B97F4A7C15) + (after ^ after >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ x >> np.uint64(32)) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - KEY_BITS)


def _hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in tokens), np.uint64, len(tokens))


def levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / np.log(BASE) + 1e-9).astype(np.int64)


def level_counts(top: int = 64) -> np.ndarray:
    """The mean of the counts of each level; 0 for level 0."""
    least = np.ceil(BASE ** np.arange(top + 1.0) - 1e-9)  # the least count of levels 1, 2, ...
    return np.concatenate([[0.0], (least[:-1] + np.maximum(least[:-1], least[1:] - 1)) / 2])


class LogFrequencyFilter:
    """Segments of bits, one for each range of keys; a key's count is read as the number of its levels present."""

    def __init__(self, bits: np.ndarray, segments: int, segment_bits: int, top: int = 64):
        self.bits, self.segments, self.segment_bits, self.top = bits, segments, segment_bits, top

    @staticmethod
    def places(keys: np.ndarray, level: int, segment_bits: int) -> Iterator[np.ndarray]:
        x = keys + np.uint64(level << KEY_BITS)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        a, b = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32) | np.uint64(1)
        for i in range(HASHES):
            yield (a + np.uint64(i) * b) % np.uint64(segment_bits)

    @classmethod
    def segment(cls, keys: np.ndarray, counts: np.ndarray, segment_bits: int) -> bytes:
        present = np.zeros(segment_bits, np.uint8)
        top = levels(counts)
        for level in range(1, int(top.max(initial=0)) + 1):
            for at in cls.places(keys[top >= level], level, segment_bits):
                present[at.astype(np.int64)] = 1
        return np.packbits(present, bitorder="little").tobytes()

    def level(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, 0 if absent, by probing until a level is missing."""
        out, active = np.zeros(len(keys), np.int64), np.arange(len(keys))
        if not len(self.bits):
            return out
        offset = (shard_of(keys, self.segments) * self.segment_bits).astype(np.uint64)
        level = 1
        while len(active) and level <= self.top:
            alive = np.ones(len(active), bool)
            for at in self.places(keys[active], level, self.segment_bits):
                at += offset[active]
                alive &= (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            active = active[alive]
            out[active] = level
            level += 1
        return out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of keys, so that ascending keys lie in ascending shards."""
    return ((keys >> np.uint64(KEY_BITS - 32)).astype(np.int64) * shards) >> 32


def _read(shards: int, train: Callable[[int | None], bool]):
    block_bytes = min(max(BLOCK_BYTES, SLIVER_BYTES * shards), max(BLOCK_BYTES, MOST_BYTES))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, seqs, size = 0, [], [], 0
        words = _Numbers()

        def block() -> pa.RecordBatch:
            tokens = list(words)
            h = _hashes(tokens)
            shard = (h % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            lengths = np.fromiter(map(len, seqs), "<u4", len(seqs))
            seq, h = rank[np.frombuffer(b"".join(s.tobytes() for s in seqs), np.uint32)], h[order]
            learned = np.fromiter(map(train, ids), bool, len(ids))
            mask = np.repeat(learned, lengths)
            counts = np.bincount(seq[mask], minlength=len(order)).astype("<u4")
            keys, at = np.unique(_bigrams(h[np.roll(seq, 1)], h[seq]), return_inverse=True)
            n = np.bincount(at[mask], minlength=len(keys))
            tokens = [tokens[i] for i in order.tolist()]
            ends = np.searchsorted(shard[order], np.arange(shards + 1)).tolist()
            key_ends = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1)).tolist()
            name = TaskContext.get().partitionId() << 32 | number
            out = [{"block": name, "shard": -1, "doc_ids": list(ids), "train": learned.tobytes(), "lengths": lengths.tobytes(), "seq": token_files.pack(seq), "words": _squeeze(b" ".join(tokens))}]
            for s in range(shards):
                (a, b), (c, d) = ends[s : s + 2], key_ends[s : s + 2]
                if b > a or d > c:
                    out.append({"block": name, "shard": s, "words": _squeeze(b" ".join(tokens[a:b])), "counts": _squeeze(counts[a:b]), "keys": _squeeze_keys(keys[c:d]), "key_counts": _squeeze(n[c:d].astype("<u4"))})
            return pa.RecordBatch.from_pylist(out, schema)

        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                raw = (text.as_py() or "").encode()
                seq = array("I", map(words.__getitem__, raw.lower().split()))
                seq.append(words[END])
                ids.append(name)
                seqs.append(seq)
                size += len(raw) + 8
                if size >= block_bytes:
                    yield block()
                    number, ids, seqs, size, words = number + 1, [], [], 0, _Numbers()
        if ids:
            yield block()

    schema = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("doc_ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("train", "lengths", "seq", "words", "counts", "keys", "key_counts")]])
    return rows


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each shard a row of its own sums, and for each of its blocks the totals of the block's words and the levels of its bigrams."""
    for group in groups(batches, ["shard"], 1):
        shard = group.column("shard")[0].as_py()
        blocks, words, counts = (group.column(c).to_pylist() for c in ("block", "words", "counts"))
        sums: dict[bytes, int] = defaultdict(int)
        for w, c in zip(words, counts):
            for token, n in zip(_grow(w).split(b" "), _grow(c, "<u4").tolist()):
                sums[token] += n
        of_blocks = [_grow_keys(x) for x in group.column("keys").to_pylist()]
        ends = np.cumsum([0, *map(len, of_blocks)]).tolist()
        keys = np.concatenate(of_blocks)
        del of_blocks
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.diff(keys, prepend=np.uint64((1 << 64) - 1)) != 0
        at = np.empty(len(order), np.uint32)
        at[order] = np.cumsum(first) - 1  # the place of each block's keys among the different ones
        keys = keys[first]
        n = np.concatenate([_grow(x, "<u4") for x in group.column("key_counts").to_pylist()])
        n = np.bincount(at, weights=n, minlength=len(keys)).astype(np.int64)
        del order, first
        held = n > 0  # only held-out texts have the others
        own = {"block": None, "shard": shard, "known": sum(x > 0 for x in sums.values()), "tokens": sum(sums.values()), "types": int(held.sum())}
        top = levels(n[held])
        bits = max(LEAST_BITS, 64 * -(-int(top.sum()) * BITS // 64))
        filter_ = LogFrequencyFilter(np.frombuffer(LogFrequencyFilter.segment(keys[held], n[held], bits), np.uint8), 1, bits, int(top.max(initial=1)))
        found = filter_.level(keys).astype("u1")
        out = [own]
        for block, w, a, b in zip(blocks, words, ends, ends[1:]):
            tokens = _grow(w)
            totals = np.fromiter(map(sums.__getitem__, tokens.split(b" ") if tokens else ()), "<u8")
            out.append({"block": block, "shard": shard, "totals": _squeeze(totals), "levels": _squeeze(found[at[a:b]])})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("totals", pa.binary()), ("levels", pa.binary()), *[(c, pa.int64()) for c in ("known", "tokens", "types")]]))


def score(docs: DataFrame, mod: int = 5, held: int = 1) -> DataFrame:
    """One row for each document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from documents whose crc32 of doc_id modulo ``mod`` isn't ``held``.
    """
    spark = docs.sparkSession
    shards = work.partitions(spark)
    train = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % mod != held
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_read(shards, train), _BLOCKS)
    kind = F.when(F.col("shard") < 0, "whole").otherwise("dealt").alias("kind")
    whole, dealt = work.put_parts(read.select("*", kind), "blocks", "kind", ["whole", "dealt"])
    rows = dealt.select("block", "shard", "words", "counts", "keys", "key_counts").repartition(shards, "shard").sortWithinPartitions("shard", "block")
    totals = work.put(rows.mapInArrow(_total, _TOTALS), "totals")
    work.drop(dealt)

    own = totals.filter("block is null")
    sums = own.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("known", "tokens", "types")]).first()
    n_tokens, n_words = sums["tokens"], sums["known"]
    prior = sums["types"] / max(1, n_words)
    of_level = level_counts()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda c, row=row: batch.column(c)[row].as_py()
                ids, learned, lengths = get("doc_ids"), np.frombuffer(get("train"), bool), np.frombuffer(get("lengths"), "<u4").astype(np.int64)
                c = np.concatenate([_grow(x, "<u8") for x in get("totals")]).astype(np.float64)
                seq, h = token_files.unpack(get("seq")), _hashes(_grow(get("words")).split(b" "))
                starts = np.cumsum(lengths) - lengths
                p = (c + 0.5) / (n_tokens + 0.5 * (n_words + 1))
                base, known = np.log10(p)[seq], (c > 0)[seq]
                mine, before = p[seq], np.roll(seq, 1)  # the token before the first is the last one: an end
                level = np.concatenate([_grow(x, "u1") for x in get("levels")])  # of the block's bigrams in ascending order
                pair = of_level[level][np.unique(_bigrams(h[before], h[seq]), return_inverse=True)[1]]
                context, own_count = c[before], c[seq]
                pair = np.minimum(pair, np.minimum(context, own_count))
                mine = (pair + prior * mine) / np.maximum(context + prior, 1e-300) if prior else mine
                sum_ = lambda x, starts=starts: np.add.reduceat(x, starts)
                columns = [pa.array(ids, pa.int64()), pa.array(~learned), pa.array(lengths), pa.array(sum_(known.astype(np.int64))), pa.array(np.full(len(ids), n_tokens, np.int64)), pa.array(sum_(base)), pa.array(sum_(np.log10(mine)))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    back = totals.filter("block is not null").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("shard", "totals", "levels"))).alias("t"))
    of = lambda c: F.transform("t", lambda x: x[c]).alias(c)
    back = back.select("block", of("totals"), of("levels"))
    joined = whole.select("block", "doc_ids", "train", "lengths", "seq", "words").join(back.hint("merge"), "block").drop("block")
    return joined.mapInArrow(rate, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
