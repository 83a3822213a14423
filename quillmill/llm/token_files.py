"""Token ids in files of compressed byte or bit planes, and their reading.

Ids are those of the tokenizers library; words of common characters go through ``bpe``'s merge engine over the same merges,
which the tests hold against the library. Documents are dealt into ranges of doc_id, one file for each range, ascending within and across files. A file is a
sequence of segments: whole documents with a document index (doc_ids, lengths), and a blob of fixed-size id blocks. Each block is
transposed into planes, each plane is compressed with zstandard, and the blob starts with a chunk index of the planes'
sizes, so one block can be read alone. Segments travel as rows of Parquet, so that Spark's committer, any file system
that Spark reaches, and a lost executor's second attempt all work.

Blob: ``QMT1``, then as little-endian unsigned 32-bit integers: planes in a block, ids in a block, ids in all, blocks;
the sizes of all planes, block by block (0: only zeros); then the planes.

Null texts count as empty and hold the end id alone. Rows with a null doc_id come first; rows with equal doc_id each stay,
in an order by their texts' hash. An empty
table gives no segments. Columns besides ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.llm import bpe, work

MAGIC, BLOCK, SEGMENT = b"QMT1", 16_384, 400_000

_SEGMENTS = "part int, segment int, before long, n_ids long, doc_ids array<long>, lengths array<int>, blob binary"


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Byte planes (4) or bit planes (32) of a block; a plane of zeros is empty."""
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if bits:
        planes = np.packbits(np.unpackbits(planes.reshape(4, -1, 1), axis=2, bitorder="little").transpose(0, 2, 1).reshape(32, -1), axis=1, bitorder="little")
    return [p.tobytes() if p.any() else b"" for p in planes]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    if len(planes) == 4:
        for k, p in enumerate(planes):
            if p:
                out[:, k] = np.frombuffer(p, np.uint8)
    else:
        for k, p in enumerate(planes):
            if p:
                out[:, k // 8] |= np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n] << (k % 8)
    return out.view("<u4").ravel()


def pack(ids: np.ndarray, bits: bool = False, block: int = BLOCK, level: int = 1) -> bytes:
    squeeze = zstandard.ZstdCompressor(level=level).compress
    planes = [squeeze(p) if p else b"" for k in range(0, len(ids), block) for p in to_planes(ids[k : k + block], bits)]
    blocks = -(-len(ids) // block)
    return b"".join([MAGIC, struct.pack("<4I", 32 if bits else 4, block, len(ids), blocks), np.array([*map(len, planes)], "<u4").tobytes(), *planes])


def unpack(blob: bytes, only: int | None = None) -> np.ndarray:
    """All ids of a blob, or those of block ``only``, found by the chunk index."""
    if blob[:4] != MAGIC:
        raise ValueError("not a token blob")
    per, block, n, blocks = struct.unpack_from("<4I", blob, 4)
    sizes = np.frombuffer(blob, "<u4", per * blocks, 20)
    ends = 20 + sizes.nbytes + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    grow, out = zstandard.ZstdDecompressor().decompress, []
    for k in range(blocks) if only is None else [only]:
        own = range(per * k, per * k + per)
        out.append(from_planes([grow(blob[ends[i] : ends[i + 1]]) if sizes[i] else b"" for i in own], min(block, n - block * k)))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def write(docs: DataFrame, tokenizer_path: str, end_id: int, location: str | None = None, bits: bool = False) -> str:
    """Encode ``docs``, append ``end_id`` to each, and write the files; returns where they are."""
    spark = docs.sparkSession
    location = location or work.path(spark, "tokens")
    shared = spark.sparkContext.broadcast(bpe.read_tokenizer(tokenizer_path))
    end = np.array([end_id], "<u4").tobytes()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part = bpe.encoder(shared.value), TaskContext.get().partitionId()
        names, held, lengths, n, before, k = [], [], [], 0, 0, 0

        def full() -> pa.RecordBatch:
            blob = pack(np.frombuffer(b"".join(held), "<u4"), bits)
            row = {"part": [part], "segment": [k], "before": [before], "n_ids": [n], "doc_ids": [names], "lengths": [lengths], "blob": [blob]}
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("blob", pa.binary())]))

        for batch in batches:
            for name, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = e.encode(text.as_py() or "") + end
                names.append(name)
                held.append(ids)
                lengths.append(len(ids) // 4)
                n += lengths[-1]
                if n >= SEGMENT:
                    yield full()
                    names, held, lengths, n, before, k = [], [], [], 0, before + n, k + 1
        if names:
            yield full()

    # rows of one doc_id, or of none, may be many: their texts' hash and a number of their own part them too
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.rand(1).alias("r"))
    ranges = own.repartitionByRange(work.partitions(spark), "doc_id", "h", "r").sortWithinPartitions("doc_id", "h", "r")
    ranges.select("doc_id", "text").mapInArrow(segments, _SEGMENTS).write.option("compression", "none").parquet(location)
    return location


def _placed(spark: SparkSession, location: str) -> DataFrame:
    """The segments with ``start``, the ids of all documents before each.

    Only one row for each file passes through the window and is broadcast; their number is that of the write's partitions.
    """
    segments = spark.read.schema(_SEGMENTS).parquet(location)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("earlier"))
    return segments.join(F.broadcast(parts), "part").select((F.col("earlier") + F.col("before")).alias("start"), "doc_ids", "lengths", "blob")


def read(spark: SparkSession, location: str) -> DataFrame:
    """doc_id, start, ids (array<long>) of each document in the files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for start, names, lengths, ids in _segments(batches):
            starts = start + np.concatenate([[0], np.cumsum(lengths)])
            cut = pa.ListArray.from_arrays(pa.array(starts - start, pa.int32()), pa.array(ids.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(starts[:-1], pa.int64()), cut], ["doc_id", "start", "ids"])

    return _placed(spark, location).mapInArrow(rows, "doc_id long, start long, ids array<long>")


def checksums(spark: SparkSession, location: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for start, names, lengths, ids in _segments(batches):
            ends = np.cumsum(lengths)
            raw, at = memoryview(ids.astype("<u4").tobytes()), [0, *ends.tolist()]
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _placed(spark, location).mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    for batch in batches:
        for k in range(batch.num_rows):
            start, names, lengths, blob = (batch.column(c)[k].as_py() for c in ("start", "doc_ids", "lengths", "blob"))
            yield start, names, np.array(lengths, np.int64), unpack(blob)
