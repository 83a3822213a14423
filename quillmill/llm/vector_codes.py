"""Product codes for vectors: each vector as one small index a part, learned by Lloyd's rounds kept up by differences.

Components become integers (floor of ``SCALE`` times the component) and a vector is cut into equal parts, each with a codebook of
its own. The sums and counts behind the codebooks run from round to round: a round assigns every part anew, compares
that with the assignment that the round before has written beside the vector, and shuffles only what changes: minus the
part from its old entry's sum, plus it to the new one's, summed up within each task first. So a round sends at most one row
for each entry and task, and fewer the more settled the assignments are. All is integers, so the result doesn't depend on the order.

Vectors that are null or hold null or non-finite components are left out; so are empty ones, those of another length than the
smallest kept vec_id's, and those with a component of 2^18 or more in magnitude, whose sums of squares leave 64 bits. A length
that the parts don't divide is an error. Fewer vectors than entries give a smaller codebook; an entry that no part takes stays;
equal distances go to the lower index. Repeated vec_ids give a row each (entries start in the order of vec_id, then components). A null vec_id
comes last among the starting entries. No vectors give no rows. Null labels are one label. Further columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm import work

SCALE, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Labels whose sums are sent to every executor; more are joined by a shuffle.
FEW_LABELS = 100_000

_STATE = "vec_id long, label string, ints array<long>, code binary, moved array<struct<part: int, entry: int, n: long, sums: array<long>>>"
_MOVED = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))]))
_SCHEMA = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("ints", pa.list_(pa.int64())), ("code", pa.binary()), ("moved", _MOVED)])


def _integers(vectors: DataFrame) -> DataFrame:
    """vec_id, label, ints of the vectors that count, whatever their length."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float(1 << 18)))
    rows = vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & fine)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.transform(x, lambda v: F.floor(v * SCALE)).alias("ints"))


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row and its squared distance, exact; ties go to the lower index."""
    most = max(np.abs(parts).max(initial=0), np.abs(book).max(initial=0))
    kind = np.float64 if most * most * 4 * parts.shape[1] < 2**53 else np.int64  # products and their sums are whole numbers in either
    a, b = parts.astype(kind), book.astype(kind)
    off = (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    at = off.argmin(1)
    return at, (off[np.arange(len(at)), at] + (a * a).sum(1)).astype(np.int64)


def _assigned(batch: pa.RecordBatch, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The batch's parts (row, part, component), their entries and squared distances."""
    x = batch.column("ints").flatten().to_numpy().reshape(batch.num_rows, len(books), -1)
    found = [nearest(x[:, p], books[p]) for p in range(len(books))]
    return x, np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _round(books: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Assign all parts; the rows come back with their new codes, and one more row holds the task's changes of sums and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, touched = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64), np.zeros(books.shape[:2], bool)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, new, _ = _assigned(batch, books)
            had = batch.column("code").is_valid().to_numpy(zero_copy_only=False)
            old = np.frombuffer(b"".join(c or bytes(len(books)) for c in batch.column("code").to_pylist()), np.uint8).reshape(new.shape).astype(np.int64)
            for p in range(len(books)):
                change = ~had | (old[:, p] != new[:, p])
                for rows, at, sign in ((change, new, 1), (change & had, old, -1)):
                    np.add.at(sums[p], at[rows, p], sign * x[rows, p])
                    np.add.at(counts[p], at[rows, p], sign)
                    touched[p, at[rows, p]] = True
            code = pa.array([r.tobytes() for r in new.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("ints"), code, pa.nulls(batch.num_rows, _MOVED)], schema=_SCHEMA)
        moved = [{"part": int(p), "entry": int(e), "n": int(counts[p, e]), "sums": sums[p, e].tolist()} for p, e in zip(*np.nonzero(touched))]
        if moved:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in list(_SCHEMA)[:4]] + [pa.array([moved], _MOVED)], schema=_SCHEMA)

    return run


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame | None, np.ndarray]:
    """The written state (vec_id, label, ints, last code) and the codebooks (part, entry, component); None without vectors.

    The driver holds only what the parameters bound: the starting entries, and a row of sums for each part and entry.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry's index must fit into a byte")
    rows = _integers(vectors)
    first = rows.select(F.col("vec_id").isNull().alias("none"), "vec_id", "ints").orderBy("none", "vec_id", "ints")
    start = first.limit(1).collect()
    if not start:
        return None, np.zeros((parts, 0, 0), np.int64)
    size = len(start[0].ints)
    if size % parts:
        raise ValueError(f"{parts} parts don't divide vectors of {size} components")
    same = F.size("ints") == size
    books = np.array([r.ints for r in first.filter(same).limit(entries).collect()], np.int64).reshape(-1, parts, size // parts).transpose(1, 0, 2).copy()
    sums, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
    state = rows.filter(same).withColumn("code", F.lit(None).cast("binary"))
    written = None
    for _ in range(rounds):
        after = work.put(state.select("vec_id", "label", "ints", "code").mapInArrow(_round(books), _STATE), "codes")
        moved = after.filter("moved IS NOT NULL").select(F.inline("moved")).groupBy("part", "entry")
        for r in moved.agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(size // parts)]).alias("sums")).collect():
            counts[r.part, r.entry] += r.n
            sums[r.part, r.entry] += r.sums
        used = counts > 0
        books[used] = sums[used] // counts[used][:, None]
        if written is not None:
            work.drop(written)
        written, state = after, after.filter("ints IS NOT NULL")
    return state, books


def fingerprint(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code in hex, error) of every vector by the learned codebooks, and these."""
    state, books = learn(vectors, parts, entries, rounds)
    out = "vec_id long, label string, code string, error long"
    if state is None:
        return vectors.sparkSession.createDataFrame([], out), books

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                _, code, off = _assigned(batch, books)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([r.tobytes().hex() for r in code.astype(np.uint8)]), pa.array(off.sum(1))], ["vec_id", "label", "code", "error"])

    return state.select("vec_id", "label", "ints").mapInArrow(final, out), books


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """``codes`` with ``approx``: the vector that a code stands for."""
    size = books.shape[2]
    flat = F.array(*[F.array(*[F.lit(float(x) / SCALE) for x in entry]) for book in books for entry in book])
    at = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") + p * books.shape[1]
    return codes.withColumn("approx", F.flatten(F.array(*[F.get(flat, at(p)) for p in range(len(books))])) if size else F.array().cast("array<double>"))


def codes(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256."""
    coded, books = encode(vectors)
    coded = work.put(coded, "coded")
    sums = work.put(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "labels")
    few = sums.limit(FEW_LABELS + 1).count() <= FEW_LABELS
    joined = coded.join(F.broadcast(sums) if few else sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(fingerprint(books)).alias("codebooks_sha256"))
