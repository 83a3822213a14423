"""SimHash fingerprints and their near-duplicate groups by sharded BK-trees.

A text's fingerprint is made of its word shingles. Of three disjoint runs of bits, fingerprints within two bits agree in
at least one, so each is dealt to three shards, one for each run and its value. The runs' width follows the number of
distinct fingerprints, so that a shard holds some hundreds at any size (up to 21 bits, three runs of which fill the
64). A shard's BK-tree (children keyed by the Hamming distance to their parent) is built where the shard's fingerprints
meet and answers all of them at once, following only edges within the radius; equal fingerprints are one node. Every
link comes out of a tree. Trees go to the tasks that hold their queries, not to every executor, as together they have
three nodes for each fingerprint and no bound to broadcast under.

A shard of over ``SHARD`` fingerprints is a crowd of near copies, or of texts that share their bits: no tree is built,
its members meet instead at the 65 strings within one bit of each, of which two fingerprints share one exactly if they
differ in two bits or fewer. No such place holds more than 65, so that a crowd costs time in proportion to its size, and
no link is lost.

Null and empty texts have fingerprint 0. Rows with a null doc_id take part; a component's id is its smallest non-null
doc_id. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.llm import work
from quillmill.llm.components import components
from quillmill.llm.grouped import groups, roots

RADIUS, NODES, SHARD = 2, 256, 4_000


def fingerprint(text: str, words: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the shingles of ``words`` words, repeats included."""
    tokens = text.encode().lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashed, n = xxhash.xxh64_intdigest, len(tokens) - words + 1
    h = np.fromiter((hashed(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist())), np.uint64, n)
    set_ = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 16):  # a very long text takes no more memory than this
        part = h[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        set_ += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_ > n).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, name: str = "doc_id") -> DataFrame:
    """``name`` (a long) and fp (the fingerprint's 64 bits as a signed long) of rows (``name``, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py() or "", words) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(name), pa.array(found.view(np.int64))], [name, "fp"])

    return docs.select(F.col(name).cast("long").alias(name), "text").mapInArrow(rows, f"{name} long, fp long")


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints of one word (1-d) or of several (2-d)."""
    bits = np.bitwise_count(x ^ y)
    return bits if bits.ndim == 1 else bits.sum(axis=1, dtype=np.int64)


class BKTree:
    """A BK-tree over unsigned 64-bit values, or rows of several; each node keeps its children by distance to it."""

    def __init__(self, values: np.ndarray):
        self.values = values
        self.nodes: list[tuple[int, list[tuple[int, int]]]] = []  # (index of the value, [(distance, node)])
        stack = [(np.arange(len(values)), -1, 0)]
        while stack:
            own, parent, edge = stack.pop()
            me = len(self.nodes)
            self.nodes.append((int(own[0]), []))
            if parent >= 0:
                self.nodes[parent][1].append((edge, me))
            if len(rest := own[1:]):
                d = _far(values[rest], values[own[0]])
                stack += [(rest[d == e], me, int(e)) for e in np.unique(d)]

    def pairs(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of all pairs of the tree's own values within ``radius``; all values descend together."""
        a, b = [], []
        stack = [(0, np.arange(len(self.values)))] if self.nodes else []
        while stack:
            node, asking = stack.pop()
            at, children = self.nodes[node]
            d = _far(self.values[asking], self.values[at]).astype(np.int64)
            near = asking[d <= radius]
            a.append(near[near > at])
            b.append(np.full(len(a[-1]), at))
            for edge, child in children:
                if len(follow := asking[np.abs(d - edge) <= radius]):
                    stack.append((child, follow))
        return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def run_bits(n: int) -> int:
    """Bits of each of three runs for ``n`` fingerprints: ``NODES`` in a shard, if they spread evenly."""
    return min(64 // (RADIUS + 1), max(1, math.ceil(math.log2(max(1, n) / NODES))) if n > NODES else 1)


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): enough links between the fingerprints ``fp`` to join all that are linked within RADIUS."""
    width = run_bits(distinct.count())
    runs = [F.shiftrightunsigned("fp", width * k).bitwiseAND((1 << width) - 1) for k in range(RADIUS + 1)]
    keys = [F.lit(k << 32).bitwiseOR(run) for k, run in enumerate(runs)]
    dealt = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    large = work.put(dealt.groupBy("key").count().filter(F.col("count") > SHARD).select("key"), "large")
    crowded = not large.isEmpty()
    small = dealt.join(large, "key", "left_anti") if crowded else dealt

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for shard in groups(batches, ["key"]):
            values = np.asarray(shard.column("fp")).astype(np.int64).view(np.uint64)
            root = roots(len(values), *BKTree(values).pairs(RADIUS))
            linked = np.flatnonzero(root != np.arange(len(values)))
            if len(linked):
                a.append(values[linked].view(np.int64))
                b.append(values[root[linked]].view(np.int64))
            if len(a) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    spread = small.repartition(work.partitions(distinct.sparkSession), "key").sortWithinPartitions("key")
    found = spread.mapInArrow(search, "a long, b long")
    if crowded:
        members = dealt.join(large, "key", "left_semi").select("fp").distinct()
        near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << k) - ((1 << 64) if k == 63 else 0))) for k in range(64)])
        meet = members.select("fp", F.explode(near).alias("place")).groupBy("place").agg(F.collect_list("fp").alias("all"))
        pairs = meet.filter(F.size("all") > 1).select(F.explode("all").alias("a"), F.array_min("all").alias("b"))
        found = found.unionByName(pairs.filter("a <> b"))
    return found


def _classes(rows: DataFrame) -> DataFrame:
    """(fp, component) for each distinct fingerprint of ``rows``."""
    distinct = work.put(rows.select("fp").distinct(), "distinct")
    joined = components(links(distinct)).withColumnRenamed("node", "fp")
    return distinct.join(joined, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row for each document: doc_id, fp, component_id (the smallest doc_id reachable by links)."""
    rows = work.put(fingerprints(docs, words), "fingerprints")
    classes = work.put(_classes(rows), "classes")
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("least")).join(classes, "fp")
    least = least.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = work.put(classes.join(least, "component").select("fp", "component_id"), "member")
    return rows.join(by_fp.hint("merge"), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, words: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with their columns unchanged: that of the smallest doc_id.

    The rows are written with a number of their own, so that repeated or null doc_ids do no harm.
    """
    own = work.put(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")), "numbered")
    rows = work.put(fingerprints(own.select("row", "d.text"), words, "row"), "fingerprints")
    ids = own.select("row", F.isnull("d.doc_id").alias("none"), F.col("d.doc_id").alias("id"))
    first = F.min(F.struct("none", "id", "row"))
    by_fp = rows.join(ids, "row").groupBy("fp").agg(first.alias("first"))
    stay = by_fp.join(_classes(rows), "fp").groupBy("component").agg(F.min("first").alias("first")).select("first.row")
    return own.join(stay, "row", "left_semi").select("d.*")


def query(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
