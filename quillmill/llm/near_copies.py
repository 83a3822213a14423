"""SimHash near-deduplication at a Jaccard similarity, with BK-trees in shards.

A document has a wide fingerprint (eight 64-bit SimHashes of its distinct word shingles under different seeds). In each of
several tables it is dealt to a shard by a sample of its bits; the number of sampled bits follows the number of
documents and the number of tables follows from the recall wanted at the very threshold. A shard's pairs within the radius
come out of its BK-tree, as in ``simhash``; at this radius it follows nearly every edge, so shards are kept small.

A spanning forest of the pairs within the radius tells which items hang together: the crowds. Nothing is rejected by the
forest. In a crowd, the sets of shingles meet, and every pair within the radius is settled: by the exact Jaccard
similarity, or because both are in one group already. Members near the crowd's centre come first, so a crowd of copies
of one text is settled in time proportional to its size.

A crowd of over ``BLOCK`` members (or ``VALUES`` shingles) is dealt in parts, a task each, and its best connected items
(``HUBS`` at most) go to every part. Members outside the crowd's largest group then, the strays, are sent to all parts and
settled there against everything else. So what is sent grows with the crowd, and with its strays times its parts; no
pair is left out.

Bits of small sets agree less evenly (a majority of four and of five shingles in 0.81 of cases, not 0.85), so sets of up to
``MEET`` shingles also meet exactly: two similar ones share one of the first shingles of both, rarest first (prefix filtering),
and are compared by their sets; the radius doesn't bind them. A shingle that over ``BLOCK`` of them have among their first
ones is dealt in pairs of blocks.

Texts of equal words are one item. Null, empty and white texts are copies of each other. Of a group, the smallest
doc_id stays, null last; of equal doc_ids any one. An empty table gives an empty result; columns keep their values,
whatever their names.
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
from quillmill.llm.simhash import BKTree

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.97
#: Seeds of a fingerprint, and how many of its words travel with a dealt item; items of a shard, of a part of a crowd; hubs.
SEEDS, TRAVEL, MEMBERS, BLOCK, HUBS = tuple(range(42, 50)), 4, 256, 1_000, 8
#: Sets of so many shingles meet by their shingles too.
MEET = 37
#: Shingles of a part of a crowd.
VALUES = 1 << 20
BITS = 64 * len(SEEDS)
_LANES = np.arange(8, dtype=np.uint64)
_ONES = np.uint64(0x0101010101010101)
_FACTORS = np.array([[0x9E3779B97F4A7C15 + 2 * s] for s in SEEDS[1:]], np.uint64)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; a text of fewer words is one shingle, an empty one has none."""
    tokens = text.encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n]
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(joined[a:b], 42) for a, b in zip(starts.tolist(), ends[-n:].tolist())), np.uint64, n)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The bits of all SimHashes as 64-bit words; other seeds are drawn by mixing the same hashes again."""
    set_ = np.zeros((len(SEEDS), 8, 8), np.int64)
    for k in range(0, len(hashes), 255):  # up to 255 ones fit into each byte
        x = np.repeat(hashes[None, k : k + 255], len(SEEDS), axis=0)
        x[1:] = (x[1:] ^ x[1:] >> np.uint64(31)) * _FACTORS
        x[1:] ^= x[1:] >> np.uint64(29)
        set_ += (x[..., None] >> _LANES & _ONES).sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(-1, 8, 8)
    ones = (2 * set_ > len(hashes)).astype(np.uint64)  # of lane l and byte b: bit 8 b + l
    return (ones << (_LANES[:, None] + np.uint64(8) * _LANES)).sum(axis=(1, 2), dtype=np.uint64)


def bit_agreement(similarity: float) -> float:
    """How often a bit agrees for two sets of about one size and this Jaccard similarity."""
    return 1 - math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


def radius_of(bits: int, similarity: float) -> int:
    """Four deviations beyond the differing bits that are expected at the threshold."""
    agree = bit_agreement(similarity)
    return math.ceil(bits * (1 - agree) + 4 * math.sqrt(bits * agree * (1 - agree)))


def shape(n: int, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[int, int]:
    """Bits sampled and tables for ``n`` items."""
    agree = bit_agreement(similarity)
    bits = min(40, max(6, round(math.log2(max(1, n) / MEMBERS))))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - agree**bits))
    return bits, tables


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def forest(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which of the pairs form a shortest spanning forest."""
    order = np.argsort(d, kind="stable")
    a, b, keep, label = a[order], b[order], np.zeros(len(a), bool), np.arange(n)
    while True:
        x, y = label[a], label[b]
        open_ = np.flatnonzero(x != y)
        if not len(open_):
            break
        best = np.full(n, len(a))
        np.minimum.at(best, x[open_], open_)
        np.minimum.at(best, y[open_], open_)
        keep[best[best < len(a)]] = True
        label = roots(n, a[keep], b[keep])
    return order[keep]


def settled(sets: list[np.ndarray], sig: np.ndarray, radius: int, similarity: float, group: np.ndarray | None = None, asks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (indices a, b) that join all ``sets`` (distinct longs each) of this similarity within the radius, exactly.

    ``group`` has numbers of known groups, whose members need no link. With ``asks`` only pairs count of one that asks
    and one that doesn't.
    """
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    _, of = np.unique(np.concatenate(sets), return_inverse=True)
    codes = np.split(of, np.cumsum(n)[:-1])
    label = np.arange(len(sets)) if group is None else np.unique(group, return_inverse=True)[1]
    bits = np.unpackbits(np.ascontiguousarray(sig).view(np.uint8), axis=1)
    centre = np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(sets)).view(np.uint64)
    order = np.argsort(distance(sig, centre), kind="stable")
    left = np.ones(len(sets), bool)
    if asks is not None:
        order, left = order[asks[order]], ~asks
    marked, a, b = np.zeros(len(of) + 1, bool), [], []
    for x in order.tolist():
        left[x] = False
        near = np.flatnonzero(left & (label != label[x]) & (np.minimum(n, n[x]) >= similarity * np.maximum(n, n[x])))
        near = near[(distance(sig[near], sig[x]) <= radius) | (np.maximum(n[near], n[x]) <= MEET)]
        if not len(near):
            continue
        if n[x]:
            marked[codes[x]] = True
            each = marked[np.concatenate([codes[y] for y in near.tolist()])].astype(np.int64)
            marked[codes[x]] = False
            common = np.add.reduceat(each, np.cumsum(n[near]) - n[near])
            near = near[common >= similarity * (n[x] + n[near] - common)]
        if len(near):
            a += [x] * len(near)
            b += near.tolist()
            label[np.isin(label, label[near])] = label[x]
            if (label == label[0]).all():
                break
    return np.array(a, np.int64), np.array(b, np.int64)


def near_pairs(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, distance): all pairs (a < b) of a shard's fingerprints within the radius, out of its BK-tree."""
    a, b = BKTree(values).pairs(radius)
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    return a, b, distance(values[a], values[b])


def _candidates(items: DataFrame, similarity: float, recall: float) -> DataFrame:
    """(a, b): links that join all rows of items (row, sig, n) of which a chain of pairs within the radius exists.

    Half of a fingerprint and the size travel to the shards.
    """
    spark = items.sparkSession
    bits, tables = shape(items.count(), similarity, recall)
    radius, wide = radius_of(64 * TRAVEL, similarity), 8 * TRAVEL
    rng = np.random.default_rng(3)
    sampled = np.array([rng.choice(BITS, bits, replace=False) for _ in range(tables)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, BITS // 8)
            of = np.unpackbits(sig, axis=1)[:, sampled].astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
            keys = (of + (np.arange(tables, dtype=np.int64) << 40)).ravel()
            cut = pa.ListArray.from_arrays(pa.array(np.arange(0, len(keys) + 1, tables), pa.int32()), pa.array(keys))
            n = batch.column("n").to_numpy().astype("<u4")
            told = [s[:wide].tobytes() + k.tobytes() for s, k in zip(sig, n)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(told, pa.binary()), cut], ["row", "told", "keys"])

    dealt = items.mapInArrow(deal, "row long, told binary, keys array<long>").select("row", "told", F.explode("keys").alias("key"))
    large = work.put(dealt.groupBy("key").agg(F.count("*").alias("count"), F.min("row").alias("least")).filter(F.col("count") > BLOCK).select("key", "least"), "large")
    crowded = not large.isEmpty()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in groups(batches, ["key"]):
            told = np.frombuffer(b"".join(shard.column("told").to_pylist()), np.uint8).reshape(-1, wide + 4)
            values, n = np.ascontiguousarray(told[:, :wide]).view(np.uint64), np.ascontiguousarray(told[:, wide:]).view("<u4").ravel().astype(np.int64)
            row = np.asarray(shard.column("row")).astype(np.int64)
            a, b, d = near_pairs(values, radius)
            fit = np.minimum(n[a], n[b]) >= similarity * np.maximum(n[a], n[b])
            if fit.any():
                a, b = a[fit], b[fit]
                keep = forest(len(row), a, b, d[fit])
                a, b = row[a[keep]], row[b[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    small = dealt.join(large, "key", "left_anti") if crowded else dealt
    found = small.repartition(work.partitions(spark), "key").sortWithinPartitions("key").mapInArrow(search, "a long, b long")
    if crowded:  # a shard of over BLOCK members is taken as a crowd whole
        found = found.unionByName(dealt.select("key", "row").join(large, "key").filter("row <> least").select(F.col("least").alias("a"), F.col("row").alias("b")))
    return found.distinct()


def _short_links(items: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links that join all similar rows of items (row, few), where few is a small set's shingles and else null."""
    spark = items.sparkSession
    small = items.filter(F.size("few") > 0).select("row", "few")
    each = small.select("row", F.size("few").alias("n"), F.explode("few").alias("h"))
    df = work.put(each.groupBy("h").agg(F.count("*").alias("df")).filter("df > 1"), "shared")
    shared = each.join(df, "h").groupBy("row", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("shared"))
    # shingles that no other set has come first in the order and match nothing
    keep = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * F.lit(similarity) - 1e-9).cast("int") + 1 - (F.col("n") - F.size("shared")))
    keyed = work.put(shared.select("row", F.explode(F.slice("shared", F.lit(1), keep)).alias("s")).select("row", F.col("s.h").alias("key")), "keys")
    crowds = keyed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").withColumn("parts", F.ceil(F.col("m") / BLOCK).cast("int"))
    dealt = keyed.join(crowds, "key").withColumn("own", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("row", "key", F.least("own", "other").cast("long").alias("i"), F.greatest("own", "other").cast("long").alias("j")).distinct().join(small, "row")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in groups(batches, ["key", "i", "j"]):
            row = np.asarray(shard.column("row")).astype(np.int64)
            sets = [x.values.to_numpy() for x in shard.column("few")]
            a, b = settled(sets, np.zeros((len(row), len(SEEDS)), np.uint64), BITS, similarity)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(row[a], row[b])), pa.array(np.maximum(row[a], row[b]))], ["a", "b"])

    at = ["key", "i", "j"]
    return dealt.repartition(work.partitions(spark), *at).sortWithinPartitions(*at).mapInArrow(meet, "a long, b long").distinct()


def _verified(own: DataFrame, items: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b): enough links to join all similar items that ``pairs`` join; ``own`` has row and text, items row and sig."""
    spark, radius = own.sparkSession, radius_of(BITS, similarity)
    crowd = work.put(components(pairs).withColumnRenamed("node", "row"), "crowds")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t.as_py() or "", words)).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(found, pa.list_(pa.int64()))], ["row", "set"])

    def settle(keys: list[str]):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in groups(batches, keys):
                row, group = (np.asarray(part.column(c)).astype(np.int64) for c in ("row", "group"))
                asks = np.asarray(part.column("asks"))
                sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint64).reshape(-1, len(SEEDS))
                members = [x.values.to_numpy() for x in part.column("set")]
                a, b = settled(members, sig, radius, similarity, group, asks if asks.any() else None)
                if len(a):
                    a, b = row[a], row[b]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        return rows

    def links(dealt: DataFrame, *keys: str) -> DataFrame:
        at = ["component", *keys]
        dealt = dealt.select("row", "set", "sig", "group", "asks", *at).repartition(work.partitions(spark), *at).sortWithinPartitions(*at)
        return dealt.mapInArrow(settle(at), "a long, b long")

    of = work.among(own, crowd.select("row"), "row", "left_semi").mapInArrow(sets, "row long, set array<long>")
    of = work.put(of.join(crowd, "row").join(items.select("row", "sig"), "row"), "sets")
    alone = of.withColumn("group", F.col("row")).withColumn("asks", F.lit(False))
    sizes = of.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(F.size("set")) / VALUES)).cast("int").alias("parts"))
    large = work.put(sizes.filter("parts > 1"), "large")
    if large.isEmpty():
        return links(alone)
    small = work.put(links(alone.join(large, "component", "left_anti")), "settled")
    placed = of.join(large, "component").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    placed = work.put(placed, "placed")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("row")).groupBy("row").agg(F.count("*").alias("degree"))
    hubs = placed.select("component", "row").join(degree, "row").groupBy("component", F.pmod(F.xxhash64("row"), F.lit(HUBS)).alias("k")).agg(F.max_by("row", F.struct("degree", "row")).alias("row"))
    hubs = placed.join(work.put(hubs.select("row"), "hubs"), "row", "left_semi").withColumn("at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).filter("at <> part")
    first = placed.unionByName(hubs.drop("part").withColumnRenamed("at", "part")).withColumn("group", F.col("row")).withColumn("asks", F.lit(False))
    first = work.put(links(first, "part"), "settled")

    joined = components(first).select(F.col("node").alias("row"), F.col("component").alias("group"))
    now = work.put(placed.select("row", "component").join(joined, "row", "left").select("row", "component", F.coalesce("group", "row").alias("group")), "groups")
    largest = now.groupBy("component", "group").count().groupBy("component").agg(F.max_by("group", F.struct("count", "group")).alias("largest"))
    strays = now.join(largest, "component").filter("group <> largest").select("row", "component")
    strays = work.put(strays, "strays")
    blocks = work.put(strays.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    members = placed.join(now.select("row", "group"), "row").join(blocks, "component")
    asking = members.join(strays.select("row"), "row", "left_semi")
    members = members.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(False))
    asking = asking.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("asks", F.lit(True))
    second = links(members.unionByName(asking.select(members.columns)), "part", "block")
    return small.unionByName(first).unionByName(second)


def deduplicate(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with their columns unchanged."""
    since = work.mark()
    own = work.put(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d")), "numbered")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, same, n, few = [], [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                h = np.unique(shingle_hashes(text, words))  # sets, as in the similarity: else unequal repeats look like unequal sizes
                sig.append(wide_fingerprint(h).tobytes())
                same.append(xxhash.xxh128_digest(b" ".join(text.encode().lower().split())))
                n.append(len(h))
                few.append(h.view(np.int64) if len(h) <= MEET else None)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(sig, pa.binary()), pa.array(same, pa.binary()), pa.array(n, pa.int64()), pa.array(few, pa.list_(pa.int64()))], ["row", "sig", "same", "n", "few"])

    texts = own.select("row", F.col("d.text").alias("text"))
    signed = work.put(texts.mapInArrow(sign, "row long, sig binary, same binary, n long, few array<long>"), "signed")
    ids = own.select("row", F.isnull("d.doc_id").alias("none"), F.col("d.doc_id").alias("id"))
    first = F.min(F.struct("none", "id", "row"))
    items = signed.groupBy("same").agg(F.min("row").alias("item"), F.min("sig").alias("sig"), F.min("n").alias("n"), F.first("few").alias("few"))
    items = work.put(items.select(F.col("item").alias("row"), "sig", "n", "same", "few"), "items")
    short = _short_links(items.select("row", "few"), similarity)
    pairs = work.put(_candidates(items.select("row", "sig", "n"), similarity, recall).unionByName(short).distinct(), "candidates")
    joined = components(_verified(texts, items, pairs, words, similarity)).withColumnRenamed("node", "row")
    of_same = signed.select("row", "same").join(ids, "row").groupBy("same").agg(first.alias("first"))
    of_item = items.select("row", "same").join(of_same, "same").join(joined, "row", "left").withColumn("component", F.coalesce("component", "row"))
    of_item = work.put(of_item.select("same", "component", "first"), "classes")
    stay = work.put(of_item.groupBy("component").agg(F.min("first").alias("first")).select("component", F.col("first.row").alias("stay")), "stay")
    gone = signed.select("row", "same").join(of_item.select("same", "component"), "same").join(stay, "component").filter("row <> stay").select("row")
    gone = work.put(gone, "gone")
    work.sweep(since, own, gone)
    return work.among(own, gone, "row", "left_anti").select("d.*")
