"""A topic model (online variational Bayes over whole passes) whose terms are as many as the texts bring.

No task, and not the driver, holds all terms: texts are dealt into blocks, terms into shards. In a pass a block reads the
weights of its own terms, infers its texts' shares of topics, and sends for each of its terms a part of the next weight;
a shard sums these by term and sends the sums back. What travels is one row of numbers for each block and shard, in all ``topics``
32-bit numbers for each term of each block, twice a pass, and the packed texts. Each pass reads every text once and every term counts.

Rates, priors and the update of the texts' prior are those of Spark's own LDA (its default values), which keeps a dense
matrix of terms and topics in every task; a text's inference ends as the reference's does, once it is settled or after 100 steps. A term's first weights are drawn from its hash, so a result doesn't depend on how rows lie.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.operators.checkpoints import drop, saved

#: Tokens of a block at most (but for one text), terms of a shard and pairs of texts and terms inferred at once, about.
TOKENS, TERMS, PAIRS = 1_000_000, 500_000, 1 << 16
# fixed values: learning offset and decay, the shape of first weights, the change at which a text is settled, and the
# reference's own bound of steps for a text that isn't (gensim's iterations=100, beside its passes=10)
OFFSET, DECAY, SHAPE, SETTLED, ITERATIONS = 1024.0, 0.51, 100.0, 1e-3, 100

_BLOCK = "block int, ids binary, sizes binary, terms binary, counts binary, keys binary, shards binary, first binary, seeds binary"
_STATE = "block int, shard int, weights binary"


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    z = x + 6
    y = 1 / (z * z)
    pair = lambda v: (2 * v + 1) / (v * (v + 1))
    return np.log(z) - 0.5 / z - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132)))) - pair(x) - pair(x + 2) - pair(x + 4)


def trigamma(x: np.ndarray) -> np.ndarray:
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(6):
        small = x < 6
        out += np.where(small, 1 / (x * x), 0.0)
        x = x + small
    y = 1 / (x * x)
    return out + 1 / x + y / 2 + y / x * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def first_weights(seeds: np.ndarray, topics: int, seed: int) -> np.ndarray:
    """Draws of about a gamma distribution of shape ``SHAPE`` and mean 1, by Wilson and Hilferty's cube, from the terms' hashes."""

    def uniform(k: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = seeds.view(np.uint64)[:, None] + (np.arange(topics, dtype=np.uint64) * np.uint64(2) + np.uint64(k + 1000 * seed)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return ((x ^ x >> np.uint64(31)) >> np.uint64(11)).astype(float) / 2**53

    normal = np.sqrt(-2 * np.log(1 - uniform(0))) * np.cos(2 * np.pi * uniform(1))
    return (1 - 1 / (9 * SHAPE) + normal / (3 * np.sqrt(SHAPE))) ** 3


def _shares(gamma: np.ndarray) -> np.ndarray:
    return np.exp(digamma(gamma) - digamma(gamma.sum(axis=1))[:, None])


def _norm(near: np.ndarray, share: np.ndarray, n: np.ndarray) -> np.ndarray:
    out = np.full(near.shape[1], 1e-100)
    for x, own in zip(near, np.ascontiguousarray(share.T)):
        out += x * np.repeat(own, n)
    return out


def infer(terms: np.ndarray, counts: np.ndarray, sizes: np.ndarray, beta: np.ndarray, alpha: np.ndarray, each: Callable | None = None) -> np.ndarray:
    """The texts' variational weights of topics; ``each`` gets (terms, the pairs' weights of topics).

    ``terms`` and ``counts`` stand text after text, ``sizes`` has each text's number of terms (1 or more), ``beta`` the terms' exponents.
    """
    ends = np.cumsum(sizes)
    out = np.zeros((len(sizes), len(alpha)))
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PAIRS, side="right")))
        begin = ends[a - 1] if a else 0
        own = np.arange(a, b)
        t, c, n = terms[begin : ends[b - 1]], counts[begin : ends[b - 1]].astype(float), sizes[a:b]
        near = np.ascontiguousarray(beta[t].T)  # a row for each topic
        gamma = np.tile(alpha, (b - a, 1)) + np.add.reduceat(c, np.cumsum(n) - n)[:, None] / len(alpha)
        whole = (t, c, n, near)
        for _ in range(ITERATIONS):
            share, at = _shares(gamma), np.cumsum(n) - n
            ratio = c / _norm(near, share, n)
            now = alpha + share * np.array([np.add.reduceat(x * ratio, at) for x in near]).T
            open_ = np.abs(now - gamma).mean(axis=1) > SETTLED
            out[own], gamma = now, now
            if not open_.any():
                break
            if open_.sum() < 0.8 * len(own) or len(own) < 16 and not open_.all():
                pairs = np.repeat(open_, n)
                own, gamma, n, c, near = own[open_], gamma[open_], n[open_], c[pairs], near[:, pairs]
        if each:
            t, c, n, near = whole
            share = _shares(out[a:b])
            each(t, (near * np.repeat(share.T, n, axis=1) * (c / _norm(near, share, n))).T)
        a = b
    return out


class _Block:
    """A packed row of ``_BLOCK``, with the weights of its terms (from ``state``, or the first ones)."""

    def __init__(self, packed: pa.Table, state: pa.Table, topics: int, seed: int):
        read = lambda c, kind: np.frombuffer(packed.column(c)[0].as_py(), kind)
        self.number = packed.column("block")[0].as_py()
        self.sizes, self.terms, self.counts = read("sizes", np.int32), read("terms", np.int32), read("counts", np.int32)
        self.keys, self.shards, self.first, self.ids = read("keys", np.int64), read("shards", np.int32), read("first", bool), packed.column("ids")[0].as_py()
        if state.num_rows:
            parts = state.sort_by("shard").column("weights").to_pylist()
            self.weights = np.frombuffer(b"".join(parts), np.float32).reshape(-1, topics).astype(float)
        else:
            self.weights = first_weights(read("seeds", np.int64), topics, seed).astype(np.float32).astype(float)


class Model:
    """Texts (doc_id, own: an array of tokens, none of them empty) packed into blocks, and the weights of their terms after ``passes``."""

    def __init__(self, texts: DataFrame, topics: int, seed: int, passes: int):
        self.topics, self.seed = topics, seed
        self.id = texts.schema["doc_id"].dataType.simpleString()
        spark = texts.sparkSession
        own = texts = saved(texts.select("doc_id", "own"))
        tokens, self.docs = own.agg(F.coalesce(F.sum(F.size("own")), F.lit(0)), F.count("*")).first()
        wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
        blocks = max(1, -(-tokens // TOKENS), min(wide, -(-tokens // (TOKENS // 20))))
        own = own.withColumn("block", F.pmod(F.xxhash64("doc_id", F.size("own")), F.lit(blocks)).cast("int"))
        pairs = saved(own.select("block", F.explode("own").alias("term")).distinct())
        terms = pairs.groupBy("term").agg(F.min("block").alias("least"))
        self.terms = saved(terms.withColumn("key", F.monotonically_increasing_id()))
        self.count, met = self.terms.count(), pairs.count()
        shards = max(1, -(-met // TERMS), min(wide, -(-met // (TERMS // 20))))
        here = pairs.join(self.terms, "term").select("block", "term", "key", (F.col("block") == F.col("least")).alias("first"), F.xxhash64("term").alias("seed"))
        here = here.withColumn("shard", F.pmod("seed", F.lit(shards)).cast("int"))
        self.tasks = max(wide, blocks)
        dealt = lambda rows: rows.repartition(self.tasks, "block").groupBy("block")
        self.packed = saved(dealt(own).cogroup(dealt(here)).applyInArrow(_pack, _BLOCK))
        drop(pairs, texts)
        self.alpha = np.full(topics, 1 / topics)
        self.state, self.totals = None, np.ones(topics)
        if self.count:
            self._begin()
            for turn in range(1, passes + 1):
                self._turn(turn)

    def _each(self, work: Callable[[_Block], pa.Table], schema: str) -> DataFrame:
        """``work`` over the blocks with their weights."""
        topics, seed = self.topics, self.seed
        if self.state is None:
            empty = pa.table({"shard": pa.array([], pa.int32()), "weights": pa.array([], pa.binary())})
            return self.packed.repartition(self.tasks, "block").groupBy("block").applyInArrow(lambda packed: work(_Block(packed, empty, topics, seed)), schema)
        spread = lambda rows: rows.repartition(self.tasks, "block").groupBy("block")
        both = spread(self.packed).cogroup(spread(self.state))
        return both.applyInArrow(lambda packed, state: work(_Block(packed, state, topics, seed)), schema)

    def _begin(self) -> None:
        def total(block: _Block) -> pa.Table:
            return pa.table({"block": pa.array([block.number], pa.int32()), "t": pa.array([block.weights[block.first].sum(axis=0)], pa.list_(pa.float64()))})

        self._total(self._each(total, "block int, t array<double>").orderBy("block").collect())

    def _total(self, rows: list) -> None:
        self.totals = np.sum([r.t for r in rows], axis=0)

    def _turn(self, turn: int) -> None:
        topics, alpha, totals = self.topics, self.alpha, self.totals
        rate, eta = (OFFSET + turn) ** -DECAY, 1 / topics

        def spread(block: _Block) -> pa.Table:
            beta = np.exp(digamma(block.weights) - digamma(totals))
            found = np.zeros_like(block.weights)
            seen = lambda t, x: _add(found, t, x)
            gamma = infer(block.terms, block.counts, block.sizes, beta, alpha, seen)
            logs = (digamma(gamma) - digamma(gamma.sum(axis=1))[:, None]).sum(axis=0)
            found = rate * found
            found[block.first] += (1 - rate) * block.weights[block.first] + rate * eta
            cut = np.flatnonzero(np.diff(block.shards, prepend=-1))
            ends = [*cut[1:].tolist(), len(block.shards)]
            parts = [(block.keys[a:b].tobytes(), found[a:b].astype(np.float32).tobytes()) for a, b in zip(cut.tolist(), ends)]
            n = len(parts)
            return pa.table({
                "block": pa.array([block.number] * n, pa.int32()), "shard": pa.array(block.shards[cut], pa.int32()), "keys": pa.array([k for k, _ in parts], pa.binary()),
                "weights": pa.array([w for _, w in parts], pa.binary()), "t": pa.array([logs if i == 0 else np.zeros(topics) for i in range(n)], pa.list_(pa.float64())),
            })

        def gather(shard: pa.Table) -> pa.Table:
            shard = shard.sort_by("block")
            keys = [np.frombuffer(x, np.int64) for x in shard.column("keys").to_pylist()]
            weights = np.frombuffer(b"".join(shard.column("weights").to_pylist()), np.float32).reshape(-1, topics)
            known, where = np.unique(np.concatenate(keys), return_inverse=True)
            new = np.zeros((len(known), topics))
            _add(new, where, weights)
            back = np.split(new.astype(np.float32)[where], np.cumsum([len(k) for k in keys])[:-1])
            logs = shard.column("t").to_pylist()
            sums = [np.concatenate([new.astype(np.float32).astype(float).sum(axis=0) if i == 0 else np.zeros(topics), logs[i]]) for i in range(len(keys))]
            return pa.table({"block": shard.column("block"), "shard": shard.column("shard"), "weights": pa.array([x.tobytes() for x in back], pa.binary()), "t": pa.array(sums, pa.list_(pa.float64()))})

        sent = self._each(spread, "block int, shard int, keys binary, weights binary, t array<double>")
        state = saved(sent.repartition(self.tasks, "shard").groupBy("shard").applyInArrow(gather, _STATE + ", t array<double>"))
        sums = [F.sum(F.col("t")[i]) for i in range(2 * topics)]
        got = np.array(state.agg(*sums).first(), float)  # two numbers for each topic
        if self.state is not None:
            drop(self._held)
        self._held, self.state, self.totals = state, state.select("block", "shard", "weights"), got[:topics]
        self._prior(got[topics:] / self.docs, rate)

    def _prior(self, logs: np.ndarray, rate: float) -> None:
        """One step of Newton's for the texts' prior, from the mean logs of their shares."""
        alpha, n = self.alpha, self.docs
        slope = n * (digamma(alpha.sum()) - digamma(alpha) + logs)
        c, q = n * trigamma(alpha.sum()), -n * trigamma(alpha)
        b = (slope / q).sum() / (1 / c + (1 / q).sum())
        new = alpha - rate * (slope - b) / q
        if (new > 0).all():
            self.alpha = new

    def top(self, k: int) -> DataFrame:
        """(topic, rank, term, weight): the k weightiest terms of each topic, of equal ones the first by name."""
        topics, totals = self.topics, self.totals

        def best(block: _Block) -> pa.Table:
            keys, weights = block.keys[block.first], block.weights[block.first]
            out = []
            for topic in range(topics):
                least = np.partition(weights[:, topic], -k)[-k] if len(keys) > k else -np.inf
                out += [(topic, int(key), float(w)) for key, w in zip(keys[weights[:, topic] >= least], weights[weights[:, topic] >= least, topic])]
            topic, key, w = zip(*out) if out else ((), (), ())
            return pa.table({"topic": pa.array(topic, pa.int32()), "key": pa.array(key, pa.int64()), "w": pa.array(w, pa.float64())})

        from pyspark.sql.window import Window

        each = self._each(best, "topic int, key long, w double").join(self.terms.select("key", "term"), "key")
        each = each.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("w"), "term")) - 1).filter(F.col("rank") < k)
        share = F.col("w") / F.element_at(F.array(*[F.lit(float(t)) for t in totals]), F.col("topic") + 1)
        return each.select("topic", "rank", "term", F.round(share, 6).alias("weight"))

    def shares(self) -> DataFrame:
        """(doc_id, topic, weight) of every text."""
        totals, alpha = self.totals, self.alpha

        def own(block: _Block) -> pa.Table:
            gamma = infer(block.terms, block.counts, block.sizes, np.exp(digamma(block.weights) - digamma(totals)), alpha)
            gamma /= gamma.sum(axis=1)[:, None]
            ids = pa.ipc.open_stream(block.ids).read_all().column("doc_id").combine_chunks()
            at = np.repeat(np.arange(len(ids)), len(alpha))
            return pa.table({"doc_id": ids.take(pa.array(at)), "topic": pa.array(np.tile(np.arange(len(alpha), dtype=np.int32), len(ids))), "weight": pa.array(gamma.ravel())})

        return self._each(own, f"doc_id {self.id}, topic int, weight double").withColumn("weight", F.round("weight", 6))


def _add(to: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    for k in range(to.shape[1]):
        to[:, k] += np.bincount(at, values[:, k], len(to))


def _pack(texts: pa.Table, terms: pa.Table) -> pa.Table:
    terms = terms.take(pc.sort_indices(terms, [("shard", "ascending"), ("key", "ascending")]))
    own = texts.column("own").combine_chunks()
    sizes = pc.list_value_length(own).to_numpy().astype(np.int64)
    codes = pc.index_in(own.flatten(), terms.column("term").combine_chunks()).to_numpy()
    pairs, counts = np.unique(np.repeat(np.arange(len(sizes)), sizes) * terms.num_rows + codes, return_counts=True)
    order = np.argsort(texts.column("doc_id").to_numpy(), kind="stable") if pa.types.is_integer(texts.schema.field("doc_id").type) and not texts.column("doc_id").null_count else np.arange(len(sizes))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    text = place[pairs // terms.num_rows]
    sort = np.argsort(text, kind="stable")
    ids = texts.select(["doc_id"]).take(pa.array(order))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, ids.schema) as writer:
        writer.write_table(ids)
    column = lambda c: terms.column(c).to_numpy()
    row = {
        "block": terms.column("block")[0].as_py(), "ids": sink.getvalue().to_pybytes(), "sizes": np.bincount(text, minlength=len(order)).astype(np.int32),
        "terms": (pairs % terms.num_rows)[sort].astype(np.int32), "counts": counts[sort].astype(np.int32), "keys": column("key"), "shards": column("shard"), "first": column("first"), "seeds": column("seed"),
    }
    kind = lambda c: pa.int32() if c == "block" else pa.binary()
    return pa.table({c: pa.array([v.tobytes() if isinstance(v, np.ndarray) else v], kind(c)) for c, v in row.items()})
