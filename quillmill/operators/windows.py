"""Strided windows over a manuscript's running words: entropy and bursts.

Paragraphs are ranged by (manuscript, paragraph); a word's place in its manuscript is its place in the range plus the sums of
the ranges before, so only one row for each range and manuscript passes through a window function. Words are then dealt
into blocks of ``BLOCK`` windows each, with the words after a block that its last windows reach into. A window lies in one
block alone, whatever the size of its manuscript, and a block is counted in one Arrow pass over whole numbers.

Bursts need each term's counts of all blocks. A block's terms travel once, as compressed columns, to the lot of their
manuscript and hash, and a lot has the whole of its terms: no row for a term of a block is written or joined.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions import text as tx
from quillmill.functions.lexicons import STOPWORDS
from quillmill.operators.checkpoints import saved

#: Windows of a block, words of a lot of terms, about, terms that a task holds before it sends them, rows of a table that may be broadcast.
BLOCK, LOT, HELD, FEW = 256, 600_000, 1_000_000, 100_000


def placed(rows: DataFrame, own: Column) -> DataFrame:
    """manuscript_id, doc_id, start (words of the manuscript before), total (all of them), words, n (how many); written in the shared folder.

    Paragraphs without words are left out, as are those without a manuscript.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "part int, manuscript_id string, doc_id long, at long, words array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("words")), 0))
            places = []
            for manuscript, n in zip(batch.column("manuscript_id").to_pylist(), pc.list_value_length(batch.column("words")).to_pylist()):
                at = at if manuscript == last else 0
                last = manuscript
                places.append(at)
                at += n
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), batch.column("manuscript_id"), batch.column("doc_id"), pa.array(places, pa.int64()), batch.column("words")], ["part", "manuscript_id", "doc_id", "at", "words"])

    # texts are cut into words only after the exchange, in as many tasks as there are ranges, however few files there are
    ranged = rows.filter(F.col("manuscript_id").isNotNull()).repartitionByRange(parts, "manuscript_id", "doc_id").sortWithinPartitions("manuscript_id", "doc_id")
    ranged = ranged.select(F.col("manuscript_id").cast("string").alias("manuscript_id"), F.col("doc_id").cast("long").alias("doc_id"), own.alias("words"))
    ranged = saved(ranged.mapInArrow(run, schema))
    w = Window.partitionBy("manuscript_id")
    sums = ranged.groupBy("part", "manuscript_id").agg(F.sum(F.size("words")).alias("n"))
    sums = saved(sums.select("part", "manuscript_id", (F.sum("n").over(w.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(w).alias("total")))
    each = ranged.withColumn("n", F.size("words")).join(_few(sums), ["part", "manuscript_id"])  # words stay where they are if only n is asked for
    return each.select("manuscript_id", "doc_id", (F.col("before") + F.col("at")).alias("start"), "total", "words", "n")


def _few(table: DataFrame) -> DataFrame:
    """A written table that is broadcast if it has few rows, so that what it meets stays where it is."""
    return F.broadcast(table) if table.count() <= FEW else table


def blocks(words: DataFrame, size: int, step: int) -> DataFrame:
    """Pieces (manuscript_id, block, start, total, words: one string) of placed paragraphs: those of each block of ``BLOCK`` windows and what its windows reach."""
    span = BLOCK * step
    end = F.col("start") + F.size("words")
    first, last = F.greatest(F.lit(0), F.floor((F.col("start") - size) / span)), F.floor((end - 1) / span)
    each = words.withColumn("block", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    a, b = F.greatest("start", F.col("block") * span), F.least(end, (F.col("block") + 1) * span + size)
    piece = F.slice("words", (a - F.col("start") + 1).cast("int"), F.greatest(F.lit(0), b - a).cast("int"))
    return each.filter(b > a).select("manuscript_id", "block", a.alias("start"), "total", F.array_join(piece, " ").alias("words"))


def in_windows(words: DataFrame, size: int, step: int, keep_tail: bool) -> DataFrame:
    """(manuscript_id, doc_id, gpos, token, total, window): placed words with each window that holds them; a window starts at window * step.

    With ``keep_tail`` windows go on until one reaches the end; else a last part of a window is left out, but a
    manuscript shorter than a window is one.
    """
    tokens = words.select("manuscript_id", "doc_id", "start", "total", F.posexplode("words").alias("pos", "token")).withColumn("gpos", F.col("start") + F.col("pos"))
    last = F.greatest(F.lit(0), (F.ceil if keep_tail else F.floor)((F.col("total") - size) / step))
    first = F.greatest(F.lit(0), F.floor((F.col("gpos") - size) / step) + 1)
    own = tokens.withColumn("first", first.cast("long")).withColumn("final", F.least(last, F.floor(F.col("gpos") / step)).cast("long")).filter("first <= final")
    return own.select("manuscript_id", "doc_id", "gpos", "token", "total", F.explode(F.sequence("first", "final")).alias("window"))


def _dealt(pieces: DataFrame) -> DataFrame:
    return pieces.repartition("manuscript_id", "block").sortWithinPartitions("manuscript_id", "block", "start")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Table]]:
    """The pieces of each block, which lie together in the task's order."""
    held, key = [], None
    for batch in batches:
        names, numbers, at = batch.column("manuscript_id").to_pylist(), batch.column("block").to_pylist(), 0
        for k in range(1, batch.num_rows + 1):
            if k == batch.num_rows or (names[k], numbers[k]) != (names[at], numbers[at]):
                if held and key != (names[at], numbers[at]):
                    yield *key, pa.Table.from_batches(held)
                    held = []
                key = names[at], numbers[at]
                held.append(batch.slice(at, k - at))
                at = k
    if held:
        yield *key, pa.Table.from_batches(held)


def _words(table: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """A number for each word of the pieces in order, the words that the numbers stand for, and how many words each piece has."""
    pieces = pc.split_pattern(pa.concat_arrays(table.column("words").chunks), " ")
    flat = pieces.flatten().dictionary_encode()
    return flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), flat.dictionary, pc.list_value_length(pieces).to_numpy()


def _spread(ids: np.ndarray) -> tuple[int, float, int]:
    """How many, the sum of count * log2(count), how many different."""
    counts = np.unique(ids, return_counts=True)[1]
    return len(ids), float((counts * np.log2(counts)).sum()), len(counts)


def _entropies(rows: DataFrame, size: int, step: int) -> DataFrame:
    """Windows with their entropies of tokens and of bigrams, not rounded.

    Windows go on until one reaches the end of the manuscript; those of less than two tokens are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for manuscript, block, table in _grouped(batches):
            ids, known, _ = _words(table)
            total, base = table.column("total")[0].as_py(), block * BLOCK * step
            last = max(0, -(-(total - size) // step))
            out = []
            for window in range(block * BLOCK, min(last, block * BLOCK + BLOCK - 1) + 1):
                a, b = window * step, min(window * step + size, total)
                own = ids[a - base : b - base]
                if len(own) >= 2:
                    out.append((manuscript, window, a, b, *_spread(own), *_spread(own[:-1] * len(known) + own[1:])[:2]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["manuscript_id", "window", "start_token", "end_token", "n", "clogc", "vocabulary", "n2", "clogc2"])

    pieces = _dealt(blocks(placed(rows, tx.entropy_tokens(F.col("text"))), size, step))
    own = pieces.mapInArrow(run, "manuscript_id string, window long, start_token long, end_token long, n long, clogc double, vocabulary long, n2 long, clogc2 double")
    return own.select("manuscript_id", "window", "start_token", "end_token", tx.entropy(F.col("n"), F.col("clogc")).alias("entropy"), tx.entropy(F.col("n2"), F.col("clogc2")).alias("bigram_entropy"), (F.col("vocabulary") / F.col("n")).alias("type_token_ratio"))


def entropy_windows(rows: DataFrame, size: int = 500, step: int = 250) -> DataFrame:
    own = _entropies(rows, size, step)
    return own.withColumns({c: tx.rounded(F.col(c)) for c in ("entropy", "bigram_entropy", "type_token_ratio")})


def depressions(rows: DataFrame, size: int = 500, step: int = 250) -> DataFrame:
    """Windows whose entropy lies more than one population deviation below the manuscript's mean; rounded after that."""
    own = saved(_entropies(rows, size, step))
    sums = own.groupBy("manuscript_id").agg(F.avg("entropy").alias("mean"), F.stddev_pop("entropy").alias("deviation"))
    out = own.join(sums, "manuscript_id").filter("entropy < mean - deviation")
    return out.select("manuscript_id", "window", *[tx.rounded(F.col(c)).alias(c) for c in ("entropy", "mean", "deviation")])


SIZES = (1, 2, 3)
_KEY = ["manuscript_id", "n", "term"]


def _ahead(words: DataFrame, step: int) -> DataFrame:
    """For each block the first two content words after its own words, as a piece behind them all (``start`` null sorts first, so a flag tells it)."""
    span = BLOCK * step
    end = F.col("start") + F.size("words")
    each = words.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / span).cast("long"), F.floor((end - 1) / span).cast("long"))))
    a, b = F.greatest("start", F.col("block") * span), F.least(end, (F.col("block") + 1) * span)
    own = F.slice(tx.content(F.slice("words", (a - F.col("start") + 1).cast("int"), (b - a).cast("int"))), 1, 2)
    heads = each.select("manuscript_id", "block", "total", a.alias("start"), own.alias("head")).filter(F.size("head") > 0)
    heads = heads.groupBy("manuscript_id", "block").agg(F.first("total").alias("total"), F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "head"))), lambda x: x["head"])), 1, 2).alias("head"))
    w, none = Window.partitionBy("manuscript_id").orderBy("block"), F.array().cast("array<string>")
    after = F.slice(F.concat(F.coalesce(F.lead("head", 1).over(w), none), F.coalesce(F.lead("head", 2).over(w), none)), 1, 2)
    return heads.select("manuscript_id", "block", F.lit(-1).cast("long").alias("start"), "total", F.array_join(after, " ").alias("words")).filter("words <> ''")


def _packed(table: pa.Table) -> bytes:
    """Columns as one compressed value."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(values: pa.ChunkedArray) -> pa.Table:
    """The rows of packed tables, one after another."""
    tables = [pa.ipc.open_stream(v).read_all() for v in values.to_pylist()]
    return pa.concat_tables(tables).unify_dictionaries().combine_chunks()


def _hashes(known: pa.Array) -> np.ndarray:
    """A number for each word that is the same in every block."""
    return np.array([zlib.crc32(w.encode()) for w in known.to_pylist()], np.uint64)


class _Content:
    """A block's content words: their numbers (``own``) and places, where its own windows start, and how many content words these hold."""

    def __init__(self, block: int, table: pa.Table, size: int, step: int, width: int):
        ids, self.known, lengths = _words(table)
        self.ahead, self.base = (int(lengths[0]) if table.column("start")[0].as_py() < 0 else 0), block * width * step
        total = table.column("total")[0].as_py()
        self.last = max(0, (total - size) // step)
        counts_as = pc.and_(pc.greater_equal(pc.utf8_length(self.known), 3), pc.invert(pc.is_in(self.known, pa.array(STOPWORDS)))).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(counts_as[ids[self.ahead :]])
        self.own, self.places, self.next = ids[self.ahead :][at], at + self.base, ids[: self.ahead]
        self.home = int(np.searchsorted(self.places, self.base + width * step))
        self.start = np.arange(block * width, min(self.last, block * width + width - 1) + 1) * step
        self.inside = np.searchsorted(self.places, np.minimum(self.start + size, total)) - np.searchsorted(self.places, self.start)
        self.block, self.size, self.step, self.width = block, size, step, width

    def begun(self, n: int) -> int:
        """How many n-grams start in the block, wherever they end."""
        return max(0, min(self.home, self.home + min(self.ahead, n - 1) - n + 1))

    def held(self, n: int) -> np.ndarray:
        """n-grams of each window."""
        return np.maximum(0, self.inside - n + 1)

    def terms(self, n: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The block's n-grams, their hashes, how often each starts here, and counts in windows by term: bounds, windows from the block's first, counts."""
        line, begun, many = np.concatenate([self.own[: self.home], self.next[: n - 1]]), self.begun(n), len(self.known)
        code = lambda x, m: sum(x[k : k + m] * many ** (n - 1 - k) for k in range(n)) if m > 0 else np.zeros(0, np.int64)
        first, m = self.block * self.width, len(self.own) - n + 1
        low = np.maximum(first, -(-(self.places[n - 1 :] + 1 - self.size) // self.step)) if m > 0 else np.zeros(0, np.int64)
        high = np.minimum(self.start[-1] // self.step if len(self.start) else -1, self.places[: max(m, 0)] // self.step)
        spans = np.maximum(0, high - low + 1)
        terms, which = np.unique(np.concatenate([code(line, begun), code(self.own, m)]), return_inverse=True)
        window = np.repeat(low, spans) + np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
        pair, c = np.unique(np.repeat(which[begun:], spans) * self.width + window - first, return_counts=True)
        parts = [terms // many ** (n - 1 - j) % many for j in range(n)]
        names = pc.binary_join_element_wise(*[self.known.take(pa.array(x)) for x in parts], " ") if n > 1 else self.known.take(pa.array(parts[0]))
        hashes, known = np.full(len(terms), n, np.uint64), _hashes(self.known)
        for x in parts:
            hashes = (hashes ^ known[x]) * np.uint64(0x9E3779B97F4A7C15)
            hashes ^= hashes >> np.uint64(29)
        t = pair // self.width
        return names.cast(pa.string()), hashes, np.bincount(which[:begun], minlength=len(terms)), np.searchsorted(t, np.arange(len(terms) + 1)), pair % self.width, c


def _pieces(words: DataFrame, size: int, step: int) -> DataFrame:
    return blocks(words, size, step).unionByName(_ahead(words, step))


def _burst_stats(words: DataFrame, size: int, step: int) -> DataFrame:
    """For each manuscript and n: its n-grams, its windows, their n-grams in all, and how many windows (``m``) have each total (``totals``); written."""
    width = BLOCK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for manuscript, block, table in _grouped(batches):
            own = _Content(block, table, size, step, width)
            for n in SIZES:
                totals, m = np.unique(own.held(n), return_counts=True)
                k = max(1, len(totals))  # a block without windows has its n-grams all the same
                first = np.arange(k) == 0
                yield pa.RecordBatch.from_arrays([pa.array([manuscript] * k), pa.array([n] * k, pa.int32()), pa.array(first * own.begun(n)), pa.array([own.last + 1] * k, pa.int64()), pa.array(totals if len(totals) else [0], pa.int64()), pa.array(m if len(totals) else [0], pa.int64())], ["manuscript_id", "n", "grams", "windows", "total", "m"])

    each = _dealt(_pieces(words, size, step)).mapInArrow(run, "manuscript_id string, n int, grams long, windows long, total long, m long")
    each = each.groupBy("manuscript_id", "n", "total").agg(F.sum("grams").alias("grams"), F.max("windows").alias("windows"), F.sum("m").alias("m"))
    sums = each.groupBy("manuscript_id", "n").agg(F.sum("grams").alias("grams"), F.max("windows").alias("windows"), F.sum(F.col("total") * F.col("m")).alias("sum_totals"), F.sort_array(F.collect_list(F.struct("total", "m"))).alias("t"))
    return saved(sums.select("manuscript_id", "n", "grams", "windows", "sum_totals", F.col("t.total").alias("totals"), F.col("t.m").alias("m")))


def _lots(words: DataFrame) -> DataFrame:
    """(manuscript_id, grp, lots): manuscripts are dealt into groups by their names, and a group's terms into lots of about ``LOT`` words; written."""
    sizes = saved(words.groupBy("manuscript_id").agg(F.max("total").alias("total")))
    groups = max(1, -(-(sizes.agg(F.sum("total")).first()[0] or 0) // LOT))
    own = sizes.withColumn("grp", F.pmod(F.xxhash64("manuscript_id"), F.lit(groups)).cast("int"))
    return saved(own.select("manuscript_id", "grp", F.ceil(F.sum("total").over(Window.partitionBy("grp")) / LOT).cast("int").alias("lots")))


def _in_lots(rows: DataFrame, size: int, step: int, entries: bool) -> tuple[DataFrame, DataFrame]:
    """The placed words, and the groups of a lot (grp, lot), each the ``packed`` terms of blocks beside the statistics of their manuscripts.

    A packed row is a term in a block: how often it starts there (g), with ``entries`` its window counts with the windows' totals,
    else the sums of these counts and of their squares, and its number in the block (row).
    """
    width, held_most, kept = BLOCK, HELD, ["m", "n", "term", "g", "block", *(["offset", "count", "total"] if entries else ["row", "s", "ss"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[pa.Table] = []

        def sent() -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(own).unify_dictionaries().combine_chunks()
            own.clear()
            at = np.lexsort((table.column("lot").to_numpy(), table.column("grp").to_numpy()))
            table = table.take(pa.array(at))
            grp, lot = table.column("grp").to_numpy(), table.column("lot").to_numpy()
            cut = [0, *(np.flatnonzero((np.diff(grp) != 0) | (np.diff(lot) != 0)) + 1).tolist(), len(grp)]
            for a, b in zip(cut, cut[1:]):
                yield pa.RecordBatch.from_arrays([pa.array([grp[a]]), pa.array([lot[a]]), pa.array([_packed(table.select(kept).slice(a, b - a).combine_chunks())], pa.binary())], ["grp", "lot", "packed"])

        for manuscript, block, table in _grouped(batches):
            content = _Content(block, table, size, step, width)
            grp, lots = (table.column(c)[0].as_py() for c in ("grp", "lots"))
            for n in SIZES:
                names, hashes, g, bounds, k, c = content.terms(n)
                many, cut = len(names), pa.array(bounds, pa.int32())
                if not many:
                    continue
                columns = {
                    "grp": pa.array(np.full(many, grp, np.int32)), "lot": pa.array((hashes % np.uint64(lots)).astype(np.int32)), "m": pa.DictionaryArray.from_arrays(pa.array(np.zeros(many, np.int32)), pa.array([manuscript])),
                    "n": pa.array(np.full(many, n, np.int8)), "term": names, "g": pa.array(g.astype(np.int32)), "block": pa.array(np.full(many, block, np.int64)),
                }
                if entries:
                    columns |= {x: pa.ListArray.from_arrays(cut, pa.array(v, kind)) for x, v, kind in (("offset", k, pa.uint16()), ("count", c, pa.int32()), ("total", content.held(n)[k], pa.int32()))}
                else:
                    t = np.repeat(np.arange(many), np.diff(bounds))
                    columns |= {"row": pa.array(np.arange(many, dtype=np.int32)), "s": pa.array(np.bincount(t, c, many).astype(np.int64)), "ss": pa.array(np.bincount(t, c * c, many).astype(np.int64))}
                own.append(pa.table(columns))
            if sum(x.num_rows for x in own) >= held_most:
                yield from sent()
        if own:
            yield from sent()

    words = placed(rows, tx.burst_words(F.col("text")))
    lots = _few(_lots(words))
    stats = _burst_stats(words, size, step).join(lots, "manuscript_id").select("grp", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "manuscript_id", "n", "grams", "windows", "sum_totals", "totals", "m")
    sent = _dealt(_pieces(words, size, step).join(lots, "manuscript_id")).mapInArrow(run, "grp int, lot int, packed binary")
    return words, sent.groupBy("grp", "lot").cogroup(stats.groupBy("grp", "lot"))


class _Terms:
    """A lot's terms: rows in order of terms and blocks (``rows``), where each term's begin, its statistics by ``of`` (its manuscript's row for its n)."""

    def __init__(self, packed: pa.Table, stats: pa.Table):
        rows = _unpacked(packed.column("packed"))
        names = rows.column("term").combine_chunks().dictionary_encode()
        manuscripts = rows.column("m").combine_chunks()
        known = len(names.dictionary)
        term, which = np.unique(manuscripts.indices.to_numpy().astype(np.int64) * known + names.indices.to_numpy(), return_inverse=True)
        order = np.lexsort((rows.column("block").to_numpy(), which))
        self.rows, self.which = rows.drop_columns(["term", "m"]).take(pa.array(order)), which[order]
        self.count, self.names = len(term), names.dictionary.take(pa.array(term % known))
        self.manuscripts = manuscripts.dictionary.take(pa.array(term // known))
        self.first = np.searchsorted(self.which, np.arange(self.count))
        self.manuscript = (manuscripts.indices, manuscripts.dictionary, order)
        self.n = self.column("n")[self.first].astype(np.int32)
        place = {key: i for i, key in enumerate(zip(stats.column("manuscript_id").to_pylist(), stats.column("n").to_pylist()))}
        at = np.array([[place.get((m, n), -1) for n in (0, *SIZES)] for m in manuscripts.dictionary.to_pylist()])
        self.of = at[term // known, self.n]
        self.stats = {c: stats.column(c).to_numpy()[self.of] for c in ("grams", "windows", "sum_totals")}
        self.g = self.summed(self.column("g"))

    def column(self, name: str) -> np.ndarray:
        return self.rows.column(name).to_numpy()

    def summed(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.which, values, self.count).astype(np.int64)

    def rates(self, s: np.ndarray, ss: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each term's rate, and the sample deviation of its counts in all windows (0 if there is but one)."""
        windows = self.stats["windows"]
        with np.errstate(divide="ignore", invalid="ignore"):
            var = np.where(windows > 1, (ss - s * s / windows) / (windows - 1), 0.0)
        return self.g / self.stats["grams"], np.sqrt(np.floor(np.maximum(0.0, var) * 1e9 + 0.5) / 1e9)


def burst_terms(rows: DataFrame, size: int = 500, step: int = 100, threshold: float = 3.0) -> DataFrame:
    """The z-scores of all terms (1- to 3-grams of content words) over a manuscript's windows of ``size`` words.

    Windows run over all words, and a window's n-grams are those of the content words among them. A window's z-score is
    (count - rate * n-grams of that window) over the sample deviation of the counts in all windows; 0 if there is but one
    window or no deviation. Windows without a term count through sums, and the greatest z-score among them is that of the
    least total that more windows have than hold the term. A last part of a window is left out, but a manuscript
    shorter than a window is one. ``threshold`` must be above 0.
    """
    if threshold <= 0:
        raise ValueError("a burst's z-score is above 0")
    width = BLOCK
    schema = "manuscript_id string, term string, ngram_size long, global_count long, peak_count long, peak_window long, max_z double, mean_z double, burst_windows long"

    def settle(packed: pa.Table, stats: pa.Table) -> pa.Table:
        if not packed.num_rows:
            return pa.table({x.split()[0]: pa.array([], {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[x.split()[1]]) for x in schema.split(", ")})
        t = _Terms(packed, stats)
        lists = t.rows.column("count").combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy()
        count, total = lists.flatten().to_numpy().astype(np.int64), t.rows.column("total").combine_chunks().flatten().to_numpy()
        window = np.repeat(t.column("block"), sizes) * width + t.rows.column("offset").combine_chunks().flatten().to_numpy()
        of = np.repeat(t.which, sizes)
        bounds = np.searchsorted(of, np.arange(t.count + 1))
        some, held = np.flatnonzero(np.diff(bounds)), np.diff(bounds)
        s, ss = (np.bincount(of, x, t.count).astype(np.int64) for x in (count, count * count))
        peak, place = np.zeros(t.count, np.int64), np.zeros(t.count, np.int64)
        if len(some):
            peak[some] = np.maximum.reduceat(count, bounds[some])
            at = np.flatnonzero(count == peak[of])
            first = at[np.unique(of[at], return_index=True)[1]]
            place[some] = window[first]
        rate, deviation = t.rates(s, ss)
        flat = deviation <= 0
        windows = t.stats["windows"]
        with np.errstate(divide="ignore", invalid="ignore"):
            z = (count - rate[of] * total) / deviation[of]
            mean = (s / windows - rate * (t.stats["sum_totals"] / windows)) / deviation
        high = np.full(t.count, -np.inf)
        if len(some):
            high[some] = np.maximum.reduceat(z, bounds[some])
        totals, m = stats.column("totals").combine_chunks(), stats.column("m").combine_chunks()
        for i in np.flatnonzero(~flat & (high < 0) & (held < windows)):  # terms of more than one n-gram in a window's number, so few
            least = _least_absent(totals[int(t.of[i])].values.to_numpy(), m[int(t.of[i])].values.to_numpy(), total[bounds[i] : bounds[i + 1]], windows[i])
            if least is not None:
                high[i] = max(high[i], (0 - rate[i] * least) / deviation[i])
        over = np.bincount(of[(z >= threshold) & ~flat[of]], minlength=t.count)
        keep = pa.array(np.flatnonzero(t.g > 0))
        out = [t.manuscripts, t.names, t.n.astype(np.int64), t.g, peak, place, np.where(flat, 0.0, high), np.where(flat, 0.0, mean), over]
        return pa.table({x.split()[0]: (v if isinstance(v, pa.Array) else pa.array(v)).take(keep) for x, v in zip(schema.split(", "), out)})

    _, lots = _in_lots(rows, size, step, entries=True)
    return lots.applyInArrow(settle, schema).withColumns({c: tx.rounded(F.col(c)) for c in ("max_z", "mean_z")})


def _least_absent(totals: np.ndarray, m: np.ndarray, own: np.ndarray, windows: int) -> int | None:
    """The least total among the windows without a term: the first that more windows have (``m``) than hold the term (``own``, their totals)."""
    if windows > m.sum():
        return 0  # windows of a block without words
    free = np.flatnonzero(m > np.bincount(np.searchsorted(totals, own), minlength=len(m)))
    return int(totals[free[0]]) if len(free) else None


def _bursts(rows: DataFrame, size: int, step: int, threshold: float, k: int) -> tuple[DataFrame, DataFrame]:
    """The placed words, and each window's first k bursts (manuscript_id, window, term, n, z, rank) with the number of all of them (bursts).

    A lot sends only rates and deviations back to the blocks of its terms; a block counts its words again and has all bursts of
    its windows, of which the first k leave it.
    """
    width = BLOCK

    def rate(packed: pa.Table, stats: pa.Table) -> pa.Table:
        out = []
        if packed.num_rows:
            t = _Terms(packed, stats)
            rates, deviations = t.rates(*(t.summed(t.column(c)) for c in ("s", "ss")))
            indices, names, order = t.manuscript
            table = pa.table({"m": pa.array(indices.to_numpy()[order]), "block": t.rows.column("block"), "n": t.rows.column("n"), "row": t.rows.column("row"), "rate": rates[t.which], "deviation": deviations[t.which]})
            table = table.filter(pc.greater(table.column("deviation"), 0.0)).sort_by([(c, "ascending") for c in ("m", "block", "n", "row")])
            m, block = table.column("m").to_numpy(), table.column("block").to_numpy()
            cut = [0, *(np.flatnonzero((np.diff(m) != 0) | (np.diff(block) != 0)) + 1).tolist(), len(m)] if len(m) else []
            out = [(names[int(m[a])].as_py(), int(block[a]), _packed(table.select(["n", "row", "rate", "deviation"]).slice(a, b - a).combine_chunks())) for a, b in zip(cut, cut[1:])]
        columns = list(zip(*out)) or [[], [], []]
        return pa.table({"manuscript_id": pa.array(columns[0], pa.string()), "block": pa.array(columns[1], pa.int64()), "packed": pa.array(columns[2], pa.binary())})

    def best(pieces: pa.Table, rates: pa.Table) -> pa.Table:
        parts = []
        if pieces.num_rows and rates.num_rows:
            content, known = _Content(pieces.column("block")[0].as_py(), pieces.sort_by("start"), size, step, width), _unpacked(rates.column("packed"))
            sizes = known.column("n").to_numpy()
            for n in SIZES:
                names, _, _, bounds, at, c = content.terms(n)
                r, d = np.zeros(len(names)), np.zeros(len(names))
                own = known.filter(pa.array(sizes == n))
                r[own.column("row").to_numpy()], d[own.column("row").to_numpy()] = own.column("rate").to_numpy(), own.column("deviation").to_numpy()
                term = np.repeat(np.arange(len(names)), np.diff(bounds))
                with np.errstate(divide="ignore", invalid="ignore"):
                    z = (c - r[term] * content.held(n)[at]) / d[term]
                hit = (d[term] > 0) & (z >= threshold)
                parts.append((names, term[hit], at[hit], z[hit], np.full(hit.sum(), n, np.int32)))
        if not sum(len(p[3]) for p in parts):
            return pa.table({"manuscript_id": pa.array([], pa.string()), "window": pa.array([], pa.int64()), "term": pa.array([], pa.string()), "n": pa.array([], pa.int32()), "z": pa.array([], pa.float64()), "rank": pa.array([], pa.int32()), "bursts": pa.array([], pa.int64())})
        names = pa.concat_arrays([p[0] for p in parts])
        before = np.cumsum([0, *[len(p[0]) for p in parts]])
        term, window, z, n = np.concatenate([p[1] + b for p, b in zip(parts, before)]), *(np.concatenate([p[i] for p in parts]) for i in (2, 3, 4))
        place = np.empty(len(names), np.int64)
        place[pc.array_sort_indices(names).to_numpy()] = np.arange(len(names))
        order = np.lexsort((n, place[term], -np.floor(z * 1e4 + 0.5), window))
        first = np.searchsorted(window[order], np.arange(width))
        rank = np.arange(len(order)) - first[window[order]] + 1
        order, rank = order[rank <= k], rank[rank <= k].astype(np.int32)
        bursts = np.bincount(window, minlength=width)[window[order]]
        return pa.table({
            "manuscript_id": pa.array([pieces.column("manuscript_id")[0].as_py()] * len(order), pa.string()), "window": pa.array(window[order] + content.block * width), "term": names.take(pa.array(term[order])), "n": pa.array(n[order]),
            "z": pa.array(z[order]), "rank": pa.array(rank), "bursts": pa.array(bursts),
        })

    words, lots = _in_lots(rows, size, step, entries=False)
    rates = lots.applyInArrow(rate, "manuscript_id string, block long, packed binary")
    found = _pieces(words, size, step).groupBy("manuscript_id", "block").cogroup(rates.groupBy("manuscript_id", "block"))
    return words, found.applyInArrow(best, "manuscript_id string, window long, term string, n int, z double, rank int, bursts long")


def _places(words: DataFrame, size: int, step: int) -> DataFrame:
    """Each window's place: the paragraph of its middle word, and its words in that paragraph; progress there in percent."""
    end = F.col("start") + F.size("words")
    last = F.greatest(F.lit(0), F.floor((F.col("total") - size) / step)).cast("long")
    reach = F.least(F.lit(size), "total")
    half = F.floor(reach / 2).cast("long")
    first = F.greatest(F.lit(0), F.ceil((F.col("start") - half) / step)).cast("long")
    final = F.least(last, F.floor((end - 1 - half) / step)).cast("long")
    each = words.select("manuscript_id", "doc_id", "start", end.alias("end"), "total", first.alias("a"), final.alias("b"), reach.cast("long").alias("reach"))
    each = each.filter("a <= b").withColumn("window", F.explode(F.sequence("a", "b"))).withColumn("from", F.col("window") * step)
    return each.select(
        "manuscript_id", "window", F.col("doc_id").alias("paragraph"), F.greatest("from", "start").alias("first_token"), (F.least(F.col("from") + F.col("reach"), F.col("end")) - 1).alias("last_token"),
        F.round((F.col("from") + F.col("reach") / 2) / F.col("total") * 100, 6).alias("progress"),
    )


def burst_regions(rows: DataFrame, size: int = 500, step: int = 100, threshold: float = 3.0, k: int = 5) -> DataFrame:
    """Bursts grouped by where their windows stand: how many, mean progress in percent, the highest z-score, and the first k.

    A window stands at the paragraph of its middle word, with its words in that paragraph; windows of one such place are one
    group. A window's progress is that of its middle.
    """
    words, found = _bursts(rows, size, step, threshold, k)
    place = ["manuscript_id", "paragraph", "first_token", "last_token"]
    own = saved(found.withColumn("z", F.round("z", 4)).join(_places(words, size, step), ["manuscript_id", "window"]))
    each = own.filter("rank = 1").select(*place, "bursts", "z", (F.round(F.col("progress") * 1e6).cast("long") * F.col("bursts")).alias("progress"))
    sums = each.groupBy(*place).agg(F.sum("bursts").alias("bursts"), F.max("z").alias("max_z"), F.round(F.sum("progress") / (1e6 * F.sum("bursts")), 2).alias("mean_progress"))
    # only the first k of a place leave each task: the limit of a rank is taken before the exchange too
    ranked = own.withColumn("rank", F.row_number().over(Window.partitionBy(*place).orderBy(F.desc("z"), "term", "n", "window"))).filter(F.col("rank") <= k)
    named = F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat("term", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("name")))), lambda x: x["name"])
    best = ranked.groupBy(*place).agg(F.array_join(named, ", ").alias("top_terms"))
    return sums.join(best, place)
