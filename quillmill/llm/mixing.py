"""Mixing sources to target weights by temperature, realised as budgeted block permutations.

A source's weight is its share of the tokens to the power of an exponent, normalised. The exponent lies between 0 (all
sources alike) and 1 (natural shares); it is found by bisection, many sections at a time, each round one small aggregate
over the sources. It is the largest exponent that reaches the target entropy (bits), or the smallest that
keeps the repetition of every source within a limit. A source's budget is its weight times the budget of the mixture. It is filled by whole passes
over the source and a part of one more, each pass in an order of its own given by a keyed digest; a document enters a pass only
if it fits into the budget whole. Positions in a source's stream are exact prefix sums in two steps, over buckets of the key
and within one; the number of buckets follows that of the rows, so that a window holds some hundred rows at any size. Block k of the mixture takes the k-th equal part of every source's
stream, in an order given by the key.

Without a budget, the mixture is the smallest that shows every document at least once.

Only built-in functions are used. A document's tokens are its words and one end. Null and empty texts have the end alone. A null source counts as a
source named ''. Rows with one doc_id share a key, and enter a partial pass together or not at all; a null doc_id counts as ''. An
empty table gives an empty result. Columns besides ``doc_id``, ``text`` and ``source`` are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.llm import work

SECTIONS, ROUNDS, BLOCK_TOKENS, BUCKET_ROWS, PASSES = 16, 12, 1_000_000, 512, 1_024


def tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1


def _source() -> Column:
    return F.coalesce("source", F.lit(""))


def _key(turn: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), turn.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _bucket(rows: DataFrame) -> Column:
    """The beginning of ``key``: as many hex digits as give buckets of about ``BUCKET_ROWS`` rows, were all of one source."""
    digits = max(3, math.ceil(math.log(max(1, rows.count()) / BUCKET_ROWS, 16)))
    return F.substring("key", 1, digits)


def _numbered(rows: DataFrame, last: Column, name: str) -> DataFrame:
    """Each row once for each number from 0 to ``last``, in two steps, so that no array holds all numbers."""
    step = F.lit(PASSES).cast("long")
    rows = rows.withColumn("_last", last.cast("long")).withColumn("_of", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_last") / step))))
    rows = rows.withColumn(name, F.explode(F.sequence(F.col("_of") * step, F.least(F.col("_last"), F.col("_of") * step + step - 1))))
    return rows.drop("_last", "_of")


def exponent(sources: DataFrame, entropy: float | None = None, repeat: float | None = None, budget: float | None = None) -> float:
    """The exponent for sources (source, total); ``repeat`` limits how often any source is shown, on average.

    Where the goal can't be met, it is the nearest end of [0, 1]; without a goal it is 1.
    """
    if entropy is None and repeat is None:
        return 1.0
    whole = sources.agg(F.sum("total").alias("all"), F.max("total").alias("most"), F.min("total").alias("least")).first()
    if not whole["all"]:
        return 1.0
    low, high = 0.0, 1.0  # the goal is met at low for an entropy, at high for a limit
    for _ in range(ROUNDS):
        grid = [low + (high - low) * k / SECTIONS for k in range(SECTIONS + 1)]
        one = sources.withColumn("a", F.explode(F.array(*map(F.lit, grid))))
        share = F.col("total") / F.lit(whole["all"])
        z = F.sum(F.pow(share, F.col("a")))
        h = F.log2(z) - F.first("a") * F.sum(F.pow(share, F.col("a")) * F.log2(share)) / z
        epochs = F.lit(float(budget or 0)) / F.lit(whole["all"]) * F.max(F.pow(share, F.col("a") - 1)) / z
        if budget is None:
            epochs = F.pow(F.lit(whole["most"] / whole["least"]), 1 - F.first("a"))
        goal = h >= entropy if entropy is not None else epochs <= repeat
        met = {r["a"]: r["goal"] for r in one.groupBy("a").agg(goal.alias("goal")).collect()}  # SECTIONS + 1 rows
        fit = [a for a in grid if met[a]]
        if entropy is not None:
            low = max(fit, default=0.0)
            high = min((a for a in grid if a > low), default=low)
        else:
            high = min(fit, default=1.0)
            low = max((a for a in grid if a < high), default=high)
        if low == high:
            break
    return low if entropy is not None else high


def plan(docs: DataFrame, entropy: float | None = None, repeat: float | None = None, budget: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """Two tables: rows (row, doc_id, source, tokens), and sources (source, total, weight, epochs, goal tokens, passes)."""
    rows = work.put(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), _source().alias("source"), tokens(F.col("text")).alias("tokens")), "rows")
    sources = work.put(rows.groupBy("source").agg(F.sum("tokens").alias("total")), "sources")
    a = exponent(sources, entropy, repeat, budget)
    power = lambda e: F.pow(F.col("total").cast("double"), F.lit(e))
    sums = sources.agg(F.sum(power(a)).alias("z"), F.max(power(1 - a)).alias("most")).first()
    out = sources.withColumn("weight", power(a) / F.lit(sums["z"]))
    epochs = F.lit(float(budget)) * F.col("weight") / F.col("total") if budget is not None else F.lit(sums["most"]) / power(1 - a)
    whole = F.floor if budget is not None else F.round  # a given budget is never exceeded
    out = out.select("source", "total", "weight", epochs.alias("epochs"), whole(epochs * F.col("total")).cast("long").alias("goal"))
    return rows, work.put(out.withColumn("passes", F.floor(F.col("goal") / F.col("total"))), "goals")


def mixture(docs: DataFrame, entropy: float | None = None, repeat: float | None = None, budget: int | None = None, seed: int = 7, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row for each showing of a document: doc_id, source, pass, block, stream_start (tokens of its source before it), tokens, order_key.

    The mixture's order is (block, order_key).
    """
    rows, sources = plan(docs, entropy, repeat, budget, seed)
    blocks = max(1, -(-(sources.agg(F.sum("goal")).first()[0] or 0) // block_tokens))
    shown = _numbered(rows.join(sources, "source"), F.col("passes"), "pass")
    shown = shown.withColumn("key", _key(F.col("pass"), seed)).withColumn("bucket", _bucket(rows))
    sums = work.put(shown.groupBy("source", "pass", "bucket").agg(F.sum("tokens").alias("sum")), "sums")
    before = F.sum("sum").over(Window.partitionBy("source", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("source", "pass", "bucket", F.coalesce(before, F.lit(0)).alias("earlier"))
    within = Window.partitionBy("source", "pass", "bucket")
    peers = F.sum("tokens").over(within.orderBy("key"))  # with all rows of the same key
    own = F.sum("tokens").over(within.orderBy("key", "row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens")
    at = F.col("pass") * F.col("total") + F.col("earlier")
    shown = shown.join(sums, ["source", "pass", "bucket"]).select("doc_id", "source", "pass", "tokens", "key", "goal", (at + own).alias("stream_start"), (at + peers).alias("end"))
    block = F.floor(F.col("stream_start") / F.col("goal") * F.lit(blocks))
    return shown.filter("end <= goal").select("doc_id", "source", "pass", block.alias("block"), "stream_start", "tokens", F.col("key").alias("order_key"))


def realise(docs: DataFrame, entropy: float | None = None, repeat: float | None = None, budget: int | None = None, seed: int = 7) -> DataFrame:
    """The rows of ``docs``, with their columns unchanged, as often as the mixture shows them.

    A partial pass is a beginning of its order, so one last key for each source decides it, and texts stay where they are read.
    """
    since = work.mark()
    rows, sources = plan(docs, entropy, repeat, budget, seed)
    last = rows.join(sources, "source").filter("goal > passes * total").withColumn("key", _key(F.col("passes"), seed))
    last = last.withColumn("bucket", _bucket(rows))
    sums = work.put(last.groupBy("source", "bucket").agg(F.sum("tokens").alias("sum")), "sums")
    before = F.sum("sum").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("earlier"))
    end = F.col("earlier") + F.sum("tokens").over(Window.partitionBy("source", "bucket").orderBy("key"))
    fits = last.join(sums, ["source", "bucket"]).withColumn("end", end).filter("end <= goal - passes * total")
    cut = work.put(sources.join(fits.groupBy("source").agg(F.max("key").alias("last")), "source", "left").select("source", "passes", "last"), "cut")
    work.sweep(since, cut)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), "doc_id", _source().alias("source"))
    times = F.col("passes") + F.coalesce((_key(F.col("passes"), seed) <= F.col("last")).cast("long"), F.lit(0))
    return _numbered(own.join(cut, "source").withColumn("times", times).filter("times > 0"), F.col("times") - 1, "n").select("d.*")
