"""Where things stand: words in paragraphs, lines, blank-line paragraphs, tails, ranks, windows and chunks as ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions import text as tx


def ranked_words(frequency: DataFrame, k: int = 100) -> DataFrame:
    """The k most frequent words (word, count) by rank; only k rows are numbered."""
    top = frequency.orderBy(F.desc("count"), "word").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), "word")).cast("long"))


def without(words: DataFrame, exceptions: DataFrame) -> DataFrame:
    return words.join(exceptions.select("word"), "word", "left_anti")


def word_paragraphs(rows: DataFrame, words: DataFrame, k: int = 3) -> DataFrame:
    """The first k paragraphs that hold each word (word), with how often it stands there."""
    each = rows.select("doc_id", F.explode(tx.apostrophe_tokens(F.col("text"))).alias("word")).join(words.select("word"), "word").groupBy("word", "doc_id").agg(F.count("*").alias("count"))
    w = Window.partitionBy("word").orderBy("doc_id")
    return each.withColumn("n", F.row_number().over(w).cast("long")).filter(F.col("n") <= k)


def blank_line_paragraphs(rows: DataFrame) -> DataFrame:
    """Runs of lines that aren't blank once cleaned: number, first line, lines, and the hash of their text."""
    lines = rows.select("doc_id", F.posexplode(F.transform(F.split(tx.strip_fences(F.col("text")), "\n"), tx.clean_line)).alias("line", "value"))
    w = Window.partitionBy("doc_id").orderBy("line")
    lines = lines.withColumn("gap", F.sum((F.col("value") == "").cast("long")).over(w)).filter("value <> ''")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "value"))), lambda x: x["value"]), "\n")
    runs = lines.groupBy("doc_id", "gap").agg(F.min("line").cast("long").alias("first_line"), F.count("*").alias("lines"), F.sha2(body, 256).alias("content_hash"))
    return runs.withColumn("paragraph", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_line")).cast("long")).drop("gap")


def line_of(rows: DataFrame, positions: DataFrame) -> DataFrame:
    """The line (from 0) of each position (doc_id, position): the last one that starts at or before it, found by one sort of both."""
    starts = rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "value"))
    w = Window.partitionBy("doc_id").orderBy("line")
    starts = starts.select("doc_id", F.coalesce(F.sum(F.char_length("value") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"), F.col("line").cast("long").alias("line"))
    both = starts.unionByName(positions.select("doc_id", F.col("position").alias("at"), F.lit(None).cast("long").alias("line")))
    last = F.last("line", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("at", F.col("line").isNull()))
    return both.withColumn("found", last).filter("line is null").select("doc_id", F.col("at").alias("position"), F.col("found").alias("line")).filter("line is not null").distinct()


def tails(rows: DataFrame, scores: DataFrame, k: int = 2) -> DataFrame:
    """The last k paragraphs of each manuscript with their scores (doc_id, score) and the score before."""
    w = Window.partitionBy("manuscript_id").orderBy(F.desc("doc_id"))
    own = rows.select("manuscript_id", "doc_id").withColumn("from_end", F.row_number().over(w).cast("long")).filter(F.col("from_end") <= k)
    own = own.join(scores.select("doc_id", "score"), "doc_id")
    return own.withColumn("before", F.lag("score").over(Window.partitionBy("manuscript_id").orderBy("doc_id")))


def endings(rows: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """For each manuscript, of scores (doc_id, score, sentiment): whether its end cuts hard or turns moral.

    hard_cut: the last paragraph reaches the threshold and the one before doesn't. drift: the last is positive (0.3 or
    more) after a body whose mean, weighted by ``weight``, is negative (-0.5 or less). One paragraph has neither.
    """
    own = rows.select("manuscript_id", "doc_id").join(scores, "doc_id")
    w = Window.partitionBy("manuscript_id").orderBy(F.desc("doc_id"))
    own = own.withColumn("n", F.row_number().over(w))
    at = lambda k, c: F.max(F.when(F.col("n") == k, F.col(c)))
    body = F.sum(F.when(F.col("n") > 1, F.col("sentiment") * F.col("weight"))) / F.sum(F.when(F.col("n") > 1, F.col("weight")))
    out = own.groupBy("manuscript_id").agg(at(1, "score").alias("final"), at(2, "score").alias("previous"), at(1, "sentiment").alias("final_sentiment"), F.round(body, 6).alias("body_sentiment"))
    cut = (F.col("final") >= threshold) & (F.col("previous") < threshold)
    drift = (F.col("body_sentiment") <= -0.5) & (F.col("final_sentiment") >= 0.3)
    return out.select("manuscript_id", "final", "previous", "body_sentiment", "final_sentiment", F.coalesce(cut, F.lit(False)).alias("hard_cut"), F.coalesce(drift, F.lit(False)).alias("drift"))


def whole_word_counts(rows: DataFrame, words: list[str]) -> DataFrame:
    """How often each of the words stands as a whole word, in any case; letters, digits and _ of any script make words."""
    count = lambda w: F.regexp_count("text", F.lit(rf"(?i)(?<![\p{{L}}\p{{N}}_]){w}(?![\p{{L}}\p{{N}}_])")).cast("long")
    return rows.select("doc_id", *[count(w).alias(f"n_{w}") for w in words])


def chunk_ranges(sizes: DataFrame) -> DataFrame:
    """First and last running token of each chunk (group_id, chunk, n)."""
    w = Window.partitionBy("group_id").orderBy("chunk")
    end = F.sum("n").over(w)
    return sizes.select("group_id", "chunk", (end - F.col("n")).alias("first_token"), (end - 1).alias("last_token"))


def missing_ids(found: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Referenced ids that the index lacks, and how often."""
    return found.join(known.select(key), key, "left_anti").groupBy(key).agg(F.count("*").alias("count"))


def window_anchor(words: DataFrame, size: int, step: int) -> DataFrame:
    """(manuscript_id, window, anchor, tokens, first_token, last_token): the paragraph of each window's middle token, and the window's tokens in it.

    Of words placed in their manuscripts (windows.placed); windows go on until one reaches the end. A paragraph knows its own
    windows by its place, so no token travels.
    """
    own = words.groupBy("manuscript_id", "doc_id", "total").agg(F.min("start").alias("start"), F.sum("n").alias("n")).filter("doc_id IS NOT NULL")
    end, whole = F.col("start") + F.col("n"), lambda x: x.cast("long")
    first, final = F.greatest(F.lit(0), F.floor((F.col("start") - size) / step)), F.least(F.greatest(F.lit(0), F.ceil((F.col("total") - size) / step)), F.floor((end - 1) / step))
    each = own.withColumn("end", end).filter(first <= final).withColumn("window", F.explode(F.sequence(whole(first), whole(final))))
    a = F.col("window") * step
    b = F.least(a + size, F.col("total"))
    middle = F.floor((a + b) / 2)
    each = each.filter((middle >= F.col("start")) & (middle < F.col("end")))
    low, high = F.greatest(a, "start"), F.least(b, "end")
    return each.select("manuscript_id", "window", F.col("doc_id").alias("anchor"), whole(high - low).alias("tokens"), whole(low).alias("first_token"), whole(high - 1).alias("last_token"))


def unapplied(migrations: DataFrame, ledger: DataFrame) -> DataFrame:
    """Migrations (version) that the ledger lacks, in order."""
    return migrations.join(ledger.select("version"), "version", "left_anti").orderBy("version")
