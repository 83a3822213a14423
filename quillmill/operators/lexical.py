"""Corpus metrics over paragraphs (manuscript_id, doc_id, text): entropy, density, surprisal, themes, patterns, bursts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions import lexicons as lx
from quillmill.functions import text as tx
from quillmill.operators.checkpoints import saved


def paragraphs(documents: DataFrame) -> DataFrame:
    """A document is a paragraph of the manuscript that is its source."""
    return documents.select(F.col("source").alias("manuscript_id"), "doc_id", "text")


def exploded(rows: DataFrame, own: Column) -> DataFrame:
    """(manuscript_id, doc_id, pos, token) of an array of each row."""
    return rows.select("manuscript_id", "doc_id", F.posexplode(own).alias("pos", "token"))


def counted(rows: DataFrame, own: Column) -> DataFrame:
    """(manuscript_id, doc_id, token, c): how often each paragraph has each value of an array of its row.

    A row's values are counted in its sorted array, without an exchange. Only paragraphs that come as several rows are added up by one.
    """
    several = saved(rows.groupBy("manuscript_id", "doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col("manuscript_id").alias("m"), F.col("doc_id").alias("d")))
    with_array = rows.select("manuscript_id", "doc_id", F.sort_array(own).alias("own"))
    if several.isEmpty():
        return _runs(with_array)
    again = F.col("manuscript_id").eqNullSafe(F.col("m")) & F.col("doc_id").eqNullSafe(F.col("d"))
    rest = exploded(rows.join(several, again, "left_semi"), own).groupBy("manuscript_id", "doc_id", "token").agg(F.count("*").alias("c"))
    return _runs(with_array.join(several, again, "left_anti")).unionByName(rest)


def _runs(rows: DataFrame) -> DataFrame:
    """Of rows with a sorted array ``own``: a row for each run of equal values."""
    first = F.filter(F.sequence(F.lit(0), F.size("own") - 1), lambda i: (i == 0) | (F.get("own", i) != F.get("own", i - 1)))
    some = F.size("own") > 0
    at = rows.select("manuscript_id", "doc_id", "own", F.when(some, first).alias("at"))
    each = F.zip_with("at", F.concat(F.slice("at", F.lit(2), F.size("at")), F.array(F.size("own"))), lambda a, b: F.struct(F.get("own", a).alias("token"), (b - a).cast("long").alias("c")))
    return at.select("manuscript_id", "doc_id", F.inline(F.when(some, each)))


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of each manuscript, numbered by ``rank``."""
    w = Window.partitionBy("manuscript_id").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def paragraph_entropy(rows: DataFrame) -> DataFrame:
    r = tx.runs(F.col("own"))
    out = rows.select("manuscript_id", "doc_id", tx.tokens(F.col("text")).alias("own")).select("manuscript_id", "doc_id", r.alias("r"))
    e = tx.rounded(tx.entropy(F.col("r.n"), F.col("r.clogc")))
    most = F.log2(F.col("r.vocabulary").cast("double"))
    return out.select("manuscript_id", "doc_id", F.col("r.n").alias("token_count"), e.alias("entropy"), F.round(F.when(F.col("r.vocabulary") > 1, e / most).otherwise(0.0), 4).alias("normalized_entropy"))


def document_entropy(rows: DataFrame) -> DataFrame:
    counts = exploded(rows, tx.letter_tokens(F.col("text"))).groupBy("manuscript_id", "token").count()
    c = F.col("count").cast("double")
    sums = counts.groupBy("manuscript_id").agg(F.sum("count").alias("token_count"), F.sum(c * F.log2(c)).alias("clogc"), F.count("*").alias("vocabulary"))
    return sums.select("manuscript_id", "token_count", "vocabulary", tx.rounded(tx.entropy(F.col("token_count"), F.col("clogc"))).alias("document_entropy"))


def signal_density(rows: DataFrame) -> DataFrame:
    own = tx.tokens(F.col("text"))
    out = rows.select("manuscript_id", "doc_id", own.alias("own")).select("manuscript_id", "doc_id", F.size("own").cast("long").alias("token_count"), F.size(tx.content(F.col("own"))).alias("n"))
    return out.select("manuscript_id", "doc_id", "token_count", F.round(F.when(F.col("token_count") > 0, F.col("n") / F.col("token_count")).otherwise(0.0), 4).alias("lexical_density"))


def low_density(rows: DataFrame, k: int = 12) -> DataFrame:
    own = signal_density(rows).filter((F.col("token_count") >= lx.LEAST_TOKENS) & (F.col("lexical_density") < lx.LOW_DENSITY))
    return top(own, k, F.asc("lexical_density"), F.asc("doc_id"))


def surprisal(rows: DataFrame) -> DataFrame:
    """Unigram surprisal of each paragraph under its manuscript's own frequencies."""
    counts = exploded(rows, tx.letter_tokens(F.col("text"))).groupBy("manuscript_id", "token").agg(F.count("*").alias("all"))
    totals = counts.groupBy("manuscript_id").agg(F.sum("all").alias("total"))
    own = counted(rows, tx.tokens(F.col("text")))
    told = own.join(counts, ["manuscript_id", "token"]).join(totals, "manuscript_id")
    p = F.greatest(F.col("all") / F.col("total"), 1 / F.col("total"))
    sums = told.groupBy("doc_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * -F.log2(p)).alias("bits"))
    n, raw = F.coalesce("n", F.lit(0)), F.coalesce(F.col("bits") / F.col("n"), F.lit(0.0))
    return rows.select("manuscript_id", "doc_id").join(sums, "doc_id", "left").select(
        "manuscript_id", "doc_id", n.alias("token_count"), F.round(raw, 4).alias("surprisal"), F.round(raw * F.sqrt(n / (n + 12)), 4).alias("adjusted_surprisal")
    )


def surprisal_top(rows: DataFrame, k: int = 12) -> DataFrame:
    own = surprisal(rows).filter(F.col("token_count") >= lx.LEAST_TOKENS)
    return top(own, k, F.desc("adjusted_surprisal"), F.asc("doc_id"))


def _paragraph_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("manuscript_id").agg(F.count("*").alias("paragraphs"))


def theme_tokens(rows: DataFrame) -> DataFrame:
    own = F.filter(tx.content(tx.tokens(F.col("text"))), lambda t: (F.length(t) >= 4) & ~t.isin(lx.THEME_BLOCKLIST))
    in_doc = counted(rows, own)
    sums = in_doc.groupBy("manuscript_id", "token").agg(F.sum("c").alias("count"), F.count("*").alias("spread"))
    fit = (F.col("spread") >= 3) & (F.col("spread") <= F.floor(F.col("paragraphs") * lx.WIDE_SHARE))
    score = F.col("count") * F.log1p(F.col("paragraphs") / F.col("spread"))
    return sums.join(_paragraph_counts(rows), "manuscript_id").filter(fit).select("manuscript_id", F.col("token").alias("theme"), "count", "spread", F.lit("token").alias("type"), F.round(score, 4).alias("score"))


def _grams(rows: DataFrame, own: Column, sizes: tuple[int, ...]) -> DataFrame:
    """(manuscript_id, doc_id, n, pos, gram) with gram an array."""
    base = rows.select("manuscript_id", "doc_id", own.alias("own"))
    parts = [base.select("manuscript_id", "doc_id", F.lit(n).alias("n"), F.posexplode(tx.ngrams(F.col("own"), n)).alias("pos", "gram")) for n in sizes]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def theme_phrases(rows: DataFrame) -> DataFrame:
    base = rows.select("manuscript_id", "doc_id", tx.content(tx.tokens(F.col("text"))).alias("own"))
    grams = F.filter(F.concat(tx.ngrams(F.col("own"), 2), tx.ngrams(F.col("own"), 3)), lambda g: ~F.exists(g, lambda t: t.isin(lx.THEME_BLOCKLIST)))
    in_doc = counted(base, F.transform(grams, lambda g: F.array_join(g, " "))).withColumnRenamed("token", "theme")
    sums = in_doc.groupBy("manuscript_id", "theme").agg(F.sum("c").alias("count"), F.count("*").alias("spread")).filter("count >= 2 and spread >= 2")
    score = F.col("count") * F.log1p(F.col("paragraphs") / F.col("spread")) * 1.35
    return sums.join(_paragraph_counts(rows), "manuscript_id").select("manuscript_id", "theme", "count", "spread", F.lit("phrase").alias("type"), F.round(score, 4).alias("score"))


def themes(rows: DataFrame, k: int = 20) -> DataFrame:
    return top(theme_tokens(rows).unionByName(theme_phrases(rows)), k, F.desc("score"), F.asc("type"), F.asc("theme"))


def repeated_patterns(rows: DataFrame, n: int, k: int = 20) -> DataFrame:
    """The k most frequent n-grams of each manuscript, of these such as occur twice; ties go to the earlier.

    First only hashes are counted, as whole numbers. The n-grams of the most frequent ones, with all that tie, are then counted as
    such with their first places; twice as many hashes as n-grams are asked for are kept, so two that share a hash push none out.
    """
    long_ = F.exists("gram", lambda t: F.length(t) >= 4)
    some = F.exists("gram", lambda t: ~t.isin(lx.STOPWORDS))
    grams = _grams(rows, tx.tokens(F.col("text")), (n,)).filter(long_ & some).withColumn("h", F.xxhash64("gram"))
    often = grams.groupBy("manuscript_id", "h").agg(F.count("*").alias("c")).filter("c >= 2")
    often = often.withColumn("place", F.rank().over(Window.partitionBy("manuscript_id").orderBy(F.desc("c")))).filter(F.col("place") <= 2 * k)
    often = saved(often.select(F.col("manuscript_id").alias("m"), F.col("h").alias("of")))
    grams = grams.join(often, F.col("manuscript_id").eqNullSafe(F.col("m")) & (F.col("h") == F.col("of")), "left_semi")
    sums = grams.groupBy("manuscript_id", F.array_join("gram", " ").alias("pattern")).agg(F.count("*").alias("count"), F.min(F.struct("doc_id", "pos")).alias("at"))
    return top(sums, k, F.desc("count"), F.asc("at")).filter("count >= 2").select("manuscript_id", "pattern", "count", "rank")


def bursts(rows: DataFrame, k: int = 25) -> DataFrame:
    """Tokens that crowd in one paragraph; the paragraphs without them count through sums, not through a grid."""
    in_doc = counted(rows, tx.content(tx.tokens(F.col("text"))))
    sums = in_doc.groupBy("manuscript_id", "token").agg(
        F.count("*").alias("df"), F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("ss"), F.max("c").alias("peak_count"), F.min(F.struct(-F.col("c"), F.col("doc_id"))).alias("at")
    )
    p = F.col("paragraphs").cast("double")
    fit = (F.col("df") >= lx.BURST_DF) & (F.col("df") <= F.floor(F.col("paragraphs") * lx.WIDE_SHARE)) & (F.col("peak_count") >= 2)
    out = sums.join(_paragraph_counts(rows), "manuscript_id").filter(fit).withColumn("mean", F.col("s") / p)
    out = out.withColumn("std", F.sqrt(F.col("ss") / p - F.col("mean") * F.col("mean"))).filter("std > 0").withColumn("z", (F.col("peak_count") - F.col("mean")) / F.col("std"))
    out = out.filter(F.col("z") >= lx.BURST_Z).withColumn("burst_strength", F.round(F.col("z") * F.col("peak_count"), 4)).filter(F.col("burst_strength") >= lx.BURST_STRENGTH)
    out = out.select("manuscript_id", "token", F.col("df").alias("document_frequency"), "peak_count", F.col("at.doc_id").alias("peak_doc_id"), F.round("z", 4).alias("z_score"), "burst_strength")
    return top(out, k, F.desc("burst_strength"), F.asc("token"))


def term_frequency(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.select(F.explode(tx.apostrophe_tokens(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("count"))


def frequency_against(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """Rates per million in a corpus and in a reference, and their ratio, null where the reference lacks the word."""
    own, other = term_frequency(rows), term_frequency(reference).withColumnRenamed("count", "reference_count")
    total, other_total = (d.agg(F.sum(c)).first()[0] or 0 for d, c in ((own, "count"), (other, "reference_count")))
    rate, other_rate = F.col("count") / total * 1e6, F.coalesce(F.col("reference_count"), F.lit(0)) / max(1, other_total) * 1e6
    out = own.join(other, "word", "left")
    return out.select("word", "count", F.round(rate, 2).alias("per_million"), F.coalesce("reference_count", F.lit(0)).alias("reference_count"), F.round(other_rate, 2).alias("reference_per_million"), F.round(F.when(other_rate > 0, rate / other_rate), 2).alias("relative"))


def type_token_density(rows: DataFrame) -> DataFrame:
    own = rows.select("manuscript_id", "doc_id", tx.apostrophe_tokens(F.col("text")).alias("own"))
    n = F.size("own").cast("long")
    rest = F.size(F.filter("own", lambda t: ~t.isin(lx.DENSITY_STOPWORDS)))
    part = lambda x: F.round(F.when(n > 0, x / n).otherwise(0.0), 4)
    return own.select("manuscript_id", "doc_id", n.alias("token_count"), part(F.size(F.array_distinct("own"))).alias("lexical_density"), part(rest).alias("content_density"), part(n - rest).alias("stopword_ratio"))


def density_issues(rows: DataFrame, lexical: float = 0.6, content: float = 0.55) -> DataFrame:
    """Paragraphs under either bound, with which they miss."""
    low, thin = F.col("lexical_density") < lexical, F.col("content_density") < content
    reason = F.array_join(F.array_compact(F.array(F.when(low, "lexical_density"), F.when(thin, "content_density"))), ",")
    return type_token_density(rows).filter(low | thin).withColumn("reason", reason).select("manuscript_id", "doc_id", "lexical_density", "content_density", "reason")
