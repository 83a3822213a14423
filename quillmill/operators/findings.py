"""Rule-based findings, the issue table, overlays, bundles, comparisons of runs and trends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.functions import lexicons as lx
from quillmill.functions import text as tx
from quillmill.operators import lexical
from quillmill.operators.checkpoints import saved


def phrase_hits(rows: DataFrame, phrases: list[str]) -> DataFrame:
    return rows.select("manuscript_id", "doc_id", F.explode(tx.phrases_in(F.col("text"), phrases)).alias("phrase"))


def slop_reasons(rows: DataFrame, overused: list[str], phrases: list[str] = lx.LOW_SIGNAL_PHRASES, hedges: list[str] = lx.HEDGES) -> DataFrame:
    """Paragraphs with any reason: a low-signal phrase, a hedge, or two overused words."""
    found = F.transform(F.array(F.lower("text")), lambda t: F.struct(tx.held(t, phrases).alias("low"), tx.held(t, hedges).alias("hedge"), tx.words_held(t, overused).alias("over")))
    # each text is searched once: a filter on what is exploded can't be pushed below, where it would search again
    own = rows.select("manuscript_id", "doc_id", F.explode_outer(found).alias("x")).select("manuscript_id", "doc_id", "x.*")
    low, hedge, over = F.col("low"), F.col("hedge"), F.col("over")
    reasons = F.array_compact(F.array(F.when(low > 0, "low_signal_phrase"), F.when(hedge > 0, "hedge_density"), F.when(over >= 2, "lexical_overuse_cluster")))
    out = own.select("manuscript_id", "doc_id", reasons.alias("r"), low.alias("phrase_hits"), hedge.alias("hedge_hits"), over.alias("overused_hits"))
    return out.filter(F.size("r") > 0).select("manuscript_id", "doc_id", F.array_join("r", ",").alias("reasons"), "phrase_hits", "hedge_hits", "overused_hits")


def reason_counts(findings: DataFrame) -> DataFrame:
    return findings.select("manuscript_id", F.explode(F.split("reasons", ",")).alias("reason")).groupBy("manuscript_id", "reason").agg(F.count("*").alias("count"))


def overused_words(rows: DataFrame, k: int = 20, least: int = 4) -> list[str]:
    """The k most frequent words of ``least`` letters or more; a fixed number of words is all that reaches the driver."""
    found = lexical.term_frequency(rows).filter(F.length("word") >= least).orderBy(F.desc("count"), "word").limit(k)
    return [r["word"] for r in found.collect()]


def ending_score(rows: DataFrame) -> DataFrame:
    """Lexicon hits of a paragraph: nouns and adjectives once, phrases twice, patterns three times."""
    own = tx.apostrophe_tokens(F.col("text"))
    hits = lambda words: F.size(F.filter("own", lambda t: t.isin(words))).cast("long")
    phrases = F.size(tx.phrases_in(F.col("text"), lx.ENDING_PHRASES)).cast("long")
    patterns = reduce(lambda a, b: a + b, [F.col("text").rlike(f"(?i){p}").cast("long") for p in lx.ENDING_PATTERNS])
    out = rows.select("manuscript_id", "doc_id", "text", own.alias("own")).select("manuscript_id", "doc_id", hits(lx.ABSTRACT_NOUNS).alias("nouns"), hits(lx.VAGUE_ADJECTIVES).alias("adjectives"), phrases.alias("phrases"), patterns.alias("patterns"))
    return out.withColumn("score", F.expr("nouns + adjectives + 2 * phrases + 3 * patterns"))


def sentiment(rows: DataFrame, positive: list[str] = lx.POSITIVE, negative: list[str] = lx.NEGATIVE, ambivalent: list[str] = lx.AMBIVALENT, flag_at: float = 0.08) -> DataFrame:
    own = rows.select("manuscript_id", "doc_id", tx.apostrophe_tokens(F.col("text")).alias("own"))
    n = F.size("own")
    count = lambda words: F.size(F.filter("own", lambda t: t.isin(words)))
    part = lambda x: F.when(n > 0, x / n).otherwise(0.0)
    out = own.select("manuscript_id", "doc_id", F.round(part(count(positive) - count(negative)), 6).alias("sentiment"), F.round(part(count(ambivalent)), 6).alias("ambivalence"))
    return out.withColumn("is_ambivalent", F.col("ambivalence") >= flag_at)


def slop_flags(scores: DataFrame, percentile: float = 0.9, outlier: float = 0.97) -> DataFrame:
    """Rows (manuscript_id, avg_logprob, transitions, ...) that are too likely: at their manuscript's percentile or above it, with a transition or as an outlier.

    Adds the bounds, reason and severity; rows without a log-probability (null or NaN) count for nothing.
    """
    own = scores.filter(F.col("avg_logprob").isNotNull() & ~F.isnan("avg_logprob"))
    bounds = own.groupBy("manuscript_id").agg(F.percentile("avg_logprob", percentile).alias("threshold"), F.percentile("avg_logprob", outlier).alias("outlier_threshold"))
    turns = F.size("transitions") > 0
    out = own.join(bounds, "manuscript_id").filter((F.col("avg_logprob") >= F.col("threshold")) & (turns | (F.col("avg_logprob") >= F.col("outlier_threshold"))))
    reason = F.when(turns, "high_logprob_plus_transition").otherwise("high_logprob_extreme_outlier")
    return out.withColumn("reason", reason).withColumn("severity", severity(F.col("reason")))


def percentile_flags(rows: DataFrame, transitions: list[str]) -> DataFrame:
    """Paragraphs that are too likely under their manuscript's own unigrams: the log-probability is the surprisal's negative."""
    s = lexical.surprisal(rows).filter("token_count >= 2").select("manuscript_id", "doc_id", (-F.col("surprisal")).alias("avg_logprob"))
    found = slop_flags(s.join(rows.select("doc_id", tx.phrases_in(F.col("text"), transitions).alias("transitions")), "doc_id"))
    return found.select("manuscript_id", "doc_id", "avg_logprob", F.round("threshold", 6).alias("threshold"), F.round("outlier_threshold", 6).alias("outlier_threshold"), "reason", "severity")


def severity(reason: Column) -> Column:
    return F.when(reason == "high_logprob_plus_transition", "medium").otherwise("low")


def issues(rows: DataFrame, overused: list[str]) -> DataFrame:
    """Findings of several detectors as one table: manuscript_id, doc_id, detector, type."""
    density = lexical.density_issues(rows).select("manuscript_id", "doc_id", F.lit("density").alias("detector"), F.explode(F.split("reason", ",")).alias("type"))
    slop = slop_reasons(rows, overused).select("manuscript_id", "doc_id", F.lit("slop").alias("detector"), F.explode(F.split("reasons", ",")).alias("type"))
    return density.unionByName(slop)


def flattened_highlights(metrics: DataFrame) -> DataFrame:
    """Highlights (kind, severity, message, source_metric) of rows (metric, highlights: array of structs kind, severity, message)."""
    h = lambda c, default: F.coalesce(F.col(f"h.{c}"), default).alias(c)
    each = metrics.select("metric", F.explode("highlights").alias("h")).filter("h is not null")
    return each.select(h("kind", F.col("metric")), h("severity", F.lit("info")), h("message", F.lit("")), F.col("metric").alias("source_metric"))


def flattened_numbers(documents: DataFrame, key: str, json: str, levels: int = 4) -> DataFrame:
    """(key, path, value) of the numbers of a JSON object (a text), nested objects by dotted path; booleans are numbers, lists are skipped.

    However deep: what is nested deeper than ``levels`` is written and opened by as many levels again, until nothing is left.
    """
    level = documents.select(key, F.lit("").alias("path"), F.try_parse_json(json).alias("v")).filter("v is not null")
    out = None
    while True:
        for _ in range(levels):
            fields = level.select(key, "path", F.explode(F.from_json(F.to_json("v"), "map<string,variant>")).alias("name", "v"))
            fields = fields.select(key, F.concat("path", F.when(F.col("path") != "", ".").otherwise(""), "name").alias("path"), "v", F.schema_of_variant("v").alias("kind"))
            value = F.when(F.col("kind") == "BOOLEAN", F.try_variant_get("v", "$", "boolean").cast("double")).otherwise(F.try_variant_get("v", "$", "double"))
            own = fields.filter(F.col("kind").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|BOOLEAN)$")).select(key, "path", value.alias("value"))
            out = own if out is None else out.unionByName(own)
            level = fields.filter(F.col("kind").startswith("OBJECT")).select(key, "path", "v")
        rest = saved(level.select(key, "path", F.to_json("v").alias("v")))
        if rest.isEmpty():
            return out
        level = rest.withColumn("v", F.try_parse_json("v"))


def number_at(json: Column, path: str) -> Column:
    """The number at a path of a JSON text, or null if there is none or it is no number."""
    v = F.try_variant_get(F.try_parse_json(json), "$." + path, "variant")
    return F.when(F.schema_of_variant(v).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(v, "$", "double"))


def bundle(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Every paragraph with its issues; issues of unknown paragraphs are dropped."""
    own = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "detector", "type"))), ",").alias("list"))
    return rows.select("manuscript_id", "doc_id").join(own, "doc_id", "left").select("manuscript_id", "doc_id", F.coalesce("n", F.lit(0)).alias("issue_count"), F.coalesce("list", F.lit("")).alias("issues"))


def token_findings(rows: DataFrame) -> DataFrame:
    """(manuscript_id, doc_id, pos, token, finders): which of four token detectors find something at a token."""
    each = lexical.exploded(rows, tx.apostrophe_tokens(F.col("text")))
    from pyspark.sql.window import Window

    before = F.lag("token").over(Window.partitionBy("doc_id").orderBy("pos"))
    found = F.array_compact(F.array(F.when(F.length("token") <= 2, "short"), F.when(F.length("token") >= 12, "long"), F.when(F.col("token").isin(lx.STOPWORDS), "function"), F.when(F.col("token") == before, "repeated")))
    return each.withColumn("finders", found)


def confidence(share: Column) -> Column:
    return F.when(share <= 0, 1.0).when(share <= 0.25, 0.8).when(share <= 0.5, 0.6).when(share <= 0.75, 0.4).otherwise(0.2)


def confidence_overlay(found: DataFrame, sources: int = 4) -> DataFrame:
    """Each paragraph's mean confidence over its tokens, from the share of sources that find something at a token."""
    tenths = F.round(10 * confidence(F.size("finders") / sources)).cast("long")  # whole numbers, so that any order of adding gives the same mean
    return found.groupBy("manuscript_id", "doc_id").agg(F.count("*").alias("tokens"), F.count_if(F.size("finders") > 0).alias("marked"), (F.sum(tenths) / (10 * F.count("*"))).alias("confidence"))


def scope_counts(found: DataFrame) -> DataFrame:
    """How many words and paragraphs each finder marks."""
    each = found.select("doc_id", "pos", F.explode("finders").alias("finder"))
    per_doc = each.groupBy("finder", "doc_id").agg(F.count("*").alias("words"))
    return per_doc.groupBy("finder").agg(F.sum("words").alias("words"), F.count("*").alias("paragraphs"))


def run_metrics(rows: DataFrame) -> DataFrame:
    """(run_id, document_entropy, mean_surprisal, average_lexical_density, token_count) of each manuscript as a run."""
    e = lexical.document_entropy(rows).select("manuscript_id", "document_entropy", "token_count")
    s = lexical.surprisal(rows).filter(F.col("token_count") >= lx.LEAST_TOKENS).groupBy("manuscript_id").agg(F.round(F.avg("adjusted_surprisal"), 4).alias("mean_surprisal"))
    d = lexical.signal_density(rows).groupBy("manuscript_id").agg(F.round(F.avg("lexical_density"), 4).alias("average_lexical_density"))
    return e.join(s, "manuscript_id", "left").join(d, "manuscript_id", "left").withColumnRenamed("manuscript_id", "run_id")


def flattened(metrics: DataFrame) -> DataFrame:
    """(run_id, metric, value) of the numeric columns."""
    names = [c for c in metrics.columns if c != "run_id"]
    return metrics.unpivot("run_id", [F.col(c).cast("double").alias(c) for c in names], "metric", "value").filter("value is not null")


def metric_delta(metrics: DataFrame, baseline: str, current: str) -> DataFrame:
    """Shared metrics of two runs (run_id, metric, value) and their difference."""
    of = lambda run, name: metrics.filter(F.col("run_id") == run).select("metric", F.col("value").alias(name))
    both = of(baseline, "b").join(of(current, "c"), "metric")
    return both.select("metric", F.round("b", 6).alias("baseline"), F.round("c", 6).alias("current"), F.round(F.col("c") - F.col("b"), 6).alias("delta"))


def changed(highlights: DataFrame, baseline: str, current: str) -> DataFrame:
    """Highlights (manuscript_id, highlight) that are new in the current run, or resolved since the baseline."""
    of = lambda run: highlights.filter(F.col("manuscript_id") == run).select("highlight")
    new = of(current).subtract(of(baseline)).select("highlight", F.lit("new").alias("state"))
    return new.unionByName(of(baseline).subtract(of(current)).select("highlight", F.lit("resolved").alias("state")))


def trend(history: DataFrame, current: DataFrame) -> DataFrame:
    """History with the current run, unless it is there already."""
    return history.unionByName(current.join(history, "run_id", "left_anti"))


def compared_densities(left: DataFrame, right: DataFrame, threshold: float = 0.1) -> DataFrame:
    """(name, density) of two texts: relative difference, and whether they collide."""
    both = left.select("name", F.col("density").alias("a")).join(right.select("name", F.col("density").alias("b")), "name", "full_outer").fillna(0.0, ["a", "b"])
    most = F.greatest("a", "b")
    d = F.when(most > 0, F.abs(F.col("a") - F.col("b")) / most).otherwise(0.0)
    return both.select("name", F.round("a", 6).alias("left_density"), F.round("b", 6).alias("right_density"), F.round(d, 6).alias("difference"), ((most > 0) & (d <= threshold)).alias("is_collision"))
