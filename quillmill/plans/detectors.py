"""The registry of detectors: each takes paragraphs (manuscript_id, doc_id, text) and returns issues of one schema."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.operators import findings, lexical, windows
from quillmill.operators.annotated import tokens_of

TOKEN = ["doc_id", "sentence", "idx", "token", "lemma", "pos", "dep", "head"]
ISSUE = ["manuscript_id", "doc_id", "detector", "type", "severity", "message"]

_detectors: dict[str, Callable[[DataFrame], DataFrame]] = {}


def detector(name: str):
    """Register a function under a name."""

    def keep(f):
        _detectors[name] = f
        return f

    return keep


_annotators: dict[str, Callable[[DataFrame], DataFrame]] = {}


def annotator(name: str):
    """Register what turns paragraphs into tokens (doc_id, sentence, idx, token, lemma, pos, dep, head), or into sentences (doc_id, sentence, words)."""

    def keep(f):
        _annotators[name] = f
        return f

    return keep


def annotated(rows: DataFrame, name: str) -> DataFrame:
    """The tokens of an annotator; one that leaves a column out is an error."""
    out = _annotators[name](rows)
    out = tokens_of(out) if "words" in out.columns else out
    if missing := set(TOKEN) - set(out.columns):
        raise ValueError(f"annotator {name} lacks {sorted(missing)}")
    return out.select(*TOKEN)


def annotated_sentences(rows: DataFrame, name: str) -> DataFrame:
    """The sentences of an annotator, each with its words in one array; of one that gives tokens, the tokens."""
    out = _annotators[name](rows)
    return out.select("doc_id", "sentence", "words") if "words" in out.columns else annotated(rows, name)


def run_tool(name: str, rows: DataFrame, **config) -> DataFrame:
    """A registered detector by name with its own settings; an unknown name says which there are."""
    if name not in _detectors:
        raise KeyError(f"unknown tool {name}: one of {names()}")
    return _detectors[name](rows, **config)


def names() -> list[str]:
    return sorted(_detectors)


def _issue(df: DataFrame, name: str, kind, severity, message) -> DataFrame:
    return df.select("manuscript_id", "doc_id", F.lit(name).alias("detector"), kind.alias("type"), severity.alias("severity"), message.alias("message"))


@detector("density")
def density(rows: DataFrame) -> DataFrame:
    found = lexical.density_issues(rows)
    return _issue(found, "density", F.col("reason"), F.lit("medium"), F.format_string("lexical %.4f, content %.4f", "lexical_density", "content_density"))


@detector("slop")
def slop(rows: DataFrame) -> DataFrame:
    found = findings.slop_reasons(rows, findings.overused_words(rows))
    return _issue(found, "slop", F.col("reasons"), F.lit("low"), F.format_string("%d phrases, %d hedges, %d overused words", "phrase_hits", "hedge_hits", "overused_hits"))


@detector("surprisal")
def surprisal(rows: DataFrame) -> DataFrame:
    found = findings.percentile_flags(rows, ["maybe", "perhaps"])
    return _issue(found, "surprisal", F.col("reason"), F.col("severity"), F.format_string("log-probability %.4f", "avg_logprob"))


@detector("ending")
def ending(rows: DataFrame) -> DataFrame:
    found = findings.ending_score(rows).filter("score >= 3")
    return _issue(found, "ending", F.lit("lexicon"), F.when(F.col("score") >= 6, "high").otherwise("low"), F.format_string("score %d", "score"))


@detector("burst")
def burst(rows: DataFrame) -> DataFrame:
    found = lexical.bursts(rows)
    return _issue(found.withColumn("doc_id", F.col("peak_doc_id")), "burst", F.lit("token"), F.lit("low"), F.format_string("%s: z %.4f", "token", "z_score"))


def sweep(rows: DataFrame, only: list[str] | None = None) -> DataFrame:
    """All issues of the detectors, as one plan."""
    return reduce(lambda a, b: a.unionByName(b), [_detectors[n](rows) for n in only or names()])


def diagnostics(rows: DataFrame) -> DataFrame:
    """One row of nested metrics for each manuscript: entropy, surprisal, density, themes, patterns, bursts."""
    runs = findings.run_metrics(rows)
    nested = lambda df, name, *cols: df.groupBy("manuscript_id").agg(F.sort_array(F.collect_list(F.struct("rank", *cols))).alias(name))
    parts = [
        nested(lexical.themes(rows), "themes", "theme", "count", "spread", "score"),
        nested(lexical.repeated_patterns(rows, 2), "bigrams", "pattern", "count"),
        nested(lexical.bursts(rows), "bursts", "token", "peak_doc_id", "z_score"),
        windows.depressions(rows).groupBy("manuscript_id").agg(F.count("*").alias("entropy_depressions")),
    ]
    out = runs.withColumnRenamed("run_id", "manuscript_id")
    for p in parts:
        out = out.join(p, "manuscript_id", "left")
    return out
