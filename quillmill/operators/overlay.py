"""Issues of edits files over a manuscript's words, sentences and paragraphs.

Items are rows (file, item, issue_type, detector, paragraph_id, sentence_ids, token_ids); words are rows (token_id,
position, sentence_id, paragraph_id). A token that a file (or an item) names again counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: confidence of a word by its issues for each source, at most
LEVELS = [(0.0, 1.0), (0.25, 0.8), (0.5, 0.6), (0.75, 0.4)]
LEAST_CONFIDENCE = 0.2
# fixed values: issue types that a summary counts, and the detector whose issues stay with their sentences
SIGNAL_TYPES = ["negative_pacing", "vague_intensity", "ambivalence"]
SENTENCE_DETECTOR = "surprisal_scout"


def confidence(share: Column) -> Column:
    out = F.lit(LEAST_CONFIDENCE)
    for most, value in reversed(LEVELS):
        out = F.when(share <= most, value).otherwise(out)
    return out


def named_tokens(items: DataFrame, scope: str = "file") -> DataFrame:
    """(file, token_id, times): each token that a file names, how often it counts: once in a file, or once for each item of it."""
    each = items.select("file", "item", F.explode(F.array_distinct("token_ids")).alias("token_id"))
    times = F.lit(1).cast("long") if scope == "file" else F.count("*")
    return each.groupBy("file", "token_id").agg(times.alias("times"))


def missing_tokens(items: DataFrame, words: DataFrame, scope: str = "file") -> DataFrame:
    """(token_id, count) of named tokens that the index lacks."""
    return named_tokens(items, scope).join(words.select("token_id"), "token_id", "left_anti").groupBy("token_id").agg(F.sum("times").alias("count"))


def word_confidence(items: DataFrame, words: DataFrame, sources: int, scope: str = "file") -> DataFrame:
    """(token_id, position, issues, confidence) of every word; ``sources`` is the number of files."""
    found = named_tokens(items, scope).groupBy("token_id").agg(F.sum("times").alias("issues"))
    out = words.join(found, "token_id", "left").withColumn("issues", F.coalesce("issues", F.lit(0)))
    return out.select("token_id", "position", "issues", confidence(F.col("issues") / F.lit(float(max(1, sources)))).alias("confidence"))


def overall_confidence(rated: DataFrame) -> DataFrame:
    """One row: words and their mean confidence, 1 without words; tenths are added, so that any order gives the same mean."""
    tenths = F.sum(F.round(10 * F.col("confidence")).cast("long"))
    return rated.agg(F.count("*").alias("words"), F.when(F.count("*") > 0, tenths / (10 * F.count("*"))).otherwise(1.0).alias("confidence"))


def scope_counts(items: DataFrame, words: DataFrame, scope: str = "file") -> DataFrame:
    """(scope, id, count): the issues that stand at each word, sentence and paragraph.

    An item's sentences are those that it names and the index knows, else those of its tokens. An item of the detector
    that rates sentences isn't counted at its paragraph if it has sentences.
    """
    by_word = named_tokens(items, scope).join(words.select("token_id"), "token_id", "left_semi").groupBy("token_id").agg(F.sum("times").alias("count"))
    out = by_word.select(F.lit("word").alias("scope"), F.col("token_id").alias("id"), "count")
    known = words.select("sentence_id").distinct()
    named = items.select("file", "item", F.explode(F.array_distinct("sentence_ids")).alias("sentence_id")).join(known, "sentence_id", "left_semi")
    of_tokens = items.join(named.select("file", "item").distinct(), ["file", "item"], "left_anti").select("file", "item", F.explode("token_ids").alias("token_id"))
    of_tokens = of_tokens.join(words.select("token_id", "sentence_id"), "token_id").select("file", "item", "sentence_id").distinct()
    sentences = named.select("file", "item", "sentence_id").unionByName(of_tokens)
    out = out.unionByName(sentences.groupBy(F.lit("sentence").alias("scope"), F.col("sentence_id").alias("id")).agg(F.count("*").alias("count")))
    stays = items.filter(F.coalesce(F.col("detector"), F.lit("")) == SENTENCE_DETECTOR).join(sentences.select("file", "item").distinct(), ["file", "item"], "left_semi").select("file", "item")
    at = items.join(stays, ["file", "item"], "left_anti").join(words.select("paragraph_id").distinct(), "paragraph_id", "left_semi")
    return out.unionByName(at.groupBy(F.lit("paragraph").alias("scope"), F.col("paragraph_id").alias("id")).agg(F.count("*").alias("count")))


def type_counts(items: DataFrame, types: list[str] = SIGNAL_TYPES) -> DataFrame:
    """One row with the number of issues of each of the types, 0 where there is none; other types aren't counted."""
    return items.agg(*[F.count_if(F.col("issue_type") == t).alias(t) for t in types])


def merged_issues(items: DataFrame) -> DataFrame:
    """Items with an issue_id each: their own, else one made of file and item."""
    return items.withColumn("issue_id", F.coalesce("issue_id", F.concat_ws("-", "file", "item")))
