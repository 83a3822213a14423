"""Operators over annotations that come as columns: part of speech, lemma, dependency, log-probability, frequency.

A token table has doc_id, sentence, idx (place in the sentence), token, lemma, pos, dep, head (idx of its head). No
model is run here; whatever annotates texts writes these columns. A sentence table has a row for each sentence: doc_id,
sentence, words (an array of token, lemma, pos, dep, head in order, from 0). Operators that look from a token at others of its
sentence take either: a sentence's own array needs no exchange.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions import lexicons as lx
from quillmill.functions import text as tx
from quillmill.operators import similarity, vector_index

# fixed values: dependency patterns, as part of speech of the head and dependency of the child
PATTERNS = [("VERB", "prt"), ("VERB", "dobj"), ("NOUN", "amod"), ("VERB", "advmod")]
#: Patterns whose pair has the dependent word first.
DEPENDENT_FIRST = ["amod", "advmod"]
# fixed values: words of negation and contrast, dependencies that make no main verb
NEGATION, CONTRAST, HELPING = ["not", "n't"], ["just", "only", "but"], ["aux", "auxpass"]
# fixed values: adjectives and nouns of quiet intensity
QUIET, ABSTRACT = ["quiet", "silent", "lurking", "languid"], ["intensity", "strength", "moment", "connection"]


WORD = ["token", "lemma", "pos", "dep", "head"]


def _in_sentences(tokens: DataFrame) -> bool:
    return "words" in tokens.columns


def tokens_of(sentences: DataFrame) -> DataFrame:
    """The token table of a sentence table."""
    each = sentences.select("doc_id", "sentence", F.posexplode("words").alias("idx", "w"))
    return each.select("doc_id", "sentence", F.col("idx").cast("long").alias("idx"), *[F.col(f"w.{c}").alias(c) for c in WORD])


def sizes(tokens: DataFrame) -> DataFrame:
    """(doc_id, tokens): how many tokens a document has; those without any are left out."""
    n = F.sum(F.size("words")) if _in_sentences(tokens) else F.count("*")
    return tokens.groupBy("doc_id").agg(n.cast("long").alias("tokens")).filter("tokens > 0")


def changed(tokens: DataFrame, change: Callable[[Callable[[str], Column]], dict[str, Column]]) -> DataFrame:
    """Tokens with other columns: ``change`` takes a function that gives a token's column by name, and returns the new ones."""
    if not _in_sentences(tokens):
        return tokens.withColumns(change(F.col))

    def word(w: Column) -> Column:
        new = change(lambda c: w[c])
        return F.struct(*[new.get(c, w[c]).alias(c) for c in WORD])

    return tokens.withColumn("words", F.transform("words", word))


def with_heads(tokens: DataFrame) -> DataFrame:
    """Each token beside its head's columns, prefixed head_."""
    if _in_sentences(tokens):
        head = lambda w: F.get("words", w["head"].cast("int"))
        both = F.transform("words", lambda w, i: F.struct(i.cast("long").alias("idx"), *[w[c].alias(c) for c in WORD], head(w).alias("h")))
        each = tokens.filter("doc_id IS NOT NULL").select("doc_id", "sentence", F.inline(both)).filter("h IS NOT NULL")
        return each.select("doc_id", "sentence", "idx", *WORD, F.col("h.lemma").alias("head_lemma"), F.col("h.pos").alias("head_pos"))
    head = tokens.select("doc_id", "sentence", F.col("idx").alias("head"), F.col("lemma").alias("head_lemma"), F.col("pos").alias("head_pos"))
    return tokens.join(head, ["doc_id", "sentence", "head"])


def dependency_patterns(tokens: DataFrame) -> DataFrame:
    """(doc_id, pattern, pair, count) of pairs of lemmas in the fixed patterns: "verb object", but "adjective noun" and "adverb verb"."""
    keep = None
    for pos, dep in PATTERNS:
        one = (F.col("head_pos") == pos) & (F.col("dep") == dep)
        keep = one if keep is None else keep | one
    both = with_heads(tokens).filter(keep)
    return both.groupBy("doc_id", F.concat_ws(">", "head_pos", "dep").alias("pattern"), F.lower(F.when(F.col("dep").isin(DEPENDENT_FIRST), F.concat_ws(" ", "lemma", "head_lemma")).otherwise(F.concat_ws(" ", "head_lemma", "lemma"))).alias("pair")).agg(F.count("*").alias("count"))


def pattern_density(patterns: DataFrame, sizes: DataFrame) -> DataFrame:
    """Patterns for each thousand tokens, and the entropy of their pairs; sizes has doc_id and tokens."""
    c = F.col("count").cast("double")
    sums = patterns.groupBy("doc_id").agg(F.sum("count").alias("n"), F.sum(c * F.log2(c)).alias("clogc"))
    out = sizes.join(sums, "doc_id", "left")
    return out.select("doc_id", F.round(F.coalesce(F.col("n") / F.col("tokens") * 1000, F.lit(0.0)), 4).alias("density"), F.round(F.coalesce(F.log2("n") - F.col("clogc") / F.col("n"), F.lit(0.0)), 4).alias("structural_entropy"))


def negation_contrast(tokens: DataFrame) -> DataFrame:
    """(doc_id, sentence, idx, negated, turn, verb): each word of negation whose verb is followed by a contrast word and that by a main verb.

    In a sentence table the next such words are searched in the sorted places of all; in a token table they come from running
    minima over a sentence, backwards.
    """
    if _in_sentences(tokens):
        return _negations(tokens)
    word = F.lower("token")
    later = Window.partitionBy("doc_id", "sentence").orderBy(F.desc("idx")).rowsBetween(Window.unboundedPreceding, -1)
    turn = F.min(F.when(word.isin(CONTRAST), F.col("idx"))).over(later)
    verb = F.min(F.when((F.col("pos") == "VERB") & ~F.coalesce(F.col("dep").isin(HELPING), F.lit(False)), F.col("idx"))).over(later)
    ahead = tokens.select("doc_id", "sentence", "idx", "pos", turn.alias("turn"), verb.alias("verb"))
    negated = tokens.filter((F.col("dep") == "neg") & word.isin(NEGATION)).select("doc_id", "sentence", "idx", F.col("head").alias("negated"))
    head = ahead.filter(F.col("pos").isin("VERB", "AUX") & F.col("turn").isNotNull()).select("doc_id", "sentence", F.col("idx").alias("negated"), "turn")
    main = ahead.filter("verb IS NOT NULL").select("doc_id", "sentence", F.col("idx").alias("turn"), "verb")
    return negated.join(head, ["doc_id", "sentence", "negated"]).join(main, ["doc_id", "sentence", "turn"]).select("doc_id", "sentence", "idx", "negated", "turn", "verb")


def _first_after(places: pd.Series, at: pd.Series) -> pd.Series:
    """For each of ``at`` the first of the sorted places behind it, or -1."""
    out = []
    for own, x in zip(places, at):
        out.append(np.append(own, -1)[np.searchsorted(own, x, "right")] if len(x) else x)
    return pd.Series(out)


def _negations(sentences: DataFrame) -> DataFrame:
    word = lambda w: F.lower(w["token"])
    places = lambda test: F.array_compact(F.transform("words", lambda w, i: F.when(test(w), i.cast("long"))))
    head = lambda w: F.get("words", w["head"].cast("int"))["pos"]
    none = F.array().cast("array<bigint>")
    each = F.transform("words", lambda w, i: F.when((w["dep"] == "neg") & word(w).isin(NEGATION) & head(w).isin("VERB", "AUX"), F.struct(i.cast("long").alias("idx"), w["head"].alias("negated"))))
    main = places(lambda w: (w["pos"] == "VERB") & ~F.coalesce(w["dep"].isin(HELPING), F.lit(False)))
    # what comes behind is looked for only in sentences that have what comes before
    own = sentences.filter("doc_id IS NOT NULL").select("doc_id", "sentence", "words", F.array_compact(each).alias("x"))
    own = own.select("doc_id", "sentence", "words", "x", F.when(F.size("x") > 0, places(lambda w: word(w).isin(CONTRAST))).otherwise(none).alias("turns"))
    own = own.select("doc_id", "sentence", "x", "turns", F.when(F.size("turns") > 0, main).otherwise(none).alias("verbs"))
    after = F.pandas_udf(_first_after, "array<long>")
    own = own.select("doc_id", "sentence", "x", "verbs", after("turns", F.col("x.negated")).alias("turn"))
    # a turn that isn't there (-1) would find the first verb of all, but falls away below
    own = own.select("doc_id", "sentence", F.inline(F.arrays_zip(F.col("x.idx").alias("idx"), F.col("x.negated").alias("negated"), F.col("turn").alias("turn"), after("verbs", "turn").alias("verb"))))
    return own.filter("turn >= 0 AND verb >= 0")


def quiet_intensity(tokens: DataFrame) -> DataFrame:
    return with_heads(tokens).filter((F.col("dep") == "amod") & F.lower("lemma").isin(QUIET) & F.lower("head_lemma").isin(ABSTRACT)).select("doc_id", "sentence", "idx", "lemma", "head_lemma")


def _sizes(heads: pd.Series) -> pd.Series:
    """Of each sentence (heads by place): how many tokens lie below each token, itself included, and the last of them."""
    out = []
    for own in heads:
        up = own.tolist()
        n = len(up)
        size, last, waits, done = [1] * n, list(range(n)), [0] * n, [False] * n
        for h in up:
            waits[h] += 1
        free = [i for i in range(n) if not waits[i]]
        while free:  # what has nothing below it that isn't counted is added to its head
            i = free.pop()
            done[i], h = True, up[i]
            size[h] += size[i]
            last[h] = max(last[h], last[i])
            waits[h] -= 1
            if not waits[h]:
                free.append(h)
        for i in range(n):  # the rest are circles, of which each token is below each other
            if not done[i]:
                ring = [i]
                while up[ring[-1]] != i:
                    ring.append(up[ring[-1]])
                whole, end = sum(size[j] for j in ring), max(last[j] for j in ring)
                for j in ring:
                    size[j], last[j], done[j] = whole, end, True
        out.append([{"tokens": a, "last": b} for a, b in zip(size, last)])
    return pd.Series(out)


def subtree_sizes(tokens: DataFrame) -> DataFrame:
    """(doc_id, sentence, root, tokens, last): for each token how many lie below it, itself included, and the last of them.

    Sizes are added up from below, in time that grows with the sentence and not with its subtrees, none of which is written out.
    """
    if _in_sentences(tokens):
        heads = tokens.filter("doc_id IS NOT NULL").select("doc_id", "sentence", F.transform("words", lambda w: w["head"]).alias("heads"))
    else:
        heads = _heads(tokens).filter("doc_id IS NOT NULL AND sentence IS NOT NULL")
    sizes = F.pandas_udf(_sizes, "array<struct<tokens: long, last: long>>")
    each = heads.select("doc_id", "sentence", F.posexplode(sizes("heads")).alias("root", "x"))
    return each.select("doc_id", "sentence", F.col("root").cast("long").alias("root"), "x.tokens", "x.last")


def _heads(tokens: DataFrame) -> DataFrame:
    """(doc_id, sentence, heads): a sentence's heads as one array, as its tokens are numbered from 0 without gaps."""
    return tokens.groupBy("doc_id", "sentence").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "head"))), lambda x: x["head"]).alias("heads"))


def _below(heads: pd.Series, root: pd.Series) -> pd.Series:
    out = []
    for own, r in zip(heads, root):
        up = np.array(own)
        up[r] = r
        for _ in range(max(1, len(up)).bit_length()):
            up = up[up]
        out.append(np.flatnonzero(up == r))
    return pd.Series(out)


def subtrees(tokens: DataFrame, roots: DataFrame) -> DataFrame:
    """(doc_id, sentence, root, idx) of all tokens below each root (doc_id, sentence, root).

    Pointers to heads are doubled in each sentence's array of them.
    """
    heads = _heads(tokens)
    below = F.pandas_udf(_below, "array<long>")
    return heads.join(roots, ["doc_id", "sentence"]).select("doc_id", "sentence", "root", F.explode(below("heads", "root")).alias("idx"))


# fixed values: semantic gains below which a simile is empty, and from which it may be good
EMPTY_GAIN, GOOD_GAIN = 0.15, 0.38


def simile_label(gain, is_cliche):
    return F.when(is_cliche, "CLICHE").when(gain < EMPTY_GAIN, "EMPTY").when(gain >= GOOD_GAIN, "POTENTIALLY_GOOD").otherwise("WEAK_OR_FUNCTIONAL")


def similes(tokens: DataFrame) -> DataFrame:
    """(doc_id, sentence, idx, left_text, right_text): each preposition 'like' with the words below its head and below itself."""
    like = tokens.filter((F.lower("token") == "like") & (F.col("dep") == "prep")).select("doc_id", "sentence", "idx", "head")
    roots = like.select("doc_id", "sentence", F.explode(F.array("idx", "head")).alias("root")).distinct()
    words = subtrees(tokens, roots).join(tokens.select("doc_id", "sentence", "idx", "token"), ["doc_id", "sentence", "idx"])
    texts = words.groupBy("doc_id", "sentence", "root").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "token"))), lambda x: x["token"]), " ").alias("words"))
    side = lambda at, name: texts.select("doc_id", "sentence", F.col("root").alias(at), F.col("words").alias(name))
    return like.join(side("head", "left_text"), ["doc_id", "sentence", "head"]).join(side("idx", "right_text"), ["doc_id", "sentence", "idx"]).select("doc_id", "sentence", "idx", "left_text", "right_text")


def rated_similes(found: DataFrame, vectors: DataFrame, cliches: list[str]) -> DataFrame:
    """Similes with their gain (1 - cosine of the vectors (text, v) of both sides) and label; a side without a vector has cosine 0."""
    side = lambda name, v: vectors.select(F.col("text").alias(name), F.col("v").alias(v))
    both = found.join(side("left_text", "lv"), "left_text", "left").join(side("right_text", "rv"), "right_text", "left")
    gain = 1 - F.coalesce(tx.cosine(F.col("lv"), F.col("rv")), F.lit(0.0))
    is_cliche = F.size(tx.phrases_in(F.col("right_text"), cliches)) > 0
    return both.withColumn("gain", F.round(gain, 6)).withColumn("label", simile_label(gain, is_cliche)).drop("lv", "rv")


def zipf_means(phrases: DataFrame, frequency: DataFrame) -> DataFrame:
    """(id, mean_zipf) of phrases (id, text) by word frequencies (word, zipf): unknown words count 0, no words give 0."""
    each = phrases.select("id", F.explode_outer(tx.concordance_tokens(F.lower("text"))).alias("word")).join(frequency, "word", "left")
    return each.groupBy("id").agg(F.round(F.avg(F.coalesce("zipf", F.lit(0.0))), 6).alias("mean_zipf"))


def perplexity(tokens: DataFrame) -> DataFrame:
    """Of tokens (doc_id, sentence, logprob): mean and perplexity; fewer than two tokens give NaN."""
    nan = F.lit(float("nan"))
    out = tokens.groupBy("doc_id", "sentence").agg(F.count("logprob").alias("n"), F.avg("logprob").alias("mean"))
    return out.select("doc_id", "sentence", "n", F.when(F.col("n") >= 2, F.col("mean")).otherwise(nan).alias("mean_logprob"), F.when(F.col("n") >= 2, F.exp(-F.col("mean"))).otherwise(nan).alias("perplexity"))


def score_summary(scores: DataFrame) -> DataFrame:
    """Mean score, in which a NaN stays, and the number of slop flags, of (doc_id, score, is_slop)."""
    return scores.groupBy("doc_id").agg(F.avg("score").alias("mean_score"), F.count_if("is_slop").alias("slop"), F.count("*").alias("rows"))


def dimension_mean(words: DataFrame, dimension: DataFrame, value: str, default: float) -> DataFrame:
    """Mean of a word dimension (word, value) over words (doc_id, word), with a default."""
    return words.join(dimension, "word", "left").groupBy("doc_id").agg(F.round(F.avg(F.coalesce(value, F.lit(default))), 6).alias(f"mean_{value}"))


def concreteness(dimension: DataFrame) -> DataFrame:
    """(word, concreteness) of hints (verb, concreteness_hint)."""
    hint = F.lower(F.trim("concreteness_hint"))
    value = F.lit(lx.CONCRETENESS_DEFAULT)
    for name, x in lx.CONCRETENESS.items():
        value = F.when(hint == name, x).otherwise(value)
    return dimension.select(F.lower(F.trim("verb")).alias("word"), value.alias("concreteness")).dropDuplicates(["word"])


def stronger_verbs(verbs: DataFrame, candidates: DataFrame, delta: float = 0.3, k: int = 5) -> DataFrame:
    """For verbs (word, zipf, concreteness) the k best candidates (word, candidate, zipf, concreteness, similarity, depth)."""
    own = verbs.select("word", F.col("zipf").alias("own_zipf"), F.col("concreteness").alias("own_concreteness"))
    met = candidates.join(own, "word").filter((F.col("zipf") <= F.col("own_zipf") - delta) & (F.col("concreteness") >= F.col("own_concreteness")))
    met = met.withColumn("score", F.round(F.col("similarity") + 0.3 * F.col("concreteness") - 0.2 * F.col("zipf") + 0.05 * F.col("depth"), 4))
    w = Window.partitionBy("word").orderBy(F.desc("score"), "candidate")
    return met.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select("word", "candidate", "score", "rank")


def generic_verbs(tokens: DataFrame, generic: list[str]) -> DataFrame:
    """(doc_id, sentence, idx, verb, object): verbs of the list that have a direct object, with the first of these."""
    objects = tokens.filter(F.col("dep").isin("dobj", "obj")).groupBy("doc_id", "sentence", F.col("head").alias("idx")).agg(F.min_by("token", "idx").alias("object"))
    verbs = tokens.filter((F.col("pos") == "VERB") & F.lower("lemma").isin(generic)).select("doc_id", "sentence", "idx", F.lower("lemma").alias("verb"))
    return verbs.join(objects, ["doc_id", "sentence", "idx"])


def troponyms(verbs: DataFrame, lemmas: DataFrame, edges: DataFrame) -> DataFrame:
    """(verb, candidate, depth): the words of lemmas (synset, lemma) one step below (edges child, parent) any synset of a verb.

    A word that stands in several synsets has the greatest depth of these; the verb itself is no candidate.
    """
    own = verbs.select(F.lower("verb").alias("verb")).distinct()
    spaced = F.lower(F.replace("lemma", F.lit("_"), F.lit("-")))
    below = own.join(lemmas.select(F.lower("lemma").alias("verb"), F.col("synset").alias("parent")), "verb").join(edges.select("child", "parent"), "parent").select("verb", F.col("child").alias("synset")).distinct()
    depths = hypernym_depth(edges.select(F.col("child").alias("node"), "parent")).select(F.col("node").alias("synset"), "depth")
    met = below.join(lemmas.select("synset", spaced.alias("candidate")), "synset").join(depths, "synset").filter("candidate <> verb")
    return met.groupBy("verb", "candidate").agg(F.max("depth").alias("depth"))


def hypernym_depth(edges: DataFrame) -> DataFrame:
    """(node, depth): steps from each node up its first parent (node, parent) to a root, by doubling the steps each round.

    A cycle is an error.
    """
    parent = edges.groupBy("node").agg(F.min("parent").alias("parent"))
    n = parent.count()
    ends = parent.select(F.col("parent").alias("node")).distinct().join(parent, "node", "left_anti").select("node", F.col("node").alias("at"), F.lit(0).cast("long").alias("depth"))
    level = similarity.saved(parent.select("node", F.col("parent").alias("at"), F.lit(1).cast("long").alias("depth")).unionByName(ends))
    for _ in range(max(1, n).bit_length() + 1):
        step = level.select(F.col("node").alias("at"), F.col("at").alias("to"), F.col("depth").alias("more"))
        level = similarity.saved(level.join(step, "at").select("node", F.col("to").alias("at"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")))
        if level.filter("moved").isEmpty():
            return level.join(parent, "node", "left_semi").select("node", "depth")
        level = level.drop("moved")
    raise ValueError("the parents form a cycle")


def lateral_terms(lemmas: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """(word, term, rank): for words of lemmas (synset, lemma, position) the terms beside and below their synsets, each once, in order.

    Of each synset first those that share a parent (edges child, parent), then its children; the first place counts.
    """
    spaced = F.lower(F.replace("lemma", F.lit("_"), F.lit(" ")))
    own = lemmas.select(spaced.alias("word"), "synset", F.col("position").alias("sense"))
    up = own.join(edges.select(F.col("child").alias("synset"), "parent"), "synset")
    beside = up.join(edges.select("parent", F.col("child").alias("other")), "parent").select("word", "sense", F.lit(0).alias("side"), F.col("parent").alias("via"), "other")
    below = own.join(edges.select(F.col("parent").alias("synset"), F.col("child").alias("other")), "synset").select("word", "sense", F.lit(1).alias("side"), F.col("synset").alias("via"), "other")
    terms = lemmas.select(F.col("synset").alias("other"), spaced.alias("term"), "position")
    met = beside.unionByName(below).join(terms, "other").filter("term <> word")
    return first_seen(met.groupBy("word", "term").agg(F.min(F.struct("sense", "side", "via", "other", "position")).alias("at")), "word", k)


def first_seen(rows: DataFrame, key: str, k: int) -> DataFrame:
    """Of rows (key, term, at) with each term once at its first place: the k first terms of each key, with their rank."""
    w = Window.partitionBy(key).orderBy("at", "term")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k).select(key, "term", "rank")


def band_candidates(words: DataFrame, vocabulary: DataFrame, frequency: DataFrame, most: float = 4.5, k: int = 10) -> DataFrame:
    """(word, term, rank): for each word the k commonest terms of vocabulary (term, zipf) under ``most`` that the text (word, count) has once at most."""
    rare = vocabulary.filter(F.col("zipf") < most).join(frequency.filter("count > 1").select(F.col("word").alias("term")), "term", "left_anti")
    w = Window.orderBy(F.desc("zipf"), "term")
    best = rare.orderBy(F.desc("zipf"), "term").limit(k + 1).withColumn("n", F.row_number().over(w))  # one more, as a word is none of its own
    met = words.select("word").join(F.broadcast(best), F.col("word") != F.col("term"))
    return met.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy("n")).cast("long")).filter(F.col("rank") <= k).select("word", "term", "rank")


def drift_candidates(words: DataFrame, vocabulary: DataFrame, frequency: DataFrame, k: int = 10) -> DataFrame:
    """(word, term, cosine, rank): for each word (word, v) the k nearest of the vocabulary (term, v) that the text (word, count) has once at most.

    The vocabulary is indexed by cells, and a word asks those that can hold one of its k nearest, however many words there are.
    """
    rare = vocabulary.join(frequency.filter("count > 1").select(F.col("word").alias("term")), "term", "left_anti")
    found = vector_index.top(vector_index.build(rare, "term", "v"), words, "word", "v", k, others_only=True)
    return found.select(F.col("query").alias("word"), F.col("item").alias("term"), "cosine", "rank")
