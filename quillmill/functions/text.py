"""Column functions over texts: cleaning, segmentation, tokens and what is computed from a row's own tokens.

All but one (``json_in``) are built-in expressions of one row: no shuffle and no Python.
"""

from __future__ import annotations

import contextlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmill.functions.lexicons import CONTRACTION_PARTS, STOPWORDS

# fixed values: the line cleaning, in order: pattern and replacement
LINE_RULES = [
    (r"^\s{0,3}#{1,6}\s+", ""),
    (r"^\s*>\s?", ""),
    (r"^\s*[-*+]\s+", ""),
    (r"^\s*\d+\.\s+", ""),
    (r"!\[[^\]]*\]\([^)]*\)", ""),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"`[^`]*`", ""),
    (r"[*_]{1,3}", ""),
    (r"\s+", " "),
]


def strip_fences(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)```.*?```", "")


def fold_punctuation(text: Column) -> Column:
    return F.translate(text, "’‘—–", "''--")


def clean_line(line: Column) -> Column:
    for pattern, to in LINE_RULES:
        line = F.regexp_replace(line, pattern, to)
    return F.trim(line)


def clean_markdown(text: Column) -> Column:
    """Each line cleaned, code fences gone."""
    return F.array_join(F.transform(F.split(strip_fences(text), "\n"), clean_line), "\n")


# fixed values: the cleaning of whole texts for voices and for similes, in order
VOICE_RULES = [
    (r"(?m)^\s{0,3}#{1,6}\s+", ""),
    (r"(?m)^\s*>\s?", ""),
    (r"(?m)^\s*[-*+]\s+", ""),
    (r"!\[[^\]]*\]\([^)]*\)", ""),
    (r"\[([^\]]+)\]\([^)]*\)", "$1"),
    (r"[*_]{1,3}", ""),
]
SIMILE_RULES = [
    (r"(?s)```.*?```", ""),
    (r"`[^`]+`", ""),
    (r"!\[[^\]]*\]\([^\)]*\)", ""),
    (r"\[([^\]]+)\]\([^\)]*\)", "$1"),
]


def clean_for_voice(text: Column) -> Column:
    """Markdown marks of whole texts removed, inline code kept."""
    for pattern, to in VOICE_RULES:
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def clean_for_similes(text: Column) -> Column:
    for pattern, to in SIMILE_RULES:
        text = F.regexp_replace(text, pattern, to)
    return text


def paragraphs(text: Column, pattern: str = r"\n\s*\n+") -> Column:
    """Texts between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(text, pattern), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def sentences(text: Column) -> Column:
    """Texts up to an end mark before white space."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?])\s+", "$1\u0001"), "\u0001"), lambda s: F.trim(s) != "")


def letter_tokens(text: Column) -> Column:
    """Words of letters with an inner apostrophe, lower-cased, the apostrophe dropped."""
    found = F.regexp_extract_all(text, F.lit(r"[A-Za-z]+(?:'[A-Za-z]+)?"), F.lit(0))
    return F.transform(found, lambda t: F.lower(F.replace(t, F.lit("'"), F.lit(""))))


def tokens(text: Column) -> Column:
    """Letter tokens of two letters or more that no contraction left behind."""
    return F.filter(letter_tokens(text), lambda t: (F.length(t) >= 2) & ~t.isin(CONTRACTION_PARTS))


def _spaced(text: Column) -> Column:
    """Words and contraction parts between single spaces, lower-cased, without the marks between them."""
    parts = F.regexp_replace(F.lower(text), r"(n't|'(?:s|m|d|ll|re|ve))\b", " $1")
    return F.regexp_replace(parts, r"[\s.,;:!?\"()\[\]{}<>…“”«»—–/|]+", " ")


def burst_words(text: Column) -> Column:
    """Words of the burst windows: those of letters a-z alone."""
    return F.regexp_extract_all(F.concat(F.lit(" "), _spaced(text), F.lit(" ")), F.lit("(?<= )[a-z]+(?= )"), F.lit(0))


def entropy_tokens(text: Column) -> Column:
    """Tokens of the entropy windows: words and contraction parts, of which a-z and ' are kept if a letter is among them."""
    spaced = _spaced(text)
    own = F.split(F.regexp_replace(spaced, "[^a-z' ]+", ""), " ")  # whole texts are cleaned, not each token
    return F.filter(own, lambda t: F.translate(t, "'", "") != "")


def lines(text: Column) -> Column:
    """Structs line_number (from 1), line of the lines that aren't blank, stripped."""
    each = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x, i: F.struct((i + 1).alias("line_number"), F.regexp_replace(x, r"^\s+|\s+$", "").alias("line")))
    return F.filter(each, lambda x: x["line"] != "")


def content(own: Column) -> Column:
    return F.filter(own, lambda t: (F.length(t) >= 3) & ~t.isin(STOPWORDS))


def apostrophe_tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z']+"), F.lit(0)), F.lower)


def stripped_tokens(text: Column) -> Column:
    """White-space tokens without the marks around them, lower-cased."""
    marks = r"""^[.,;:!?"'()]+|[.,;:!?"'()]+$"""
    return F.filter(F.transform(F.split(text, r"\s+"), lambda t: F.lower(F.regexp_replace(t, marks, ""))), lambda t: t != "")


def concordance_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z'-]*"), F.lit(0))


def search_terms(text: Column) -> Column:
    """Distinct terms of over two characters."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9']+"), F.lit(0)), lambda t: F.length(t) > 2))


def ngrams(own: Column, n: int) -> Column:
    """Arrays of n neighbours; none if there are fewer."""
    empty = F.array().cast("array<array<string>>")
    return F.when(F.size(own) >= n, F.transform(F.sequence(F.lit(1), F.size(own) - n + 1), lambda i: F.slice(own, i, n))).otherwise(empty)


def phrases_in(text: Column, phrases: list[str]) -> Column:
    """The phrases that the lower-cased text holds, within words too."""
    return F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(F.lower(text), p))


def held(lower: Column, phrases: list[str]) -> Column:
    """How many of the phrases a lower-cased text holds, within words too; a text that is null holds none."""
    count = F.lit(0).cast("long")
    for p in phrases:
        count = count + F.coalesce(F.contains(lower, F.lit(p)).cast("long"), F.lit(0))
    return count


def words_held(lower: Column, words: list[str]) -> Column:
    """How many of the words (of letters a-z and apostrophes) are among a lower-cased text's white-space tokens without the marks around them.

    Marks are stripped from the whole text, not from each token.
    """
    bare = F.regexp_replace(lower, r"""[.,;:!?"'()]+(?!\S)|(?<!\S)[.,;:!?"'()]+""", "")
    return F.size(F.array_intersect(F.array(*map(F.lit, words)).cast("array<string>"), F.split(bare, r"\s+"))).cast("long")


def runs(own: Column) -> Column:
    """Struct n, clogc, vocabulary of an array's values: one fold over the sorted array instead of an exchange.

    clogc is the sum over distinct values of count * log2(count).
    """
    add = lambda s: s["clogc"] + s["run"] * F.log2(F.greatest(s["run"], F.lit(1.0)))
    zero = F.struct(F.lit(None).cast("string").alias("at"), F.lit(0.0).alias("run"), F.lit(0.0).alias("clogc"), F.lit(0).cast("long").alias("vocabulary"))

    def step(s: Column, x: Column) -> Column:
        same = s["at"].eqNullSafe(x)
        return F.struct(
            x.alias("at"),
            F.when(same, s["run"] + 1.0).otherwise(1.0).alias("run"),
            F.when(same, s["clogc"]).otherwise(add(s)).alias("clogc"),
            F.when(same, s["vocabulary"]).otherwise(s["vocabulary"] + 1).alias("vocabulary"),
        )

    done = F.aggregate(F.array_sort(own), zero, step, lambda s: F.struct(add(s).alias("clogc"), s["vocabulary"].alias("vocabulary")))
    return F.struct(F.size(own).cast("long").alias("n"), done["clogc"].alias("clogc"), done["vocabulary"].alias("vocabulary"))


def entropy(n: Column, clogc: Column) -> Column:
    """Shannon entropy in bits from a total and the sum of count * log2(count)."""
    return F.when(n > 0, F.log2(n.cast("double")) - clogc / n).otherwise(0.0)


def rounded(x: Column, places: int = 4) -> Column:
    """Rounded, with 0.0 for -0.0."""
    return F.round(x, places) + F.lit(0.0)


def year_of(stamp: Column) -> Column:
    """The year of an integer or of an ISO date."""
    return F.coalesce(stamp.try_cast("int"), F.year(F.try_to_timestamp(stamp)))


def clamp_score(x: Column, low: int = 0, high: int = 5) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(x.try_cast("int"), F.lit(0))))


def first_filled(*columns: Column) -> Column:
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def uuid5(namespace: Column, name: Column) -> Column:
    """Name-based UUID (SHA-1) from a namespace's 32 hex digits."""
    h = F.sha1(F.concat(F.unhex(namespace), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def _first_object(text: str | None) -> str | None:
    text = (text or "").strip()
    with contextlib.suppress(ValueError):
        json.loads(text)
        return text
    decoder, at = json.JSONDecoder(), text.find("{")
    while at >= 0:
        with contextlib.suppress(ValueError, RecursionError):
            return text[at : decoder.raw_decode(text, at)[1]]
        at = text.find("{", at + 1)
    return None


def json_in(text: Column) -> Column:
    """A text that is JSON, or else the first object in it that parses, whatever stands around it; null if there is none.

    A reply is a short text of its own, so this is the one function here that runs in Python, a batch at a time.
    """
    return F.pandas_udf(lambda s: s.map(_first_object), "string")(text)


def chat_url(url: Column) -> Column:
    """A server's address with the path of its chat completions."""
    base = F.regexp_replace(F.trim(url), r"/+$", "")
    return F.when(base.endswith("/chat/completions"), base).when(base.endswith("/v1"), F.concat(base, F.lit("/chat/completions"))).otherwise(F.concat(base, F.lit("/v1/chat/completions")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)
