"""Pieces of DuckDB SQL that the oracles share."""

from quillmill.functions import lexicons as lx


def words(values: list[str]) -> str:
    """A list of string literals."""
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


LETTERS = "list_transform(regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)?'), lambda x: lower(replace(x, '''', '')))"
TOKENS = f"list_filter({LETTERS}, lambda x: length(x) >= 2 AND x NOT IN ({words(lx.CONTRACTION_PARTS)}))"
CONTENT = f"list_filter({TOKENS}, lambda x: length(x) >= 3 AND x NOT IN ({words(lx.STOPWORDS)}))"
_PARTS = "regexp_replace(lower(text), '(n''t|''(?:s|m|d|ll|re|ve))\\b', ' \\1', 'g')"
_SPACED = f"""regexp_split_to_array({_PARTS}, '[\\s.,;:!?"()\\[\\]{{}}<>…“”«»—–/|]+')"""
BURST_WORDS = f"list_filter({_SPACED}, lambda t: regexp_full_match(t, '[a-z]+'))"
ENTROPY = f"""list_filter(list_transform({_SPACED}, lambda t: regexp_replace(t, '[^a-z'']', '', 'g')), lambda t: regexp_matches(t, '[a-z]'))"""
APOSTROPHE = "list_transform(regexp_extract_all(text, '[A-Za-z'']+'), lambda x: lower(x))"


def tokens(name: str, own: str, source: str = "SELECT source AS manuscript_id, doc_id, text FROM documents") -> str:
    """A CTE (manuscript_id, doc_id, pos, token) of an expression over ``text``."""
    return f"""{name} AS (
        SELECT manuscript_id, doc_id, unnest(own) AS token, unnest(range(0, len(own))) AS pos
        FROM (SELECT manuscript_id, doc_id, {own} AS own FROM ({source})))"""
