"""SQL text fragments shared by the checks (DuckDB dialect, RE2 patterns)."""

from __future__ import annotations

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def squash(x: str) -> str:
    return strip(rf"regexp_replace({x}, '\s+', ' ', 'g')")


def lines(x: str) -> str:
    return rf"(CASE WHEN {x} = '' THEN []::VARCHAR[] ELSE string_split(regexp_replace({x}, '\n\z', ''), chr(10)) END)"


def words(x: str) -> str:
    return rf"[w FOR w IN regexp_split_to_array({strip(x)}, '\s+') IF w <> '']"


def n_words(x: str) -> str:
    return f"len({words(x)})"


def keep_lines(x: str, cond: str) -> str:
    """Lines ``l`` of x that satisfy ``cond``, joined again."""
    return f"array_to_string([l FOR l IN {lines(x)} IF {cond}], chr(10))"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern.replace(chr(39), chr(39) * 2)}')"


def bounded(alternatives: str) -> str:
    """``\\b(alternatives)\\b`` with Unicode word characters, for an existence test."""
    return f"(^|{NOT_WORD})({alternatives})($|{NOT_WORD})"


def count(x: str, pattern: str) -> str:
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def marked_sentences(x: str) -> str:
    """Cut after ``.!?`` plus whitespace; RE2 has no look-behind, so a mark is set first."""
    return rf"string_split(regexp_replace({x}, '([.!?])\s+', '\1␞', 'g'), '␞')"


def sentences(x: str) -> str:
    return f"[y FOR y IN [{strip('z')} FOR z IN {marked_sentences(x)}] IF y <> '']"
