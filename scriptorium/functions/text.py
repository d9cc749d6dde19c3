"""Column expressions for text: every one stays inside the row, so none of them shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\n\r\x0b\x0c"
LINE_BREAK = "\\r\\n|[\\n\\r\\u000B\\u000C\\u0085\\u2028\\u2029]"
UNUSUAL_BREAK = "[\\r\\u000B\\u000C\\u0085\\u2028\\u2029]"
MARK = "␞"
DOT = "․"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    Catalyst may inline a projected column into a lambda and evaluate it per element;
    a lambda variable is always evaluated once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def squash(c: Column | str) -> Column:
    """Whitespace runs to one space, ends trimmed."""
    return strip(F.regexp_replace(col(c), "\\s+", " "))


def lines(c: Column | str) -> Column:
    """Text to lines; a final line break does not start another line, empty text has no line.

    Plain ``\n`` text, the usual case, is cut by one literal character without a regular
    expression; other line ends take the general way.
    """
    c = col(c)
    plain = F.split(F.when(c.endswith("\n"), F.left(c, F.length(c) - 1)).otherwise(c), "\n")
    other = F.split(F.regexp_replace(c, f"(?:{LINE_BREAK})\\z", ""), LINE_BREAK)
    return F.when(c == "", F.array().cast("array<string>")).when(c.rlike(UNUSUAL_BREAK), other).otherwise(plain)


def words(c: Column | str) -> Column:
    return F.filter(F.split(strip(c), "\\s+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return let(strip(c), lambda s: F.when(s == "", 0).otherwise(F.size(F.split(s, "\\s+"))))


def count_of(c: Column, literal: str) -> Column:
    """How often a literal occurs."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(literal), F.lit("")))) / len(literal)).cast("int")


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def round_half_up(c: Column | str, digits: int) -> Column:
    """Round a non-negative double on its binary value, not on its shortest decimal form."""
    scale = F.lit(10.0**digits)
    return F.floor(col(c) * scale + 0.5) / scale


def any_of(conditions: list[Column]) -> Column:
    out = conditions[0]
    for cond in conditions[1:]:
        out = out | cond
    return out


def keep_lines(c: Column | str, keep: Callable[[Column], Column]) -> Column:
    return F.array_join(F.filter(lines(c), keep), "\n")


def index_of(xs: Column) -> Column:
    """0-based positions of an array, none for an empty one."""
    return F.when(F.size(xs) > 0, F.sequence(F.lit(0), F.size(xs) - 1)).otherwise(
        F.array().cast("array<int>"))


def segments(items: Column, starts_here: Callable[[Column, Column], Column]) -> Column:
    """Cut an array into runs; a run begins at 0 and wherever ``starts_here(xs, i)`` holds.

    Result: array<struct<first:int, items:array>>, in order.
    """

    def cut(xs: Column) -> Column:
        def slices(starts: Column) -> Column:
            return F.transform(
                starts,
                lambda s, j: F.struct(
                    s.alias("first"),
                    F.slice(xs, s + 1, F.coalesce(F.get(starts, j + 1), F.size(xs)) - s).alias("items"),
                ),
            )

        return let(F.filter(index_of(xs), lambda i: (i == 0) | starts_here(xs, i)), slices)

    return let(items, cut)


def split_sentences(c: Column | str) -> Column:
    """Cut after ``.``, ``!`` or ``?`` followed by whitespace."""
    return F.split(col(c), "(?<=[.!?])\\s+")


def protect_abbreviations(c: Column) -> Column:
    """Hide the dots that do not end a sentence behind a stand-in character."""
    rules = [
        ("(?iU)\\b(Figs?|Eqs?|Refs?|Tab|Table)\\.(\\s+\\d+)", f"$1{DOT}$2"),
        ("(?iU)\\b(et al|vs|cf|ca|i\\.e|e\\.g|Dr|Mr|Mrs|Ms|Prof)\\.", f"$1{DOT}"),
        (f"(?iU)\\b([ie])\\.([eg]){DOT}", f"$1{DOT}$2{DOT}"),
        ("([a-zA-Z])\\.([a-zA-Z])\\.", f"$1{DOT}$2{DOT}"),
    ]
    for pattern, repl in rules:
        c = F.regexp_replace(c, pattern, repl)
    return c


def restore_abbreviations(c: Column) -> Column:
    return F.replace(c, F.lit(DOT), F.lit("."))


TERMINAL = "[.!?][)\\]\"'}›»]*$"


def is_valid_sentence(c: Column, min_words: int) -> Column:
    return (word_count(c) >= min_words) & c.rlike(TERMINAL)


def split_sentences_safe(c: Column | str, min_words: int) -> Column:
    """Abbreviation-safe sentences of at least ``min_words`` words that end properly."""
    t = F.regexp_replace(col(c), "[ \\t]+", " ")
    t = F.regexp_replace(t, "\\r\\n|\\r", "\n")
    t = F.regexp_replace(t, "\\n{3,}", "\n\n")
    t = protect_abbreviations(t)
    t = F.regexp_replace(t, "\\s*([.!?])\\s+(?=[A-Z])", f"$1{MARK}")
    t = F.regexp_replace(t, "([.!?]\\s*[)\\]\"'}›»]*)\\s*\\n\\s*", f"$1{MARK}")
    parts = F.transform(
        F.split(t, MARK),
        lambda s: F.regexp_replace(restore_abbreviations(strip(s)), " +", " "),
    )
    return F.filter(parts, lambda s: is_valid_sentence(s, min_words))


def token_set(c: Column | str, min_len: int = 4) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) >= min_len))


def match_form(c: Column | str) -> Column:
    """Lower case, hyphen to space, only ``a-z``, digits and whitespace kept."""
    return F.regexp_replace(F.replace(F.lower(col(c)), F.lit("-"), F.lit(" ")), "[^a-z0-9\\s]+", "")
