"""Column helpers for text: white space, byte lengths, lines and tokens."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ``\s`` of the boundary patterns: tab, newline, form feed, return, space.
PATTERN_SPACE = r"[\t\n\f\r ]"
# ASCII first: most characters are decided without a Unicode property lookup.
TOKEN_PATTERN = r"[a-z0-9_\p{L}\p{N}]++"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    A plain reference could be inlined by the optimizer and then be evaluated
    for every element of a higher-order function; a lambda variable cannot.
    """
    return F.transform(F.array(value), body)[0]


def is_blank(text: Column) -> Column:
    """True if the text holds nothing but Unicode white space."""
    return ~F.rlike(text, F.lit(r"\P{IsWhite_Space}"))


def trim_space(text: Column) -> Column:
    """Strip Unicode white space from both ends."""
    return F.regexp_replace(
        text, r"\A\p{IsWhite_Space}++|(?<!\p{IsWhite_Space})\p{IsWhite_Space}++\z", ""
    )


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def join_lines(lines: Column, first: Column, last: Column) -> Column:
    """Lines ``first``..``last`` (1-based, inclusive) as one string."""
    return F.array_join(F.slice(lines, first, last - first + 1), "\n")


def tokens_of(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def truncate_bytes(text: Column, limit: int) -> Column:
    """At most ``limit`` bytes of UTF-8, cut on a character boundary."""
    raw = F.encode(text, "UTF-8")
    head = F.substring(raw, 1, limit)
    # A cut inside a character leaves a lead byte with too few followers.
    pattern = r"(?:[C-D][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-7](?:[89AB][0-9A-F]){0,2})$"
    whole = F.unhex(F.regexp_replace(F.hex(head), f"^((?:[0-9A-F]{{2}})*?){pattern}", "$1"))
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(whole, "UTF-8"))
