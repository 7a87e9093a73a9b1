"""Shared text helpers whose rules follow Python's notion of whitespace and rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace within a line other than the space, as a class body. Listed, because Java tests a
# listed class far faster than its Unicode \s.
LINE_SPACE = r"\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# str.strip() also removes U+001C-U+001F, which the rules on whitespace runs leave alone.
STRIPPED = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, which may use it several times.

    Repeating a Column in an expression repeats its evaluation inside lambdas, where
    Spark does no common-subexpression elimination.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def is_ascii(c: Column) -> Column:
    """Whether every character takes one byte: bytes are counted, which is far cheaper than a pattern."""
    return F.length(c) == F.octet_length(c)


def replace_matches(c: Column, pattern: str, body: Callable[[Column], Column]) -> Column:
    """Replace every match of ``pattern``, which has no group and is never empty, by ``body`` of it.

    The text between the matches is never handed to a lambda word by word.
    """
    matches = F.transform(F.regexp_extract_all(c, F.lit(f"({pattern})"), F.lit(1)), body)
    # One piece more than there are matches.
    pieces = F.zip_with(
        F.split(c, pattern), matches, lambda between, match: F.concat(between, F.coalesce(match, F.lit("")))
    )
    return F.array_join(pieces, "")


def strip(c: Column) -> Column:
    # Looks at the ends only, where a pattern would be tried at every space of the text.
    return F.btrim(c, F.lit(STRIPPED))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def squeeze(c: Column) -> Column:
    """Whitespace runs, newlines included, become one space; the ends are stripped."""
    # Runs of several and what is no plain space: single spaces stay, and two tests settle letters.
    space = rf"[\t-\r\x1c- \x85\xa0\u1680-\u3000&&[ \n{LINE_SPACE}\x1c-\x1f]]"
    common = F.replace(F.replace(c, F.lit("\n"), F.lit(" ")), F.lit("\u00a0"), F.lit(" "))
    return strip(F.regexp_replace(common, rf"{space}(?:{space}+|(?<! ))", " "))


def count_in(c: Column, char_class: str) -> Column:
    """Number of characters of ``c`` that fall in ``char_class`` (written without brackets)."""
    return F.length(F.regexp_replace(c, f"(?U)[^{char_class}]+", ""))


def round_exact(c: Column, digits: int) -> Column:
    """Round the exact binary value half-even, as Python's ``round(x, digits)`` does.

    ``bround`` rounds the shortest decimal text of a double instead: 50.45 is stored as
    50.4500000000000028 and must become 50.5, where ``bround`` gives 50.4.
    """
    return F.regexp_replace(F.format_number(c, digits), ",", "").cast("double")


def percent(part: Column, total: Column) -> Column:
    """Whole percent, half-even, 0 for an empty total."""
    share = part.cast("double") / F.nullif(total.cast("double"), F.lit(0.0)) * 100
    return F.coalesce(F.rint(share), F.lit(0.0)).cast("int")


def icontains(columns: list[Column], needle: str) -> Column:
    """Case-insensitive literal substring in any of the columns; NULL never matches."""
    condition = F.lit(False)
    for c in columns:
        condition = condition | F.coalesce(
            F.contains(F.upper(c), F.upper(F.lit(needle))), F.lit(False)
        )
    return condition


def shorten(c: Column, limit: int = 140) -> Column:
    return F.when(
        F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))
    ).otherwise(c)
