"""Typography repair. The step order is part of the result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.nfc import nfc
from foliant.functions.text import LINE_SPACE, let, replace_matches, strip

# Digraphs that broken fonts leave half lower-case in all-caps words, and the
# characters that make up a word there.
DIGRAPHS = ["Ch", "Sh", "Yo", "Yu", "Ya", "Ts", "Ng"]
WORD_CLASS = r"\p{L}\p{M}‘’'ʼ`"
# Characters of no width, spaces that become the plain one, and what is stripped from
# a line beside it.
ZERO_WIDTH = "\u00ad\u200b\u200c\u200d\ufeff"
IRREGULAR = r"\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
SEPARATORS = "\x1c\x1d\x1e\x1f"


def _holds_any(c: Column, literals: str | list[str]) -> Column:
    found = F.lit(False)
    for literal in literals:
        found = found | F.contains(c, F.lit(literal))
    return found


def drop_zero_width(c: Column) -> Column:
    # Literals are looked for in the bytes; a pattern would decode and encode the text.
    def without(text: Column) -> Column:
        dropped = text
        for character in ZERO_WIDTH:
            dropped = F.replace(dropped, F.lit(character), F.lit(""))
        return F.when(_holds_any(text, ZERO_WIDTH), dropped).otherwise(text)

    return let(c, without)


def normalise_newlines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def normalise_spaces(c: Column) -> Column:
    # The class in front settles letters with two tests.
    return F.regexp_replace(c, rf"[\u00a0\u1680-\u3000&&[{IRREGULAR}]]", " ")


def join_hyphenation(c: Column, gap: str = r" \t") -> Column:
    # The hyphen leads the pattern, so letters are looked at only around one. The word after a
    # join is used up: a hyphen right behind it, at \G, does not join again.
    hyphen = r"-(?<=\p{L}-)(?<!\G-)"
    joined = rf"{hyphen}[{gap}]*\n[{gap}]*(\p{{L}}+)"
    return let(
        c,
        lambda text: F.when(
            F.contains(text, F.lit("-")) & F.contains(text, F.lit("\n")), F.regexp_replace(text, joined, "$1")
        ).otherwise(text),
    )


def unwrap_lines(c: Column) -> Column:
    single = r"\n(?<=[^\n]\n)(?=[^\n])"
    return let(
        c,
        lambda text: F.when(
            F.contains(text, F.lit("\n")), F.regexp_replace(text, single, " ")
        ).otherwise(text),
    )


def squeeze_lines(c: Column) -> Column:
    """Collapse whitespace runs within each line, then strip each line."""
    # One test settles letters: a run of several, or one that is no plain space.
    space = rf"[\t\x0b\x0c\r \x85\xa0\u1680-\u3000&&[ {LINE_SPACE}]]"
    # The common ones are literals.
    common = F.replace(F.replace(c, F.lit("\u00a0"), F.lit(" ")), F.lit("\t"), F.lit(" "))
    # The pattern tests a class at every character; most texts have nothing for it, which literals and
    # one range of wide characters tell. Every match is or holds what ``uncommon`` looks for.
    wide = rf"[\u1680-\u3000&&[{LINE_SPACE}]]"

    def uncommon(text: Column) -> Column:
        return _holds_any(text, ["  ", "\x0b", "\x0c", "\r", "\x85"]) | text.rlike(wide)

    runs = let(
        common,
        lambda text: F.when(
            uncommon(text), F.regexp_replace(text, rf"{space}(?:{space}+|(?<! ))", " ")
        ).otherwise(text),
    )

    def strip_lines(text: Column) -> Column:
        # Without separators a line has at most one space at either end.
        plain = F.replace(F.replace(text, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
        lines = F.transform(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(" " + SEPARATORS)))
        return F.when(_holds_any(text, SEPARATORS), F.array_join(lines, "\n")).otherwise(plain)

    return F.btrim(let(runs, strip_lines), F.lit(" " + SEPARATORS))


def fix_caps_digraphs(c: Column) -> Column:
    """Upper-case digraph tails in words that are all-caps once that is done."""
    # The word class but for lower-case letters.
    caps = r"[\p{Lu}\p{Lt}\p{Lm}\p{Lo}\p{M}‘’'ʼ`]"
    capitals, tails = ("".join(letters) for letters in zip(*DIGRAPHS))
    digraph = f"(?=[{capitals}])(?:" + "|".join(DIGRAPHS) + ")"
    # Found in nearly no text that has no such word: a digraph, and no lower-case letter after it.
    loose = rf"[{capitals}][{tails}](?<={'|'.join(DIGRAPHS)})(?!\p{{Ll}})"
    # A word of capitals and digraphs alone, with a digraph. It is tried at the start of words only
    # and its groups are possessive, so long words neither recurse nor cost more than their length.
    # The range in front settles most letters before anything else is looked at.
    broken_word = (
        rf"(?![a-z ])(?<![{WORD_CLASS}])(?:(?!{digraph}){caps})*+{digraph}(?:{digraph}|{caps})*+(?![{WORD_CLASS}])"
    )

    def repair(word: Column) -> Column:
        for pair in DIGRAPHS:
            word = F.replace(word, F.lit(pair), F.lit(pair.upper()))
        return word

    def by_words(text: Column) -> Column:
        return replace_matches(text, broken_word, repair)

    return let(
        c,
        lambda text: F.when(text.rlike(loose), by_words(text)).otherwise(text),
    )


def collapse_blank_lines(c: Column) -> Column:
    return let(
        c,
        lambda text: strip(F.when(
            F.contains(text, F.lit("\n\n\n")), F.regexp_replace(text, r"\n{3,}", "\n\n")
        ).otherwise(text)),
    )


def repair_typography(c: Column) -> Column:
    """Every step after NFC; free of UDFs, so it may run inside a lambda."""
    text = F.coalesce(c, F.lit(""))
    # ``normalise_spaces`` has no pass of its own: joins skip what it would replace, and
    # ``squeeze_lines`` replaces it.
    for step in (
        drop_zero_width,
        normalise_newlines,
        lambda joined: join_hyphenation(joined, r" \t" + IRREGULAR),
        unwrap_lines,
        squeeze_lines,
        fix_caps_digraphs,
        collapse_blank_lines,
    ):
        text = step(text)
    return text


def clean_text(c: Column) -> Column:
    return repair_typography(nfc(c))
