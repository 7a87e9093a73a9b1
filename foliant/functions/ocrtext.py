"""Repairs for recognised text and the page rules that decide what needs recognition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import count_in, is_blank, let, replace_matches, squeeze, strip

SPARSE_PAGE = 40
MIN_LETTER_RATIO = 0.5
MAX_REPLACEMENT_RATIO = 0.05
EDGE_LINES = 2

# Letters that look alike in both scripts, and what OCR reads as an apostrophe.
LATIN_LOOKALIKES = "aceopxyAEKMHOPCTXB"
CYRILLIC_LOOKALIKES = "асеорхуАЕКМНОРСТХВ"
APOSTROPHES = "'`ʻʼ’‘"
PAGE_NUMBER = r"(?U)\A[\s\-–—.·•|()\[\]]*\d{1,4}[\s\-–—.·•|()\[\]]*\z"


def is_garbled(c: Column) -> Column:
    """Too few letters or too many U+FFFD among the visible characters."""
    return let(
        F.struct(
            count_in(c, r"\S").cast("double").alias("visible"),
            count_in(c, r"\p{L}").alias("letters"),
            count_in(c, r"\ufffd").alias("replaced"),
        ),
        lambda n: F.when(n.visible == 0, False).otherwise(
            (n.letters < n.visible * MIN_LETTER_RATIO)
            | (n.replaced / F.nullif(n.visible, F.lit(0.0)) > MAX_REPLACEMENT_RATIO)
        ),
    )


def page_needs_ocr(text: Column, has_image: Column) -> Column:
    """The text layer is thin or junk and there is an image to read; unknown counts as one."""
    return let(
        strip(F.coalesce(text, F.lit(""))),
        lambda t: (F.length(t) < SPARSE_PAGE) | is_garbled(t),
    ) & F.coalesce(has_image, F.lit(True))


def fix_mixed_script_words(c: Column) -> Column:
    """Bring each word of both scripts into its majority script when every letter allows it."""
    cyr, lat = r"\p{IsCyrillic}", r"\p{IsLatin}"
    other = rf"[\p{{L}}&&[^{cyr}{lat}]]*"
    mixed = f"{cyr}{other}{lat}|{lat}{other}{cyr}"
    # A whole word up to the first letter of its second script, and the rest. Words of one script, which
    # are most, are never taken out.
    no_cyr, no_lat = rf"[\p{{L}}&&[^{cyr}]]", rf"[\p{{L}}&&[^{lat}]]"
    # The scripts have signs and marks too, which are no letters.
    c1, l1 = rf"[\p{{L}}&&{cyr}]", rf"[\p{{L}}&&{lat}]"
    word_of_both = rf"(?<!\p{{L}}){other}+(?:{l1}{no_cyr}*+{c1}|{c1}{no_lat}*+{l1})\p{{L}}*+"

    def repair(word: Column) -> Column:
        to_cyr = F.translate(word, LATIN_LOOKALIKES, CYRILLIC_LOOKALIKES)
        to_lat = F.translate(word, CYRILLIC_LOOKALIKES, LATIN_LOOKALIKES)
        cyr_wins = count_in(word, cyr) >= count_in(word, lat)
        whole = lambda fixed, rest: let(fixed, lambda w: F.when(w.rlike(rest), word).otherwise(w))
        return F.when(cyr_wins, whole(to_cyr, lat)).otherwise(whole(to_lat, cyr))

    return let(
        c, lambda text: F.when(text.rlike(mixed), replace_matches(text, word_of_both, repair)).otherwise(text)
    )


def normalise_apostrophes(c: Column) -> Column:
    """Between Latin letters: the turned comma after o and g, the modifier apostrophe elsewhere."""
    after_og = F.regexp_replace(c, rf"([oOgG])[{APOSTROPHES}](?=\p{{IsLatin}})", "$1‘")
    return F.regexp_replace(
        after_og, rf"([\p{{IsLatin}}&&[^oOgG]])[{APOSTROPHES}](?=\p{{IsLatin}})", "$1ʼ"
    )


def has_content(line: Column) -> Column:
    return line.rlike(r"[\p{L}\p{N}]")


def is_page_number(line: Column) -> Column:
    return strip(line).rlike(PAGE_NUMBER)


def normalise_line(line: Column) -> Column:
    """Letters and words only, digits as #, so that a header compares equal across pages."""
    digits = F.regexp_replace(F.lower(line), r"(?U)\d+", "#")
    return squeeze(F.regexp_replace(digits, r"(?U)[^\p{L}\p{N}#\s]+", " "))


def content_lines(text: Column) -> Column:
    """Lines of a page without scan noise: blank ones stay, the others need a letter or digit."""
    return F.filter(F.split(text, "\n"), lambda line: has_content(line) | is_blank(line))


def edge_candidates(text: Column) -> Column:
    """The outermost real line at each end of a page, normalised, once each."""

    def outermost(lines: Column) -> Column:
        ends = F.array(normalise_line(F.get(lines, F.lit(0))),
                       normalise_line(F.get(lines, F.size(lines) - 1)))
        return F.filter(F.array_distinct(ends), lambda line: line != "")

    real = F.filter(F.split(text, "\n"), lambda line: has_content(line) & ~is_page_number(line))
    return let(real, lambda lines: F.when(F.size(lines) > 0, outermost(lines)).otherwise(
        F.array().cast("array<string>")))


def peel_edges(text: Column, running: Column, edge_lines: int = EDGE_LINES) -> Column:
    """Drop page numbers and running lines from both ends, stopping at the first real line.

    ``running`` is the document's array of normalised running lines. Blank lines left at the
    ends go with the final strip, so the kept text is one slice between two real lines.
    """

    def furniture_length(edge: Column) -> Column:
        real = F.transform(
            edge,
            lambda line: ~(is_page_number(line) | F.array_contains(running, normalise_line(line))),
        )
        return let(
            real,
            lambda flags: F.when(F.array_contains(flags, True), F.array_position(flags, True) - 1)
            .otherwise(F.size(flags))
            .cast("int"),
        )

    def cut(state: Column) -> Column:
        head = F.slice(state.filled, 1, edge_lines)
        tail = F.slice(F.reverse(state.filled), 1, edge_lines)

        def keep(span: Column) -> Column:
            first = F.get(state.places, span.head)
            last = F.get(state.places, F.size(state.places) - 1 - span.tail)
            return F.when(
                span.head + span.tail < F.size(state.places),
                F.array_join(F.slice(state.lines, first + 1, last - first + 1), "\n"),
            ).otherwise("")

        return let(
            F.struct(
                furniture_length(head).alias("head"), furniture_length(tail).alias("tail")
            ),
            keep,
        )

    def with_places(lines: Column) -> Column:
        places = F.filter(
            F.sequence(F.lit(0), F.size(lines) - 1), lambda i: ~is_blank(F.get(lines, i))
        )
        filled = F.filter(lines, lambda line: ~is_blank(line))
        return let(
            F.struct(lines.alias("lines"), places.alias("places"), filled.alias("filled")), cut
        )

    lines = let(
        content_lines(text),
        lambda kept: F.when(F.size(kept) > 0, with_places(kept)).otherwise(""),
    )
    return strip(lines)


def clean_page(text: Column, running: Column) -> Column:
    """Noise lines, page edges, mixed-script words and apostrophes, in that order."""
    return strip(normalise_apostrophes(fix_mixed_script_words(peel_edges(text, running))))


def abbreviate(shown: Column, total: Column, limit: int = 30) -> Column:
    """``1, 2 … (+n)`` from the first pages, in order, and the number of all of them."""
    listed = F.array_join(F.transform(shown, lambda p: p.cast("string")), ", ")
    return F.when(
        total > limit, F.concat(listed, F.lit(" … (+"), (total - limit).cast("string"), F.lit(")"))
    ).otherwise(listed)
