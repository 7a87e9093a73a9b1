"""Citation segments, source markers and Markdown parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import let, strip

MARKER_INTERVAL = 600
NEWLINE_LOOKAHEAD = 150
SPACE_LOOKAHEAD = 100
# Length of what a marker begins with.
MARKER_HEAD = len("[MANBA: ")
MARKER_PATTERN = r"\[MANBA: ([^\]]*)\]"


def split_for_grounding(
    c: Column,
    interval: int = MARKER_INTERVAL,
    newline: int = NEWLINE_LOOKAHEAD,
    space: int = SPACE_LOOKAHEAD,
) -> Column:
    """Segments of about ``interval`` characters, cut at a close newline, else a close space.

    One pattern states the cut: the interval, then up to the next newline if it is near, else
    up to the next space if that is near, else nothing; the rest of the text comes last.
    """
    to_newline = rf"[^\n]{{0,{newline - 1}}}(?=\n)"
    to_space = rf"[^ ]{{0,{space - 1}}}(?= )"
    pattern = rf"(?s)(.{{{interval}}}(?:{to_newline}|{to_space}|)|.{{1,{interval - 1}}})"
    # Text up to the interval is not cut.
    raw = let(
        c,
        lambda text: F.when(F.length(text) <= interval, F.array(text)).otherwise(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        ),
    )
    return F.filter(F.transform(raw, strip), lambda s: s != "")


def marker_field(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"[|\]\r\n]+", " "))


def marker_of(*fields: Column) -> Column:
    """The marker of four values that are fields already."""
    return F.concat(F.lit("[MANBA: "), F.concat_ws(" | ", *fields), F.lit("]"))


def build_marker(filename: Column, label: Column, topic: Column, kind: Column) -> Column:
    return marker_of(*[marker_field(p) for p in (filename, label, topic, kind)])


def yaml_string(c: Column) -> Column:
    escaped = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.regexp_replace(escaped, r"[\r\n\t]+", " "), F.lit('"'))


def path_segment(c: Column) -> Column:
    safe = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "-"), r"\A[.-]+", "")
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit("unknown"))


def name_slug(filename: Column) -> Column:
    """The edges are stripped before the cut to 40, so a slug may end in an underscore."""
    base = F.regexp_replace(F.lower(filename), r"\.[a-z0-9]+(?=\n?\z)", "")
    slug = F.regexp_replace(F.regexp_replace(base, r"[^a-z0-9]+", "_"), r"\A_+|_+\z", "")
    return F.coalesce(F.nullif(F.substring(slug, 1, 40), F.lit("")), F.lit("document"))


def markdown_filename(topic: Column, kind: Column, filename: Column, material_id: Column) -> Column:
    fingerprint = F.substring(F.sha2(material_id.cast("string"), 256), 1, 10)
    return F.concat(
        path_segment(topic), F.lit("__"), path_segment(kind), F.lit("__"),
        name_slug(filename), F.lit("-"), fingerprint, F.lit(".md"),
    )


def markdown_path(
    module: Column, topic: Column, kind: Column, filename: Column, material_id: Column
) -> Column:
    return F.concat_ws(
        "/", path_segment(module), markdown_filename(topic, kind, filename, material_id)
    )


def frontmatter(meta: dict[str, Column], chunks: Column) -> Column:
    """The YAML head. ``meta`` holds the seven text fields by their YAML name, in order."""
    fields = [F.concat(F.lit(f"{name}: "), yaml_string(value)) for name, value in meta.items()]
    count = F.concat(F.lit("chunks: "), chunks.cast("string"))
    return F.concat_ws("\n", F.lit("---"), *fields, count, F.lit("---"), F.lit(""))


def section_block(label: Column, marker: Column, segments: Column) -> Column:
    """Heading, marker and segments of one section; every further segment repeats the marker."""
    between = F.concat(F.lit("\n\n"), marker, F.lit("\n\n"))
    further = F.transform(
        F.slice(segments, F.lit(2), F.size(segments)), lambda s: F.concat(between, s)
    )
    body = F.concat(F.lit("\n"), F.get(segments, F.lit(0)), F.array_join(further, ""))
    return F.concat(
        F.lit("\n## "), F.upper(label), F.lit("\n\n"), marker, F.lit("\n"),
        F.coalesce(body, F.lit("")), F.lit("\n"),
    )


def marker_count(segments: Column) -> Column:
    return F.greatest(F.size(segments), F.lit(1))


def markers_of(markdown: Column) -> Column:
    """``array<struct<file,label,topic,kind>>`` of the markers, in text order."""
    bodies = F.regexp_extract_all(markdown, F.lit(MARKER_PATTERN), F.lit(1))
    return F.transform(
        bodies,
        lambda body: let(
            F.split(body, r" \| "),
            lambda p: F.struct(
                F.get(p, F.lit(0)).alias("file"), F.get(p, F.lit(1)).alias("label"),
                F.get(p, F.lit(2)).alias("topic"), F.get(p, F.lit(3)).alias("kind"),
            ),
        ),
    )


def largest_gap(markdown: Column) -> Column:
    """Most characters between two markers, or between a marker and an end of the text."""
    return F.array_max(F.transform(F.split(markdown, MARKER_PATTERN), F.length))


def piece_lengths(markdown: Column) -> Column:
    """Characters before the first marker, between markers, and after the last one.

    A marker begins after each of them but the last, ``MARKER_HEAD`` characters further on.
    """
    return F.transform(F.split(markdown, r"\[MANBA: "), F.length)


def windows_hit(lengths: Column, before: Column, window: int) -> Column:
    """``struct<first,last,covered>`` of the windows in which a marker begins, in one walk.

    ``lengths`` are ``piece_lengths`` of a part that ``before`` characters of the document precede;
    without a marker first and last are -1.
    """
    start = F.struct(
        before.cast("long").alias("at"), F.lit(-1).cast("long").alias("first"), F.lit(-1).cast("long").alias("last"),
        F.lit(0).cast("long").alias("covered"),
    )

    def step(state: Column, length: Column) -> Column:
        at = state["at"] + length
        here = F.floor(at / window)
        return F.struct(
            (at + MARKER_HEAD).alias("at"), F.when(state["first"] < 0, here).otherwise(state["first"]).alias("first"),
            here.alias("last"), (state["covered"] + F.when(here != state["last"], 1).otherwise(0)).alias("covered"),
        )

    begins = F.slice(lengths, F.lit(1), F.greatest(F.size(lengths) - 1, F.lit(0)))
    return F.aggregate(begins, start, step, lambda s: F.struct(s["first"], s["last"], s["covered"]))


def window_coverage(markdown: Column, window: int) -> Column:
    """``struct<windows,covered>``: fixed-size windows, and those in which a marker begins."""
    windows = F.ceil(F.length(markdown) / F.lit(window)).cast("int")
    hit = windows_hit(piece_lengths(markdown), F.lit(0), window)
    return F.struct(windows.alias("windows"), hit["covered"].cast("int").alias("covered"))
