"""Cutting text into labelled sections, and assembling pages and slides from their pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import let, round_exact, squeeze, strip
from foliant.functions.typography import normalise_newlines
from foliant.operators.rows import each


def _kept(pieces: Column, prefix: str) -> Column:
    """Strip, drop blanks, and number over the kept pieces only."""
    texts = F.filter(F.transform(pieces, strip), lambda t: t != "")
    return F.transform(
        texts,
        lambda t, i: F.struct(
            F.concat(F.lit(prefix + " "), (i + 1).cast("string")).alias("label"), t.alias("text")
        ),
    )


def parts_of(c: Column) -> Column:
    """``array<struct<label,text>>`` of plain text, cut at three or more newlines."""
    return _kept(F.split(normalise_newlines(c), r"\n{3,}"), "part")


def markdown_sections_of(c: Column) -> Column:
    """The same for Markdown, cut before headings of level one to three."""
    # A lookbehind instead of (?m)^, which Java also lets match after other line ends.
    heading = r"(?U)(?<![^\n])(?=#{1,3}[\s\x1c-\x1f])"
    return _kept(F.split(c, heading), "section")


def explode_sections(df: DataFrame, sections: Column, keys: list[str]) -> DataFrame:
    """One row per section: ``ord`` from 1, ``label`` and ``text``."""
    return each(df, keys, sections, "_pos", "_section").select(
        *keys,
        (F.col("_pos") + 1).alias("ord"),
        F.col("_section.label").alias("label"),
        F.col("_section.text").alias("text"),
    )


def page_sections(pages: DataFrame) -> DataFrame:
    """Pages as sections: blank ones are left out, the others keep their physical number."""
    text = strip(F.coalesce(F.col("text"), F.lit("")))
    return (
        pages.select("doc_id", F.col("page_no").alias("ord"), text.alias("text"))
        .where(F.col("text") != "")
        .withColumn("label", F.concat(F.lit("page "), F.col("ord").cast("string")))
    )


def doc_totals(sections: DataFrame, keys: list[str]) -> DataFrame:
    return sections.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.sum(F.length("text")).cast("long").alias("total_chars"),
    )


def assemble_pages(words: DataFrame) -> DataFrame:
    """Page text and mean confidence from recogniser words, in row order.

    A new block or paragraph number opens a paragraph and a new line number a line, by
    comparison with the word before. Only word rows (level 5) with visible text count. The
    page is one text cell, so its words fit where the cell fits.
    """
    rows = words.where(F.col("level") == 5).withColumn("text", strip(F.col("text"))).where(
        F.col("text") != ""
    )
    conf = F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0))

    def glued(ordered: Column) -> Column:
        def piece(word: Column, at: Column) -> Column:
            def after(before: Column) -> Column:
                same_block = (before["block"] == word["block"]) & (before["par"] == word["par"])
                return (
                    F.when(at == 0, "")
                    .when(~same_block, "\n\n")
                    .when(before["line"] != word["line"], "\n")
                    .otherwise(" ")
                )

            return F.concat(let(F.get(ordered, at - 1), after), word["text"])

        return F.array_join(F.transform(ordered, piece), "")

    # One list per column takes half the room of a list of rows, in memory and in the shuffle. Lists leave
    # out NULL, so it travels as the least number; all lists of a page are in the same order.
    fields = ["row_no", "block", "par", "line", "text"]
    least = {"bigint": -(2**63), "int": -(2**31), "smallint": -(2**15), "tinyint": -(2**7)}
    types = dict(rows.dtypes)

    def listed(name: str) -> Column:
        if types[name] not in least:
            return F.collect_list(name)
        return F.collect_list(F.coalesce(name, F.lit(least[types[name]]).cast(types[name])))

    def known(word: Column, name: str) -> Column:
        if types[name] not in least:
            return word[name].alias(name)
        return F.nullif(word[name], F.lit(least[types[name]]).cast(types[name])).alias(name)

    gathered = rows.groupBy("doc_id", F.col("page").alias("page_no")).agg(
        *[listed(name).alias(name) for name in fields],
        F.avg(F.when(conf >= 0, conf)).alias("_mean"),
    )
    # The order is needed per page only, so the words are sorted in their page's array.
    words = F.transform(F.arrays_zip(*fields), lambda word: F.struct(*[known(word, name) for name in fields]))
    gathered = gathered.withColumn("_words", F.array_sort(words))
    return gathered.select(
        "doc_id", "page_no",
        let(F.col("_words"), glued).alias("text"),
        round_exact(F.coalesce("_mean", F.lit(0.0)), 1).alias("confidence"),
    )


def page_confidence(words: DataFrame) -> DataFrame:
    """Mean of the known confidences of the visible words; needs no order, so no window."""
    conf = F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0))
    rows = words.where((F.col("level") == 5) & (strip(F.col("text")) != ""))
    return rows.groupBy("doc_id", F.col("page").alias("page_no")).agg(
        round_exact(F.coalesce(F.avg(F.when(conf >= 0, conf)), F.lit(0.0)), 1).alias("confidence"),
        F.count(F.lit(1)).alias("words"),
    )


def assemble_slides(elements: DataFrame) -> DataFrame:
    """Slide text from its elements; empty slides are left out, the others keep their number.

    ``kind`` is ``paragraph``, ``cell`` (with ``row``, joined per table row) or ``note``.
    """
    body = elements.where(F.col("kind") != "note").withColumn("text", strip(F.col("text")))
    lines = (
        body.where(F.col("text") != "")
        .groupBy("doc_id", "slide", "row")
        .agg(
            F.min("ord").alias("ord"),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))),
                            lambda e: e["text"]),
                " | ",
            ).alias("text"),
            F.lit("line").alias("kind"),
        )
    )
    notes = elements.where(F.col("kind") == "note").select(
        "doc_id", "slide", "row", "ord", "text", F.lit("note").alias("kind")
    )

    def ordered(kind: str, glue: str) -> Column:
        mine = F.collect_list(F.when(F.col("kind") == kind, F.struct("ord", "text")))
        return F.array_join(F.transform(F.array_sort(mine), lambda e: e["text"]), glue)

    slides = (
        lines.unionByName(notes).groupBy("doc_id", "slide")
        .agg(ordered("line", "\n").alias("body"), ordered("note", "\n").alias("notes"))
        .withColumn("notes", squeeze(F.col("notes")))
    )
    note = F.when(
        F.col("notes") != "", F.concat(F.lit("\n\n[Presenter Notes: "), "notes", F.lit("]"))
    ).otherwise("")
    return (
        slides.select("doc_id", "slide", strip(F.concat("body", note)).alias("text"))
        .where(F.col("text") != "")
        .withColumn("label", F.concat(F.lit("slide "), F.col("slide").cast("string")))
    )
