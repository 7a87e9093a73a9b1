"""Grounded Markdown: assembly, citations, coverage, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import grounding
from foliant.functions.script import GATHERED_SAMPLE
from foliant.operators.ordering import bucket_of, number_rows, total_before
from foliant.operators.rows import each

# Sections of one document written into one Markdown cell. Shorter documents are one part;
# the parts of a longer one concatenate to its whole Markdown.
SECTIONS_PER_PART = 1024
# Sections per bucket when the head of a document is looked for.
SAMPLE_BUCKET = 256

META = ["module_code", "module_name", "topic_code", "topic_name", "type", "original_filename"]


def segment_rows(sections: DataFrame, marker: Column, keys: list[str]) -> DataFrame:
    """One row per citation segment: ``ord`` of the section, ``segment_no``, marker, text."""
    segments = grounding.split_for_grounding(F.col("text"))
    columns = [*keys, "ord", marker.alias("marker")]
    return each(sections, columns, segments, "_pos", "segment").select(*keys, "ord", (F.col("_pos") + 1).alias("segment_no"), "marker", "segment")


def document_facts(sections: DataFrame, size: int = GATHERED_SAMPLE) -> DataFrame:
    """Per document: number of chunks, first and last position, and its script sample.

    ``sections`` is ``(doc_id, ord, text)`` with text that is not blank. The sample is the
    leading sections joined by a space, cut at ``size``. Sections are counted and measured per
    bucket; only the buckets that reach into the sample are then ordered, and of those fewer
    than ``size / 2`` sections, clipped to it, are gathered.
    """
    cut = sections.select("doc_id", "ord", "text").withColumn(
        "_bucket", bucket_of("ord", SAMPLE_BUCKET)
    )
    measured = cut.groupBy("doc_id", "_bucket").agg(
        F.sum(F.length("text") + 1).alias("_size"),
        F.count(F.lit(1)).alias("_n"),
        F.min("ord").alias("_first"),
        F.max("ord").alias("_last"),
    )
    whole = Window.partitionBy("doc_id")
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = measured.select(
        "doc_id", "_bucket",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("chunk_count"),
        F.min("_first").over(whole).alias("first_ord"),
        F.max("_last").over(whole).alias("last_ord"),
    ).where(F.col("_before") < size)

    within = Window.partitionBy("doc_id", "_bucket").orderBy("ord").rowsBetween(
        Window.unboundedPreceding, -1
    )
    leading = (
        cut.select(
            "doc_id", "_bucket", "ord", F.length("text").alias("_size"),
            F.substring("text", 1, size).alias("text"),
        )
        .join(heads, ["doc_id", "_bucket"])
        .withColumn("_at", F.coalesce(F.sum(F.col("_size") + 1).over(within), F.lit(0)))
        .where(F.col("_at") + F.col("_before") < size)
    )
    ordered = F.array_sort(F.collect_list(F.struct("ord", "text")))
    return leading.groupBy("doc_id", "chunk_count", "first_ord", "last_ord").agg(
        F.substring(F.array_join(F.transform(ordered, lambda s: s["text"]), " "), 1, size)
        .alias("sample")
    )


def with_facts(sections: DataFrame, facts: DataFrame) -> DataFrame:
    """Join one row per document (with ``last_ord``) to its sections, part by part.

    The document's row is repeated once per part, so no join key covers a whole book.
    """
    last = F.floor(F.col("last_ord") / SECTIONS_PER_PART).cast("long")
    per_part = facts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    part = F.floor(F.col("ord") / SECTIONS_PER_PART).cast("long")
    return sections.withColumn("part", part).join(per_part, ["doc_id", "part"])


# What is the same for all sections of a part.
_DOCUMENT = ["doc_id", "part", "script", "chunk_count", "first_ord", *META]


def _blocks(sections: DataFrame) -> DataFrame:
    """``_block`` and ``_markers`` of every section, beside its ``ord`` and ``_DOCUMENT``."""
    marker = grounding.build_marker(
        F.col("original_filename"), F.col("label"), F.col("topic_code"), F.col("type")
    )
    return sections.withColumn(
        "_segments", grounding.split_for_grounding(F.col("text"))
    ).select(
        *_DOCUMENT, "ord",
        grounding.section_block(F.col("label"), marker, F.col("_segments")).alias("_block"),
        grounding.marker_count(F.col("_segments")).alias("_markers"),
    )


def _head() -> Column:
    """The YAML head of a part: only the first one of a document has it."""
    head = grounding.frontmatter(
        {
            "module_id": F.col("module_code"),
            "module_name": F.col("module_name"),
            "topic_id": F.col("topic_code"),
            "topic_name": F.col("topic_name"),
            "type": F.col("type"),
            "source": F.col("original_filename"),
            "script": F.col("script"),
        },
        F.col("chunk_count"),
    )
    first = F.col("part") == F.floor(F.col("first_ord") / SECTIONS_PER_PART)
    return F.when(first, head).otherwise("")


def _path() -> Column:
    return grounding.markdown_path(
        F.col("module_code"), F.col("topic_code"), F.col("type"), F.col("original_filename"), F.col("doc_id")
    )


def assemble(sections: DataFrame) -> DataFrame:
    """Grounded Markdown of documents given as section rows, in parts of bounded size.

    ``sections`` is ``(doc_id, part, ord, label, text)`` with finished text, ``META``,
    ``script``, ``chunk_count`` and ``first_ord``. Each (document, part) is one group, so a
    long document is assembled by many tasks.
    """
    ordered = F.array_sort(F.collect_list(F.struct("ord", "_block")))
    # Every block is preceded by a newline: the head ends where the first block begins.
    body = F.array_join(F.transform(ordered, lambda b: F.concat(F.lit("\n"), b["_block"])), "")
    grouped = _blocks(sections).groupBy(*_DOCUMENT).agg(
        body.alias("_body"), F.sum("_markers").cast("long").alias("marker_count")
    )
    return grouped.select(
        "doc_id", "part", "script", "chunk_count", "marker_count", _path().alias("md_path"),
        F.concat(_head(), "_body").alias("markdown"),
    ).withColumn("char_count", F.length("markdown"))


def totals(sections: DataFrame) -> DataFrame:
    """Counts of the whole documents that ``assemble`` makes of the same ``sections``.

    A block is measured where it is made, so no text is shuffled or gathered for them.
    """
    measured = _blocks(sections).groupBy(*_DOCUMENT).agg(
        F.sum(F.length("_block") + 1).alias("_body"), F.sum("_markers").alias("_markers")
    )
    return measured.withColumn("_size", F.length(_head()) + F.col("_body")).groupBy(
        "doc_id", _path().alias("md_path"), "script", "chunk_count"
    ).agg(
        F.sum("_markers").alias("marker_count"), F.sum("_size").alias("char_count"),
        F.count(F.lit(1)).alias("parts"),
    )


def citations(markdown: DataFrame, keys: list[str]) -> DataFrame:
    """Markers of the Markdown as rows, in order: the inverse of the marker builder."""
    markers = grounding.markers_of(F.col("markdown"))
    return each(markdown, keys, markers, "_pos", "_m").select(*keys, (F.col("_pos") + 1).alias("marker_no"), "_m.*")


def coverage(markdown: DataFrame, keys: list[str], window: int = 1000) -> DataFrame:
    """How densely markers cover the text that a consumer would cut into windows."""
    return markdown.select(
        *keys,
        F.size(grounding.markers_of(F.col("markdown"))).alias("markers"),
        grounding.largest_gap(F.col("markdown")).alias("largest_gap"),
        grounding.window_coverage(F.col("markdown"), window).alias("_w"),
    ).select(*keys, "markers", "largest_gap", "_w.windows", "_w.covered")


def document_coverage(parts: DataFrame, doc: str, part: str, window: int = 1000) -> DataFrame:
    """``coverage`` of documents that come in parts, as if each were one text.

    Windows and gaps that reach across parts count as what they are in the whole document. The text
    is read once and reduced to the lengths between its markers; those are what is shuffled. Offsets of
    parts are running totals by blocks, and what is gathered per document is one small row per part.
    Parts must not cut a marker in two.
    """
    gaps = F.transform(F.split("markdown", grounding.MARKER_PATTERN), F.length)
    narrow = parts.select(
        doc, F.col(part).alias("_part"), F.length("markdown").cast("long").alias("_size"),
        grounding.piece_lengths(F.col("markdown")).alias("_lengths"), gaps.alias("_gaps"),
    ).where(F.col("_size").isNotNull())
    placed = total_before(narrow, [doc], [F.col("_part")], bucket_of("_part"), F.col("_size"), "_ahead")
    inner = F.slice("_gaps", F.lit(2), F.greatest(F.size("_gaps") - 2, F.lit(0)))
    facts = placed.select(
        doc, F.struct(
            F.col("_part").alias("part"), (F.size("_gaps") - 1).cast("long").alias("markers"),
            F.get("_gaps", F.lit(0)).cast("long").alias("head"), F.element_at("_gaps", -1).cast("long").alias("tail"),
            F.coalesce(F.array_max(inner), F.lit(0)).cast("long").alias("inner"), F.col("_size").alias("size"),
            grounding.windows_hit(F.col("_lengths"), F.col("_ahead"), window).alias("hit"),
        ).alias("_p"),
    )
    zero = F.lit(0).cast("long")
    start = F.struct(
        zero.alias("open"), zero.alias("gap"), zero.alias("covered"), F.lit(-1).cast("long").alias("last"),
    )

    def join(done: Column, p: Column) -> Column:
        marked, hit = p["markers"] > 0, p["hit"]
        reached = done["open"] + p["head"]
        return F.struct(
            F.when(marked, p["tail"]).otherwise(reached).alias("open"),
            F.when(marked, F.greatest(done["gap"], reached, p["inner"])).otherwise(done["gap"]).alias("gap"),
            # A window that the part before has covered already is one window.
            (done["covered"] + hit["covered"] - F.when((hit["first"] >= 0) & (hit["first"] == done["last"]), 1).otherwise(0))
            .alias("covered"),
            F.when(hit["last"] >= 0, hit["last"]).otherwise(done["last"]).alias("last"),
        )

    whole = facts.groupBy(doc).agg(
        F.sum("_p.markers").alias("markers"), F.sum("_p.size").alias("_total"),
        F.aggregate(F.array_sort(F.collect_list("_p")), start, join).alias("_w"),
    )
    return whole.select(
        doc, "markers", F.greatest("_w.gap", "_w.open").alias("largest_gap"),
        F.ceil(F.col("_total") / window).cast("long").alias("windows"), F.col("_w.covered").alias("covered"),
    )


def bibliography(cited: DataFrame, doc: str, part: str) -> DataFrame:
    """Sources of each document: files numbered by first mention, their labels in order.

    ``cited`` are citation rows of a document's parts. Repeats are aggregated away before
    anything is ordered, and the numbering is bucketed by part.
    """
    place = F.struct(F.col(part).alias("part"), F.col("marker_no").alias("no"))
    labels = cited.groupBy(doc, "file", "label").agg(F.min(place).alias("_at"))
    files = labels.groupBy(doc, "file").agg(F.min("_at").alias("_first"))
    order = [F.col("_first.part"), F.col("_first.no")]
    numbered = number_rows(files, [doc], order, F.col("_first.part").cast("long"), "source_no")
    ranked = number_rows(
        labels, [doc, "file"], [F.col("_at.part"), F.col("_at.no")],
        F.col("_at.part").cast("long"), "label_no",
    )
    return ranked.join(numbered.select(doc, "file", "source_no"), [doc, "file"]).select(
        doc, "source_no", "file", "label_no", "label"
    )


def stale_markdown(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Paths of earlier runs that the current run writes elsewhere: to be deleted."""
    now = current.select("material_id", F.col("md_path").alias("_now"))
    return (
        previous.where(F.col("md_path").isNotNull() & (F.col("md_path") != ""))
        .join(now, "material_id")
        .where(F.col("md_path") != F.col("_now"))
        .select("material_id", F.col("md_path").alias("stale_path"), F.col("_now").alias("md_path"))
    )
