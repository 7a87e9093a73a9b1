"""Documents given as page rows: text layer, recognised pages, clean-up, grounding.

A run over recognised pages lays them over the text layer once (``recognised``) and stores that as one
row per page. Markdown, warnings, statistics, failures and the rows that update the catalog all
read the stored rows, so results are cleaned once whatever is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions.script import detect_script, latin_if_uzbek
from foliant.functions.typography import clean_text
from foliant.operators import grounded, pages
from foliant.operators.sections import page_sections
from foliant.plans.text_corpus import NO_CONTENT
from foliant.session import stored

# Why a document is refused or fails.
TOO_MANY_PAGES = (
    "Hujjatda OCR talab qiladigan %d ta sahifa bor — ruxsat etilgan chegara %d (OCR_MAX_PAGES)."
)
# A book nobody has described cannot be cited.
NO_METADATA = "Material ma'lumotlari topilmadi."


def recognised(
    layer: DataFrame, results: DataFrame, min_confidence: float = pages.MIN_CONFIDENCE,
    unavailable: bool = False,
) -> DataFrame:
    """``pages.page_facts``, stored: what all outputs of a run are made from."""
    return stored(pages.page_facts(layer, results, min_confidence, unavailable))


def finished(layer: DataFrame, meta: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Sections of paged documents with finished text and the facts of their document.

    The sections are read three times: measured, sampled, and finished. ``layer`` may be the rows
    that ``recognised`` has stored; given ``results``, these are laid over it and stored first.
    Books without metadata have no Markdown; ``outcomes`` tells.
    """
    if results is not None:
        layer = recognised(layer, results)
    sections = page_sections(layer)
    facts = grounded.document_facts(sections).withColumn(
        "script", detect_script(F.col("sample"))
    ).drop("sample")
    joined = grounded.with_facts(sections, facts.join(meta, "doc_id"))
    # Pages are cleaned and transliterated one by one, before anything is gathered.
    return joined.withColumn("text", latin_if_uzbek(clean_text(F.col("text")), F.col("script")))


def ground(layer: DataFrame, meta: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """Grounded Markdown of paged documents in parts; see ``finished`` and ``grounded.assemble``."""
    return grounded.assemble(finished(layer, meta, results))


def totals(layer: DataFrame, meta: DataFrame, results: DataFrame | None = None) -> DataFrame:
    """``document_totals`` of what ``ground`` gives, without putting the Markdown together."""
    return grounded.totals(finished(layer, meta, results))


def document_totals(parts: DataFrame) -> DataFrame:
    """Counts of whole documents from their parts."""
    return parts.groupBy("doc_id", "md_path", "script", "chunk_count").agg(
        F.sum("marker_count").alias("marker_count"),
        F.sum("char_count").alias("char_count"),
        F.count(F.lit(1)).alias("parts"),
    )


def failures(
    facts: DataFrame, warnings: DataFrame, meta: DataFrame | None = None,
    max_pages: int = pages.MAX_PAGES,
) -> DataFrame:
    """Documents that give no Markdown, and why.

    Too many pages to recognise, no text at all (with the last warning), or no metadata. ``facts`` are
    grouped once.
    """
    books = facts.groupBy("doc_id").agg(
        F.bool_or(F.col("text").isNotNull()).alias("_filled"), F.count_if("read").alias("_read")
    )
    last = warnings.groupBy("doc_id").agg(
        F.max_by("message", F.struct("kind_no", "page_no")).alias("_last")
    )
    joined = books.join(last, "doc_id", "left")
    described = F.lit(True)
    if meta is not None:
        joined = joined.join(meta.select("doc_id", F.lit(True).alias("_known")).distinct(), "doc_id", "left")
        described = F.col("_known").isNotNull()
    reason = F.concat(F.lit(NO_CONTENT), F.coalesce(F.concat(F.lit(" "), "_last"), F.lit("")))
    message = (
        F.when(F.col("_read") > max_pages, F.format_string(TOO_MANY_PAGES, "_read", F.lit(max_pages)))
        .when(~F.col("_filled"), reason)
        .when(~described, NO_METADATA)
    )
    return joined.select("doc_id", F.lit("failed").alias("status"), message.alias("error_message")).where(
        F.col("error_message").isNotNull()
    )


def outcomes(
    facts: DataFrame, meta: DataFrame, parts: DataFrame, warnings: DataFrame,
    max_pages: int = pages.MAX_PAGES,
) -> DataFrame:
    """One row per book with what a run changes in its material, and whether pages of it ``was_read``.

    Counts and path of the Markdown, script, how the text was extracted, and what recognition
    said; or ``failed`` and why. A failed book keeps no counts. The rows are stored, so what is made of
    them does not ground the books again.
    """
    failed = failures(facts, warnings, meta, max_pages)
    totals = document_totals(parts)
    methods = pages.extraction_methods(facts).select("doc_id", "extraction_method")
    stats = pages.recognition_stats(facts).select(
        "doc_id", F.col("replaced").alias("ocr_page_count"), F.col("confidence").alias("ocr_confidence"),
        F.col("languages").alias("ocr_languages"),
    )
    fine = totals.join(methods, "doc_id").join(stats, "doc_id", "left").join(failed, "doc_id", "left_anti").select(
        "doc_id", F.lit("md_ready").alias("status"), F.lit(None).cast("string").alias("error_message"),
        F.col("md_path").alias("md_file_path"), "chunk_count", "marker_count", "char_count",
        F.col("script").alias("detected_script"), "extraction_method",
        F.col("ocr_page_count").isNotNull().alias("was_read"),
        F.coalesce("ocr_page_count", F.lit(0)).cast("long").alias("ocr_page_count"), "ocr_confidence", "ocr_languages",
    )
    return stored(fine.unionByName(failed, allowMissingColumns=True))


def versions(parts: DataFrame) -> DataFrame:
    """Grounded parts as the rows of one version per book, for ``sources.versions.commit``."""
    return parts.select(
        F.col("doc_id").alias("material_id"), "part", "script", F.lit("md_ready").alias("status"),
        F.lit(None).cast("string").alias("error_message"), "chunk_count", "marker_count", "char_count",
        F.element_at(F.split("md_path", "/"), 1).alias("module_dir"), "md_path", "markdown",
    )
