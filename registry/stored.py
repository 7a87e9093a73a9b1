"""Queries that write to a store and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.plans import paged_books, text_corpus
from foliant.session import stored
from foliant.sources import versions
from registry import ORACLES, duck, query
from registry.grounded import _BLOCKS
from registry.streamed import run_folder

C = F.col


@query(
    "stored_markdown",
    _BLOCKS.replace("{text_documents}", "{moved_documents}") + f"""
    SELECT material_id, CASE WHEN markdown IS NULL THEN 'failed' ELSE 'md_ready' END AS status, {duck.path_segment('module_code')} AS module_dir,
    {duck.markdown_path('module_code', 'topic_code', 'type', 'original_filename', 'material_id')} AS md_path, md5(markdown) AS markdown_md5 FROM whole""",
)
def stored_markdown(t):
    """Newest versions after a repeated batch, documents that moved to another module, and a run that failed."""
    store, _ = run_folder(t)
    first = text_corpus.ground(t.text_documents)
    versions.commit(first, store, "first", 0)
    moved = t.moved_documents.where(C("module_code") == "module-09")
    versions.commit(text_corpus.ground(moved), store, "second", 0)
    versions.commit(first, store, "first", 0)
    emptied = t.text_documents.withColumn("text", F.lit(""))
    versions.commit(text_corpus.ground(emptied), store, "third", 0)
    versions.compact(t.spark, store)
    return versions.read_newest(t.spark, store).select(
        "material_id", "status", "module_dir", "md_path", F.md5("markdown").alias("markdown_md5")
    )


@query("stored_books")
def stored_books(t):
    """Books of two jobs, in parts, through the store of versions."""
    store, _ = run_folder(t)
    # Both commits read the pages three times; they are numbered once.
    books = paged_books.versions(paged_books.ground(stored(t.doc_pages), t.book_meta))
    for job, rows in (("first", C("material_id") < "src5"), ("second", C("material_id") >= "src5")):
        versions.commit(books.where(rows), store, job, 0)
        versions.commit(books.where(rows), store, job, 0)
    return versions.read_newest(t.spark, store).select(
        C("material_id").alias("doc_id"), "part", "script", "chunk_count", "marker_count", "md_path", "markdown",
        "char_count",
    )


ORACLES["stored_books"] = ORACLES["grounded_whole_books"]
