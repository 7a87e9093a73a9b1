"""A run over books with recognised pages, end to end: all its outputs read the pages it stored once."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from foliant.operators import pages, state
from foliant.plans import paged_books
from foliant.sources import tables
from registry import duck, query
from registry.grounded import _BOOKS
from registry.paged import _CLEAN_OCR
from registry.streamed import run_folder

C = F.col

# The page each book ends up with, and the books' Markdown over these instead of over the text layer.
_FINAL = _CLEAN_OCR.replace("{ocr_results}", "{read_pages}") + f""",
layer AS (SELECT doc_id, page_no, {duck.strip('text')} AS text FROM {{layer_pages}}),
cleaned AS (SELECT doc_id, page_no, {duck.strip(duck.apostrophes(duck.mixed_words('text')))} AS text FROM peeled),
final AS (SELECT doc_id, page_no, coalesce(nullif(c.text, ''), nullif(l.text, '')) AS text, coalesce(c.text, '') <> '' AS from_ocr
  FROM layer l FULL JOIN cleaned c USING (doc_id, page_no))"""
_BOOKS_SQL = re.sub(r"\bpage AS \(SELECT .*\n", "sheet AS (SELECT doc_id, page_no AS ord, text AS raw FROM final WHERE text IS NOT NULL),\n",
                    _BOOKS.strip().removeprefix("WITH RECURSIVE "), count=1)
_RECOGNISED = _FINAL.replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + re.sub(r"\bFROM page\b", "FROM sheet", _BOOKS_SQL)
_PATH = duck.markdown_path('any_value(module_code)', 'any_value(topic_code)', 'any_value(type)', 'any_value(original_filename)', 'doc_id')


def _facts(t):
    return paged_books.recognised(t.layer_pages, t.read_pages)


@query(
    "recognised_books",
    _RECOGNISED + f""" SELECT doc_id, CAST(part AS BIGINT) AS part, script, chunks AS chunk_count, CAST(markers AS BIGINT) AS marker_count,
    {duck.markdown_path('module_code', 'topic_code', 'type', 'original_filename', 'doc_id')} AS md_path, markdown, CAST(length(markdown) AS INTEGER) AS char_count FROM whole""",
)
def recognised_books(t):
    """Markdown of books whose recognised pages are laid over their text layer."""
    return paged_books.ground(_facts(t), t.book_meta)


_STATS = f"""
problems AS (SELECT doc_id, page_no, 1 AS kind_no FROM {{read_pages}} WHERE error IS NOT NULL
  UNION ALL SELECT doc_id, page_no, 2 FROM {{read_pages}} WHERE text <> '' AND confidence < 60),
listed AS (SELECT doc_id, kind_no, count(*) AS n, array_to_string(list(page_no ORDER BY page_no)[1:30], ', ')
  || CASE WHEN count(*) > 30 THEN ' … (+' || CAST(count(*) - 30 AS VARCHAR) || ')' ELSE '' END AS pages FROM problems GROUP BY ALL),
warned AS (SELECT doc_id, kind_no, 0 AS page_no, 'OCR: ' || CAST(n AS VARCHAR) || CASE kind_no WHEN 1 THEN ' ta sahifa o''qilmadi: '
  ELSE ' ta sahifa past ishonch bilan o''qildi (< 60%): ' END || pages AS message FROM listed
  UNION ALL SELECT l.doc_id, 3, l.page_no, CAST(l.page_no AS VARCHAR) || '-sahifada juda kam matn bor (' || CAST(length(l.text) AS VARCHAR)
    || ' belgi) — skanerlangan rasm bo''lishi mumkin.' FROM layer l LEFT JOIN {{read_pages}} r USING (doc_id, page_no)
    WHERE r.doc_id IS NULL AND l.text <> '' AND length(l.text) < 40
  UNION ALL SELECT doc_id, 4, 0, 'PDF ichidan matn topilmadi — hujjat skanerlangan va OCR talab qiladi.' FROM layer
    GROUP BY doc_id HAVING doc_id NOT IN (SELECT doc_id FROM final WHERE text IS NOT NULL)),
used AS (SELECT doc_id, count(*) FILTER (WHERE from_ocr) AS replaced, count(*) FILTER (WHERE text IS NOT NULL) AS filled FROM final GROUP BY doc_id),
stats AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE error IS NOT NULL) AS failed, count(*) FILTER (WHERE text <> '' AND confidence < 60) AS low,
  count(*) FILTER (WHERE cached) AS cached, {duck.round_to("avg(confidence) FILTER (WHERE text <> '')", 1)} AS confidence,
  arg_max(languages, page_no) FILTER (WHERE NOT cached) AS languages FROM {{read_pages}} GROUP BY doc_id)"""


@query("recognised_warnings", _FINAL + "," + _STATS + " SELECT doc_id, kind_no, page_no, message FROM warned")
def recognised_warnings(t):
    return pages.page_warnings(_facts(t))


@query(
    "recognition_stats",
    _FINAL + "," + _STATS + " SELECT s.doc_id, pages, failed, low, cached, replaced, confidence, languages FROM stats s JOIN used USING (doc_id)",
)
def recognition_stats(t):
    """What recognition did for each book, stored pages and replaced layers included."""
    return pages.recognition_stats(_facts(t))


_OUTCOMES = _RECOGNISED + "," + _STATS + f""",
    sums AS (SELECT doc_id, {_PATH} AS path, any_value(script) AS script, any_value(chunks) AS chunks, CAST(sum(markers) AS BIGINT) AS markers,
      CAST(sum(length(markdown)) AS BIGINT) AS chars FROM whole GROUP BY doc_id),
    last AS (SELECT doc_id, arg_max(message, (kind_no, page_no)) AS message FROM warned GROUP BY doc_id),
    judged AS (SELECT u.doc_id, CASE WHEN s.pages > 1000 THEN 'Hujjatda OCR talab qiladigan ' || CAST(s.pages AS VARCHAR) || ' ta sahifa bor — ruxsat etilgan chegara 1000 (OCR_MAX_PAGES).'
      WHEN u.filled = 0 THEN 'Hujjatdan matn ajratib bo''lmadi — indekslash uchun kontent yo''q.' || coalesce(' ' || l.message, '') END AS reason
      FROM used u LEFT JOIN stats s USING (doc_id) LEFT JOIN last l USING (doc_id)),
    outcome AS (SELECT j.doc_id, s.doc_id IS NOT NULL AS was_read, CASE WHEN reason IS NULL THEN 'md_ready' ELSE 'failed' END AS status, reason AS error_message,
      CASE WHEN reason IS NULL THEN path END AS md_file_path, CASE WHEN reason IS NULL THEN chunks END AS chunk_count,
      CASE WHEN reason IS NULL THEN markers END AS marker_count, CASE WHEN reason IS NULL THEN chars END AS char_count,
      CASE WHEN reason IS NULL THEN script END AS detected_script,
      CASE WHEN reason IS NULL THEN CASE WHEN replaced = 0 THEN 'text' WHEN replaced >= filled THEN 'ocr' ELSE 'mixed' END END AS extraction_method,
      CASE WHEN reason IS NULL THEN CASE WHEN s.doc_id IS NULL THEN 0 ELSE replaced END END AS ocr_page_count,
      CASE WHEN reason IS NULL THEN confidence END AS ocr_confidence, CASE WHEN reason IS NULL THEN languages END AS ocr_languages
    FROM judged j JOIN used u USING (doc_id) LEFT JOIN sums USING (doc_id) LEFT JOIN stats s USING (doc_id))"""


def _outcomes(t, facts):
    return paged_books.outcomes(facts, t.book_meta, paged_books.ground(facts, t.book_meta), pages.page_warnings(facts))


@query("recognised_materials", _OUTCOMES + " SELECT * EXCLUDE (was_read) FROM outcome")
def recognised_materials(t):
    """What the run changes in each book's material, failed books included."""
    return _outcomes(t, _facts(t)).drop("was_read")


@query(
    "recognised_trail",
    _OUTCOMES + """,
    step AS (SELECT doc_id, 0 AS place, 0 AS kind_no, 0 AS page_no, 'conversion' AS stage, 'info' AS level, 'Hujjatni o''qish boshlandi: "' || doc_id || '.pdf"' AS message FROM outcome
      UNION ALL SELECT doc_id, 1, 0, 0, 'ocr', 'info', 'OCR tugadi: ' || CAST(ocr_page_count AS VARCHAR) || ' ta sahifa, o''rtacha ishonch '
        || coalesce(CAST(CAST(round_even(ocr_confidence, 0) AS INTEGER) AS VARCHAR) || '%', '—') || ', tillar: ' || coalesce(ocr_languages, '') FROM outcome WHERE status = 'md_ready' AND was_read
      UNION ALL SELECT doc_id, 2, 0, 0, 'conversion', 'info', 'Markdown tayyor: ' || CAST(chunk_count AS VARCHAR) || ' ta chunk, ' || CAST(marker_count AS VARCHAR)
        || ' ta grounding marker, ' || format('{:,}', char_count) || ' belgi, yozuv: ' || detected_script FROM outcome WHERE status = 'md_ready'
      UNION ALL SELECT w.doc_id, 3, kind_no, page_no, 'conversion', 'warn', message FROM warned w JOIN outcome o ON o.doc_id = w.doc_id AND o.status = 'md_ready'
      UNION ALL SELECT doc_id, 4, 0, 0, 'pipeline', 'error', 'Pipeline xatosi: ' || error_message FROM outcome WHERE status = 'failed')
    SELECT sha256('run-1/' || doc_id || '/' || CAST(place AS VARCHAR) || '/' || CAST(kind_no AS VARCHAR) || '/' || CAST(page_no AS VARCHAR)) AS log_id,
      doc_id AS material_id, stage, level, message, TIMESTAMP '2024-05-01' + to_seconds(place) AS created_at FROM step""",
)
def recognised_trail(t):
    """The audit trail of that run, appended twice and read back."""
    facts = _facts(t)
    at = F.lit("2024-05-01").cast("timestamp_ntz")
    trail = state.run_trail(_outcomes(t, facts), t.book_meta, pages.page_warnings(facts), "run-1", at)
    folder, _ = run_folder(t)
    for _ in range(2):
        tables.append_audit(trail, folder, "run-1")
    return tables.read_audit(t.spark, folder).drop("run", "day")
