"""Queries over page tables: triage, running headers, recognition results, warnings."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions.ocrtext import page_needs_ocr
from foliant.operators import pages
from registry import duck, query

C = F.col

_NEEDS = f"(length({duck.strip('text')}) < 40 OR {duck.garbled(duck.strip('text'))}) AND coalesce(has_image, true)"
_FLAGS = f"WITH flags AS (SELECT doc_id, page_no, {_NEEDS} AS needs_ocr, item FROM {{layer_pages}})"


@query("page_triage", _FLAGS + " SELECT doc_id, page_no, needs_ocr FROM flags")
def page_triage(t):
    return pages.flag_pages(t.layer_pages).select("doc_id", "page_no", "needs_ocr")


@query(
    "web_page_triage",
    f"""SELECT page_id, (length({duck.strip('html')}) < 40 OR {duck.garbled(duck.strip('html'))}) AND page_id % 2 = 0 AS needs_ocr FROM pages""",
)
def web_page_triage(t):
    return t.pages.select(
        "page_id", page_needs_ocr(C("html"), C("page_id") % 2 == 0).alias("needs_ocr")
    )


_SAMPLED = _FLAGS + """,
totals AS (SELECT doc_id, max(page_no) AS total FROM flags GROUP BY doc_id),
spots AS (SELECT DISTINCT doc_id, total, CAST(round_even(i * (total - 1) / greatest(least(total, 10) - 1, 1), 0) AS INTEGER) + 1 AS page_no
          FROM totals, LATERAL (SELECT unnest(range(0, least(total, 10))) AS i)),
sampled AS (SELECT *, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS sampled FROM spots)"""


@query("sampled_pages", _SAMPLED + " SELECT doc_id, total, sampled, page_no FROM sampled")
def sampled_pages(t):
    return pages.sampled_pages(t.layer_pages)


@query(
    "lane_routing",
    _SAMPLED + """ SELECT doc_id, total, sampled, count(*) FILTER (WHERE needs_ocr) AS needing,
    CASE WHEN bool_or(item % 700 = 3) OR count(*) FILTER (WHERE needs_ocr) / sampled * total >= least(10, total) THEN 'ocr' ELSE 'default' END AS lane
    FROM sampled LEFT JOIN flags USING (doc_id, page_no) GROUP BY doc_id, total, sampled""",
)
def lane_routing(t):
    return pages.route_lanes(t.layer_pages, C("item") % 700 == 3)


@query(
    "over_limit_documents",
    _FLAGS + " SELECT doc_id, count(*) FILTER (WHERE needs_ocr) AS ocr_pages FROM flags GROUP BY doc_id HAVING ocr_pages > 8",
)
def over_limit_documents(t):
    return pages.over_limit(t.layer_pages, 8)


_RUNNING = f"""
WITH page AS (SELECT doc_id, page_no, text FROM {{book_pages}} WHERE text <> ''),
line AS (SELECT doc_id, page_no, unnest(l) AS line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, page_no, string_split(text, chr(10)) AS l FROM page)),
kept AS (SELECT * FROM line WHERE regexp_matches(line, '[\\p{{L}}\\p{{N}}]') OR {duck.strip('line')} = ''),
real AS (SELECT doc_id, page_no, pos, {duck.normal_line('line')} AS normal FROM kept
         WHERE {duck.strip('line')} <> '' AND NOT {duck.is_page_number('line')}),
edges AS (SELECT DISTINCT doc_id, page_no, unnest([arg_min(normal, pos), arg_max(normal, pos)]) AS line FROM real GROUP BY doc_id, page_no),
totals AS (SELECT doc_id, count(*) AS total FROM page GROUP BY doc_id),
running AS (SELECT doc_id, line, count(*) AS pages FROM edges JOIN totals USING (doc_id)
            WHERE total >= 5 AND line <> '' GROUP BY doc_id, line, total HAVING count(*) >= greatest(3, 0.2 * total)),
filled AS (SELECT k.*, row_number() OVER (PARTITION BY k.doc_id, page_no ORDER BY pos) AS a,
    row_number() OVER (PARTITION BY k.doc_id, page_no ORDER BY pos DESC) AS b,
    {duck.is_page_number('k.line')} OR r.line IS NOT NULL AS furniture
    FROM kept k LEFT JOIN running r ON r.doc_id = k.doc_id AND r.line = {duck.normal_line('k.line')} WHERE {duck.strip('k.line')} <> ''),
stops AS (SELECT *, min(a) FILTER (WHERE NOT furniture) OVER (PARTITION BY doc_id, page_no) AS ta,
          min(b) FILTER (WHERE NOT furniture) OVER (PARTITION BY doc_id, page_no) AS tb FROM filled),
gone AS (SELECT doc_id, page_no, pos FROM stops WHERE (a <= 2 AND a < coalesce(ta, 1000000)) OR (b <= 2 AND b < coalesce(tb, 1000000))),
peeled AS (SELECT p.doc_id, p.page_no, {duck.strip("coalesce(string_agg(k.line, chr(10) ORDER BY k.pos) FILTER (WHERE g.pos IS NULL), '')")} AS text
  FROM page p LEFT JOIN kept k USING (doc_id, page_no) LEFT JOIN gone g ON g.doc_id = k.doc_id AND g.page_no = k.page_no AND g.pos = k.pos
  GROUP BY p.doc_id, p.page_no)"""


@query("running_lines", _RUNNING + " SELECT doc_id, line, pages FROM running")
def running_lines(t):
    return pages.running_lines(t.book_pages)


@query(
    "natural_running_lines",
    _RUNNING.replace("{book_pages}", "{doc_pages}") + " SELECT doc_id, line, pages FROM running",
)
def natural_running_lines(t):
    """The same over text without added headers: what repeats by itself."""
    return pages.running_lines(t.doc_pages)


@query("peeled_pages", _RUNNING + " SELECT doc_id, page_no, text FROM peeled")
def peeled_pages(t):
    return pages.peel_pages(t.book_pages).select("doc_id", "page_no", "text")


@query(
    "cleaned_pages",
    _RUNNING + f" SELECT doc_id, page_no, {duck.strip(duck.apostrophes(duck.mixed_words('text')))} AS text FROM peeled",
)
def cleaned_pages(t):
    return pages.clean_pages(t.book_pages).select("doc_id", "page_no", "text")


_PROBE = f"""
WITH ranked AS (SELECT *, CASE WHEN NOT cached THEN row_number() OVER (PARTITION BY doc_id, cached ORDER BY page_no) ELSE 0 END AS rank FROM {{probe_pages}}),
steps AS (SELECT doc_id, b, substr(string_agg(text, ' ' ORDER BY page_no) FILTER (WHERE rank <= 3 * b), 1, 8000) AS sample
          FROM ranked, (SELECT unnest([0, 1, 2, 3]) AS b) WHERE rank <= 9 GROUP BY doc_id, b),
decided AS (SELECT doc_id, b, coalesce({duck.script('sample')}, 'other') AS script FROM steps),
todo AS (SELECT doc_id, CAST(count(*) FILTER (WHERE NOT cached) AS INTEGER) AS todo FROM {{probe_pages}} GROUP BY doc_id),
hits AS (SELECT doc_id, todo, min(b) AS b, arg_min(script, b) AS script FROM todo LEFT JOIN decided USING (doc_id)
         WHERE script <> 'other' AND todo > 0 GROUP BY doc_id, todo),
choice AS (SELECT t.doc_id, CASE h.script WHEN 'uz-cyrl' THEN 'uzb_cyrl' WHEN 'ru' THEN 'rus' WHEN 'uz-latn' THEN 'uzb' ELSE 'uzb+uzb_cyrl+rus' END AS language,
  CAST(least(coalesce(h.b * 3, 9), t.todo) AS INTEGER) AS pages_probed FROM todo t LEFT JOIN hits h USING (doc_id))"""


@query("probe_script", _PROBE + " SELECT doc_id, language, pages_probed FROM choice")
def probe_script(t):
    return pages.probe_script(t.probe_pages)


@query(
    "page_languages",
    _PROBE + """ SELECT doc_id, page_no, CASE WHEN rank <= pages_probed THEN 'uzb+uzb_cyrl+rus' ELSE language END AS language
    FROM ranked JOIN choice USING (doc_id) WHERE NOT cached""",
)
def page_languages(t):
    return pages.page_languages(t.probe_pages, pages.probe_script(t.probe_pages))


@query(
    "pages_todo",
    """SELECT p.doc_id AS file_hash, p.page_no FROM {doc_pages} p WHERE NOT EXISTS (SELECT 1 FROM {page_results} r
    WHERE r.file_hash = p.doc_id AND r.page_no = p.page_no AND r.dpi = 300 AND r.error IS NULL)""",
)
def pages_todo(t):
    wanted = t.doc_pages.select(C("doc_id").alias("file_hash"), "page_no")
    return pages.pages_todo(wanted, t.page_results, 300)


@query(
    "merge_page_results",
    """WITH stored AS (SELECT * FROM {page_results} WHERE error IS NULL),
    fresh AS (SELECT file_hash, page_no, 300 AS dpi, 'new ' || text AS text, confidence + 1 AS confidence,
              CASE WHEN page_no % 7 = 0 THEN 'timeout' END AS error FROM {page_results} WHERE page_no % 3 = 0)
    SELECT file_hash, page_no, dpi, md5(text) AS text_md5, confidence FROM (SELECT * FROM fresh WHERE error IS NULL UNION ALL BY NAME
      SELECT * FROM stored s WHERE NOT EXISTS (SELECT 1 FROM fresh f WHERE f.error IS NULL AND f.file_hash = s.file_hash AND f.page_no = s.page_no AND f.dpi = s.dpi))""",
)
def merge_page_results(t):
    stored = t.page_results.where(C("error").isNull())
    fresh = t.page_results.where(C("page_no") % 3 == 0).select(
        "file_hash", "page_no", F.lit(300).alias("dpi"), F.concat(F.lit("new "), "text").alias("text"),
        (C("confidence") + 1).alias("confidence"),
        F.when(C("page_no") % 7 == 0, "timeout").alias("error"),
    )
    merged = pages.merge_results(stored, fresh)
    return merged.select(
        "file_hash", "page_no", "dpi", F.md5("text").alias("text_md5"), "confidence"
    )


_OVERLAY = """
WITH overlaid AS (SELECT doc_id, page_no, coalesce(nullif(r.text, ''), nullif(l.text, '')) AS text, coalesce(r.text, '') <> '' AS from_ocr, r.doc_id IS NOT NULL AS read
  FROM {layer_pages} l FULL JOIN {ocr_results} r USING (doc_id, page_no))"""


@query("overlay_ocr", _OVERLAY + " SELECT doc_id, page_no, text, from_ocr FROM overlaid WHERE text IS NOT NULL")
def overlay_ocr(t):
    return pages.overlay_ocr(t.layer_pages, t.ocr_results)


@query(
    "extraction_methods",
    _OVERLAY + """ SELECT doc_id, count(*) FILTER (WHERE from_ocr) AS ocr_pages, count(*) AS chunks,
    CASE WHEN count(*) FILTER (WHERE from_ocr) = 0 THEN 'text' WHEN count(*) FILTER (WHERE from_ocr) >= count(*) THEN 'ocr' ELSE 'mixed' END AS extraction_method
    FROM overlaid WHERE text IS NOT NULL GROUP BY doc_id""",
)
def extraction_methods(t):
    return pages.extraction_methods(pages.overlay_ocr(t.layer_pages, t.ocr_results))


@query(
    "ocr_stats",
    f"""SELECT doc_id, count(*) AS pages, count(*) FILTER (WHERE text <> '') AS pages_with_text, count(*) FILTER (WHERE error IS NOT NULL) AS failed,
    count(*) FILTER (WHERE text <> '' AND confidence < 60) AS low, {duck.round_to("avg(confidence) FILTER (WHERE text <> '')", 1)} AS confidence
    FROM {{ocr_results}} GROUP BY doc_id""",
)
def ocr_stats(t):
    return pages.ocr_stats(t.ocr_results)


_PROBLEMS = """
WITH problems AS (SELECT doc_id, page_no, 'failed' AS problem FROM {ocr_results} WHERE error IS NOT NULL
  UNION ALL SELECT doc_id, page_no, 'low_confidence' FROM {ocr_results} WHERE text <> '' AND confidence < 60),
listed AS (SELECT doc_id, problem, count(*) AS pages, array_to_string(list(page_no ORDER BY page_no)[1:4], ', ')
  || CASE WHEN count(*) > 4 THEN ' … (+' || CAST(count(*) - 4 AS VARCHAR) || ')' ELSE '' END AS listed FROM problems GROUP BY doc_id, problem)"""


@query("problem_pages", _PROBLEMS + " SELECT doc_id, page_no, problem FROM problems")
def problem_pages(t):
    return pages.problem_pages(t.ocr_results)


@query("page_lists", _PROBLEMS + " SELECT doc_id, problem, pages, listed FROM listed")
def page_lists(t):
    """Page numbers written out, the first four and how many more."""
    return pages.page_lists(pages.problem_pages(t.ocr_results), 4)


_CLEAN_OCR = _RUNNING.replace("{book_pages}", "{ocr_results}")
_WARN = _CLEAN_OCR + f""",
layer AS (SELECT doc_id, page_no, {duck.strip('text')} AS text FROM {{layer_pages}}),
cleaned AS (SELECT doc_id, page_no, {duck.strip(duck.apostrophes(duck.mixed_words('text')))} AS text FROM peeled),
now AS (SELECT doc_id, page_no, coalesce(nullif(c.text, ''), nullif(l.text, '')) AS text FROM layer l FULL JOIN cleaned c USING (doc_id, page_no)),
problems AS (SELECT doc_id, page_no, 1 AS kind_no FROM {{ocr_results}} WHERE error IS NOT NULL
  UNION ALL SELECT doc_id, page_no, 2 FROM {{ocr_results}} WHERE text <> '' AND confidence < 60),
listed AS (SELECT doc_id, kind_no, count(*) AS n, array_to_string(list(page_no ORDER BY page_no)[1:30], ', ')
  || CASE WHEN count(*) > 30 THEN ' … (+' || CAST(count(*) - 30 AS VARCHAR) || ')' ELSE '' END AS pages FROM problems GROUP BY ALL)
SELECT doc_id, kind_no, 0 AS page_no, 'OCR: ' || CAST(n AS VARCHAR) || CASE kind_no WHEN 1 THEN ' ta sahifa o''qilmadi: '
  ELSE ' ta sahifa past ishonch bilan o''qildi (< 60%): ' END || pages AS message FROM listed
UNION ALL SELECT n.doc_id, 3, n.page_no, CAST(n.page_no AS VARCHAR) || '-sahifada juda kam matn bor (' || CAST(length(n.text) AS VARCHAR)
  || ' belgi) — skanerlangan rasm bo''lishi mumkin.' FROM now n LEFT JOIN {{ocr_results}} r USING (doc_id, page_no)
  WHERE r.doc_id IS NULL AND n.text IS NOT NULL AND length(n.text) < 40
UNION ALL SELECT doc_id, 4, 0, 'PDF ichidan matn topilmadi — hujjat skanerlangan va OCR talab qiladi.' FROM layer
  GROUP BY doc_id HAVING doc_id NOT IN (SELECT doc_id FROM now WHERE text IS NOT NULL)"""


@query("page_warnings", _WARN)
def page_warnings(t):
    return pages.page_warnings(pages.page_facts(t.layer_pages, t.ocr_results))


@query(
    "ocr_progress",
    """WITH t AS (SELECT doc_id, count(*) AS total FROM {doc_pages} GROUP BY 1), d AS (SELECT doc_id, count(*) AS done FROM {ocr_results} WHERE error IS NULL GROUP BY 1)
    SELECT doc_id, total, coalesce(done, 0) AS done, 'OCR: ' || CAST(coalesce(done, 0) AS VARCHAR) || '/' || CAST(total AS VARCHAR) || ' sahifa' AS message
    FROM t LEFT JOIN d USING (doc_id)""",
)
def ocr_progress(t):
    return pages.progress(t.doc_pages, t.ocr_results.where(C("error").isNull()))


@query(
    "failed_books",
    f"""WITH layer AS (SELECT doc_id, page_no, CASE WHEN doc_id LIKE '%7' THEN '' ELSE {duck.strip('text')} END AS text FROM {{layer_pages}})
    SELECT doc_id, 'failed' AS status, 'Hujjatdan matn ajratib bo''lmadi — indekslash uchun kontent yo''q. PDF ichidan matn topilmadi — hujjat skanerlangan va OCR talab qiladi.' AS error_message
    FROM layer GROUP BY doc_id HAVING count(*) FILTER (WHERE text <> '') = 0""",
)
def failed_books(t):
    """Books without a text layer and without recognised pages."""
    from foliant.plans import paged_books

    blank = F.when(C("doc_id").endswith("7"), "").otherwise(C("text"))
    layer = t.layer_pages.withColumn("text", blank)
    none = t.ocr_results.where(F.lit(False))
    facts = paged_books.recognised(layer, none)
    return paged_books.failures(facts, pages.page_warnings(facts))
