"""Queries of the text functions and the section operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import grounding, names, ocrtext, script, typography
from foliant.functions.nfc import nfc
from foliant.functions.text import shorten
from foliant.functions.register import register
from foliant.operators import sections
from foliant.operators.reports import script_census
from foliant.operators.rows import each
from foliant.plans import text_corpus
from registry import ORACLES, duck, query

C = F.col


# -- typography -------------------------------------------------------------------------------


@query("content_hashes", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hashes(t):
    return t.documents.select("doc_id", F.sha2(C("text"), 256).alias("content_hash"))


@query("nfc_text", "SELECT doc_id, nfc_normalize(text) AS text FROM {dirty_text}")
def nfc_text(t):
    return t.dirty_text.select("doc_id", nfc(C("text")).alias("text"))


@query("clean_text", f"SELECT doc_id, {duck.clean('text')} AS text FROM {{dirty_text}}")
def clean_text(t):
    return t.dirty_text.select("doc_id", typography.clean_text(C("text")).alias("text"))


@query("clean_text_sql", f"SELECT doc_id, {duck.clean('text')} AS text FROM {{dirty_text}}")
def clean_text_sql(t):
    """The same through the SQL function."""
    register(t.spark)
    return t.spark.sql("SELECT doc_id, clean_text(text) AS text FROM {rows}", rows=t.dirty_text)


@query("caps_digraphs", f"SELECT doc_id, {duck.caps_digraphs('text')} AS text FROM {{dirty_text}}")
def caps_digraphs(t):
    return t.dirty_text.select("doc_id", typography.fix_caps_digraphs(C("text")).alias("text"))


_STEP_SQL = {
    "zero_width": duck.sub("text", r"[\x{200b}-\x{200d}\x{feff}\x{ad}]", ""),
    "newlines": duck.newlines("text"),
    "spaces": duck.sub("text", r"[\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]", " "),
    "hyphens": duck.sub("text", r"(\p{L}+)-[ \t]*\n[ \t]*(\p{L}+)", r"\1\2"),
    "unwrapped": duck.sub(
        duck.sub("text", r"([^\n])\n([^\n])", r"\1 \2"), r"([^\n])\n([^\n])", r"\1 \2"
    ),
    "squeezed": duck.sub(
        duck.sub("text", f"[{duck.WS_NO_NL}]+", " "),
        rf"(?m)^[{duck.WS_NO_NL}\x1c-\x1f]+|[{duck.WS_NO_NL}\x1c-\x1f]+$", "",
    ),
    "blank_lines": duck.strip(duck.sub("text", r"\n{3,}", "\n\n")),
}


@query(
    "typography_steps",
    "SELECT doc_id, "
    + ", ".join(f"md5({sql}) AS {name}" for name, sql in _STEP_SQL.items())
    + " FROM {dirty_text}",
)
def typography_steps(t):
    """Each step on its own, as a hash of its text."""
    steps = {
        "zero_width": typography.drop_zero_width,
        "newlines": typography.normalise_newlines,
        "spaces": typography.normalise_spaces,
        "hyphens": typography.join_hyphenation,
        "unwrapped": typography.unwrap_lines,
        "squeezed": typography.squeeze_lines,
        "blank_lines": typography.collapse_blank_lines,
    }
    return t.dirty_text.select(
        "doc_id", *[F.md5(step(C("text"))).alias(name) for name, step in steps.items()]
    )


# -- script -----------------------------------------------------------------------------------


@query(
    "script_of_documents",
    f"""SELECT doc_id, {duck.script('text')} AS script,
    {duck.count_of('substr(text, 1, 4000)', 'ўқғҳЎҚҒҲ')} > 0 AND {duck.count_of('substr(text, 1, 4000)', 'ўқғҳЎҚҒҲ')}
      >= {duck.count_of('substr(text, 1, 4000)', 'ыщЫЩ')} AS uzbek_cyrillic FROM {{script_text}}""",
)
def script_of_documents(t):
    return t.script_text.select(
        "doc_id",
        script.detect_script(C("text")).alias("script"),
        script.is_uzbek_cyrillic(C("text")).alias("uzbek_cyrillic"),
    )


@query(
    "script_census",
    f"SELECT script, count(*) AS documents FROM (SELECT {duck.script('text')} AS script FROM {{script_text}}) GROUP BY 1",
)
def census(t):
    return script_census(t.script_text.select(script.detect_script(C("text")).alias("script")))


@query("latin_text", f"SELECT doc_id, {duck.latin('text')} AS text FROM {{script_text}}")
def latin_text(t):
    return t.script_text.select("doc_id", script.to_latin(C("text")).alias("text"))


_YE = "lower(w[i]) = 'е' AND (i = 1 OR contains('аеёиоуўэюяъь', lower(w[i - 1])))"


@query(
    "expand_e",
    "SELECT doc_id, "
    + duck.tokens(
        "text", f"[{duck.CYR}]+|[^{duck.CYR}]+",
        "CASE WHEN NOT regexp_matches(w, '[еЕ]') THEN w ELSE "
        "array_to_string(list_transform(range(1, length(w) + 1), lambda i: CASE "
        f"WHEN {_YE} THEN CASE WHEN w[i] = 'е' THEN 'ye' ELSE 'Ye' END "
        "WHEN w[i] = 'е' THEN 'e' WHEN w[i] = 'Е' THEN 'E' ELSE w[i] END), '') END",
    )
    + " AS text FROM (SELECT doc_id, replace(replace(text, 'у', 'е'), 'У', 'Е') AS text FROM {script_text})",
)
def expand_e(t):
    """The Latin source has no letter for Cyrillic e, so another one is turned into it."""
    return t.script_text.select(
        "doc_id", script.expand_e(F.translate(C("text"), "уУ", "еЕ")).alias("text")
    )


@query(
    "final_ii",
    "SELECT doc_id, "
    + duck.sub(duck.sub("text", "ии([^а-яёўқғҳА-ЯЁЎҚҒҲ]|$)", r"ий\1"), "ии([^а-яёўқғҳА-ЯЁЎҚҒҲ]|$)", r"ий\1")
    + " AS text FROM (SELECT doc_id, replace(text, 'н', 'ии') AS text FROM {script_text})",
)
def final_ii(t):
    return t.script_text.select(
        "doc_id",
        script.repair_final_ii(F.replace(C("text"), F.lit("н"), F.lit("ии"))).alias("text"),
    )


_PARTS = """
WITH cut AS (SELECT material_id, """ + duck.parts("text") + """ AS parts FROM {text_documents}),
part AS (SELECT material_id, unnest(parts) AS text, generate_subscripts(parts, 1) AS ord FROM cut),
reach AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY material_id ORDER BY ord
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chars_before FROM part),
sample AS (SELECT material_id, substr(string_agg(text, ' ' ORDER BY ord), 1, 8000) AS sample
           FROM reach WHERE chars_before < 8000 GROUP BY material_id),
decided AS (SELECT material_id, sample, """ + duck.script("sample") + """ AS script FROM sample)"""


@query("script_sample", _PARTS + " SELECT material_id, sample, script FROM decided")
def script_sample(t):
    parts = t.text_documents.select("material_id", sections.parts_of(C("text")).alias("parts"))
    sample = script.script_sample(F.transform("parts", lambda s: s["text"]))
    return parts.where(F.size("parts") > 0).select(
        "material_id", sample.alias("sample"), script.detect_script(sample).alias("script")
    )


_FINISHED = _PARTS + """,
finished AS (SELECT p.material_id, p.ord, 'part ' || CAST(p.ord AS VARCHAR) AS label, d.script,
  CASE WHEN d.script = 'uz-cyrl' THEN """ + duck.latin("c") + """ ELSE c END AS text
  FROM (SELECT material_id, ord, """ + duck.clean("text") + """ AS c FROM part) p JOIN decided d USING (material_id))"""


@query("translit_documents", _FINISHED + " SELECT material_id, CAST(ord AS INTEGER) AS ord, label, script, text FROM finished")
def translit_documents(t):
    done = text_corpus.process_sections(t.text_documents)
    return sections.explode_sections(done, C("sections"), ["material_id", "script"])


# -- sections ---------------------------------------------------------------------------------


@query(
    "split_parts",
    f"""WITH cut AS (SELECT doc_id, {duck.parts('parts_text')} AS parts FROM {{section_text}})
    SELECT doc_id, CAST(ord AS INTEGER) AS ord, 'part ' || CAST(ord AS VARCHAR) AS label, text
    FROM (SELECT doc_id, unnest(parts) AS text, generate_subscripts(parts, 1) AS ord FROM cut)""",
)
def split_parts(t):
    return sections.explode_sections(t.section_text, sections.parts_of(C("parts_text")), ["doc_id"])


@query(
    "split_markdown_sections",
    f"""WITH lines AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
                   FROM (SELECT doc_id, string_split(md_text, chr(10)) AS l FROM {{section_text}})),
    groups AS (SELECT *, count(*) FILTER (WHERE regexp_matches(line, '^#{{1,3}}([{duck.WS}]|$)')
               AND (regexp_matches(line, '^#{{1,3}}[{duck.WS}]') OR pos < total))
               OVER (PARTITION BY doc_id ORDER BY pos) AS section
               FROM (SELECT *, max(pos) OVER (PARTITION BY doc_id) AS total FROM lines)),
    texts AS (SELECT doc_id, section, {duck.strip("string_agg(line, chr(10) ORDER BY pos)")} AS text
              FROM groups GROUP BY doc_id, section),
    kept AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY section) AS ord, text FROM texts WHERE text <> '')
    SELECT doc_id, CAST(ord AS INTEGER) AS ord, 'section ' || CAST(ord AS VARCHAR) AS label, text FROM kept""",
)
def split_markdown_sections(t):
    cut = sections.markdown_sections_of(C("md_text"))
    return sections.explode_sections(t.section_text, cut, ["doc_id"])


@query(
    "doc_totals",
    f"""WITH cut AS (SELECT doc_id, unnest({duck.parts('parts_text')}) AS text FROM {{section_text}})
    SELECT doc_id, count(*) AS chunk_count, CAST(sum(length(text)) AS BIGINT) AS total_chars FROM cut GROUP BY doc_id""",
)
def doc_totals(t):
    return sections.doc_totals(split_parts(t), ["doc_id"])


@query(
    "numbered_pages",
    f"""SELECT doc_id, page_no AS ord, 'page ' || CAST(page_no AS VARCHAR) AS label, {duck.strip('text')} AS text
    FROM {{doc_pages}} WHERE {duck.strip('text')} <> ''""",
)
def numbered_pages(t):
    return sections.page_sections(t.doc_pages)


_WORDS = """
WITH line_rows AS (SELECT doc_id, page_no, item, unnest(l) AS line_text, generate_subscripts(l, 1) - 1 AS pos
               FROM (SELECT doc_id, page_no, item, string_split(text, chr(10)) AS l FROM {doc_pages})),
word_rows AS (SELECT doc_id, page_no, item, pos, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS word
          FROM (SELECT *, string_split(line_text, ' ') AS l FROM line_rows)),
words AS (SELECT doc_id, page_no, pos, word, pos // 5 AS par, """ + duck.strip("raw") + """ AS text,
    CASE WHEN (item + pos * 1000 + word) % 13 = 0 THEN -1 ELSE (item * 31 + (pos * 1000 + word) * 7) % 101 END AS conf
    FROM word_rows WHERE """ + duck.strip("raw") + """ <> '')"""


@query(
    "assemble_pages",
    _WORDS + """,
    line_texts AS (SELECT doc_id, page_no, par, pos, string_agg(text, ' ' ORDER BY word) AS text FROM words GROUP BY ALL),
    pars AS (SELECT doc_id, page_no, par, string_agg(text, chr(10) ORDER BY pos) AS text FROM line_texts GROUP BY ALL),
    texts AS (SELECT doc_id, page_no, string_agg(text, chr(10) || chr(10) ORDER BY par) AS text FROM pars GROUP BY ALL),
    confs AS (SELECT doc_id, page_no, """
    + duck.round_to("coalesce(avg(conf) FILTER (WHERE conf >= 0), 0)", 1)
    + """ AS confidence FROM words GROUP BY ALL)
    SELECT doc_id, page_no, text, confidence FROM texts JOIN confs USING (doc_id, page_no)""",
)
def assemble_pages(t):
    return sections.assemble_pages(t.words_by_page)


@query(
    "page_confidence",
    _WORDS + " SELECT doc_id, page_no, "
    + duck.round_to("coalesce(avg(conf) FILTER (WHERE conf >= 0), 0)", 1)
    + " AS confidence, count(*) AS words FROM words GROUP BY doc_id, page_no",
)
def page_confidence(t):
    return sections.page_confidence(t.words)


@query(
    "assemble_slides",
    f"""WITH e AS (SELECT conv_id AS doc_id, CAST(turn // 2 AS INTEGER) AS slide, turn AS ord, role,
               CASE role WHEN 'assistant' THEN -1 ELSE turn END AS line, {duck.strip('text')} AS text, text AS raw FROM conversations),
    body_lines AS (SELECT doc_id, slide, line, min(ord) AS ord, string_agg(text, ' | ' ORDER BY ord) AS text
                   FROM e WHERE role <> 'system' AND text <> '' GROUP BY ALL),
    body AS (SELECT doc_id, slide, string_agg(text, chr(10) ORDER BY ord) AS body FROM body_lines GROUP BY ALL),
    notes AS (SELECT doc_id, slide, {duck.strip(duck.sub("string_agg(raw, chr(10) ORDER BY ord)", f"[{duck.WS}]+", " "))} AS notes
              FROM e WHERE role = 'system' GROUP BY ALL),
    joined AS (SELECT doc_id, slide, {duck.strip("coalesce(body, '') || CASE WHEN coalesce(notes, '') <> '' THEN chr(10) || chr(10) || '[Presenter Notes: ' || notes || ']' ELSE '' END")} AS text
               FROM body FULL JOIN notes USING (doc_id, slide))
    SELECT doc_id, slide, text, 'slide ' || CAST(slide AS VARCHAR) AS label FROM joined WHERE text <> ''""",
)
def assemble_slides(t):
    return sections.assemble_slides(t.slide_elements)


# -- recognised text --------------------------------------------------------------------------


@query("mixed_script_words", f"SELECT doc_id, {duck.mixed_words('text')} AS text FROM {{ocr_text}}")
def mixed_script_words(t):
    return t.ocr_text.select("doc_id", ocrtext.fix_mixed_script_words(C("text")).alias("text"))


@query("apostrophes", f"SELECT doc_id, {duck.apostrophes('text')} AS text FROM {{ocr_text}}")
def apostrophes(t):
    return t.ocr_text.select("doc_id", ocrtext.normalise_apostrophes(C("text")).alias("text"))


@query(
    "line_shapes",
    rf"""WITH l AS (SELECT doc_id, page_no, unnest(a) AS line, generate_subscripts(a, 1) AS line_no
               FROM (SELECT doc_id, page_no, string_split(text, chr(10)) AS a FROM {{book_pages}}))
    SELECT doc_id, page_no, CAST(line_no AS INTEGER) AS line_no,
      regexp_matches(line, '[\p{{L}}\p{{N}}]') AS has_content, {duck.is_page_number('line')} AS page_number,
      {duck.normal_line('line')} AS normal FROM l""",
)
def line_shapes(t):
    """The three line rules: noise, page number, comparable form."""
    lines = each(t.book_pages, ["doc_id", "page_no"], F.split("text", "\n"), "_at", "line")
    return lines.select(
        "doc_id", "page_no", (C("_at") + 1).alias("line_no"),
        ocrtext.has_content(C("line")).alias("has_content"),
        ocrtext.is_page_number(C("line")).alias("page_number"),
        ocrtext.normalise_line(C("line")).alias("normal"),
    )


@query("garbled_pages", f"""SELECT page_id, {duck.garbled('html')} AS garbled FROM pages""")
def garbled_pages(t):
    return t.pages.select("page_id", ocrtext.is_garbled(C("html")).alias("garbled"))


# -- names ------------------------------------------------------------------------------------


@query(
    "mojibake_names",
    """WITH good AS (SELECT p_partkey AS doc_id, translate(p_name, 'aeiou', 'аеиоу') || '.txt' AS name FROM {part}),
    broken AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN name ELSE array_to_string(list_transform(
        regexp_extract_all(hex(encode(name)), '..'), lambda h: chr(CAST(('0x' || h) AS INTEGER))), '') END AS name FROM good)
    SELECT doc_id, name, CASE WHEN regexp_matches(name, '^[\\x00-\\x{ff}]*$') THEN coalesce(TRY(decode(unhex(array_to_string(list_transform(
        string_split(name, ''), lambda c: printf('%02x', CASE WHEN c = '' THEN 0 ELSE unicode(c) END)), '')))), name) ELSE name END AS repaired FROM broken""".replace("\\\\", "\\"),
)
def mojibake_names(t):
    good = t.part.select(
        C("p_partkey").alias("doc_id"),
        F.concat(F.translate("p_name", "aeiou", "аеиоу"), F.lit(".txt")).alias("name"),
    )
    broken = F.decode(F.encode(C("name"), "UTF-8"), "ISO-8859-1")
    return good.select(
        "doc_id", F.when(C("doc_id") % 3 == 0, C("name")).otherwise(broken).alias("name")
    ).select("doc_id", "name", names.repair_mojibake(C("name")).alias("repaired"))


@query("mojibake_texts", ORACLES["mojibake_names"].replace(
    "SELECT p_partkey AS doc_id, translate(p_name, 'aeiou', 'аеиоу') || '.txt' AS name FROM part", "SELECT doc_id, text AS name FROM {script_text}"))
def mojibake_texts(t):
    """Whole texts, two thirds of them with the bytes of UTF-8 read as Latin-1."""
    broken = F.decode(F.encode(C("text"), "UTF-8"), "ISO-8859-1")
    return t.script_text.select(
        "doc_id", F.when(C("doc_id") % 3 == 0, C("text")).otherwise(broken).alias("name")
    ).select("doc_id", "name", names.repair_mojibake(C("name")).alias("repaired"))


@query(
    "stored_filenames",
    rf"""WITH n AS (SELECT page_id, url, regexp_replace(url, '^.*/', '') || '.PDF' AS name, sha256(html) AS h FROM pages),
    x AS (SELECT *, CASE WHEN name = '.PDF' THEN '' ELSE '.pdf' END AS ext FROM n)
    SELECT page_id, name, ext, substr(h, 1, 12) || '__' || coalesce(nullif(substr(regexp_replace(
      {duck.sub("substr(name, 1, length(name) - length(ext))", "[^A-Za-z0-9._-]+", "_")}, '^[.\-_]+', ''), 1, 120), ''), 'unnamed') || ext AS stored_name,
      coalesce(nullif(substr(regexp_replace({duck.sub("url", "[^A-Za-z0-9._-]+", "_")}, '^[.\-_]+', ''), 1, 120), ''), 'unnamed') AS url_segment,
      {duck.path_segment('url')} AS path_segment, {duck.slug('name')} AS slug FROM x""",
)
def stored_filenames(t):
    named = t.pages.select(
        "page_id", "url", F.concat(names.base_name(C("url")), F.lit(".PDF")).alias("name"),
        F.sha2("html", 256).alias("_hash"),
    ).withColumn("ext", names.extension(C("name")))
    return named.select(
        "page_id", "name", "ext",
        names.stored_filename(C("name"), C("ext"), C("_hash")).alias("stored_name"),
        names.sanitize_path_segment(C("url")).alias("url_segment"),
        grounding.path_segment(C("url")).alias("path_segment"),
        grounding.name_slug(C("name")).alias("slug"),
    )


@query(
    "agent_names",
    f"""SELECT p_partkey, substr('agent-' || coalesce(nullif({duck.sub(duck.sub("lower(code)", "[^a-z0-9-]+", "-"), "^-+|-+$", "")}, ''),
       CAST(p_partkey AS VARCHAR)), 1, 100) AS agent_id, code || ' - ' || p_name AS kb_name
    FROM (SELECT *, CASE WHEN p_partkey % 10 = 0 THEN '##' ELSE p_brand || ' / ' || p_type END AS code FROM part)""",
)
def agent_names(t):
    parts = t.part.withColumn(
        "code", F.when(C("p_partkey") % 10 == 0, "##").otherwise(F.concat_ws(" / ", "p_brand", "p_type"))
    )
    return parts.select(
        "p_partkey",
        names.agent_slug(C("code"), C("p_partkey")).alias("agent_id"),
        names.kb_name(C("code"), C("p_name")).alias("kb_name"),
    )


@query(
    "short_messages",
    "SELECT doc_id, CASE WHEN length(text) > 140 THEN substr(text, 1, 140) || '…' ELSE text END AS message FROM documents",
)
def short_messages(t):
    return t.documents.select("doc_id", shorten(C("text")).alias("message"))


@query(
    "file_sizes",
    f"SELECT material_id, {duck.round_to('file_size / 1048576', 2)} AS size_mb FROM {{materials}}",
)
def file_sizes(t):
    return t.materials.select("material_id", names.file_size_mb(C("file_size")).alias("size_mb"))
