"""The catalog and document shapes derived from the TPC-H-like test tables.

The SQL below runs unchanged in Spark and in DuckDB, so queries and their oracles start from
the same rows. ``{name}`` stands for a driver table or an earlier shape.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.ordering import bucket_of, number_rows
from foliant.operators.rows import each
from foliant.sources.tables import spread

SOURCE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# Tables whose rows carry much text: a single-file copy is spread over the cores.
TEXT_TABLES = ("documents", "pages")

NL, CR, ZW, NB = "\n", "\r", "\u200b", "\u00a0"

SHAPES = {
    "modules": """
SELECT r_regionkey AS module_id, concat('module-0', CAST(r_regionkey AS STRING)) AS code,
       r_name AS name, concat('Course on ', r_name) AS description,
       CAST(r_regionkey % 3 AS INT) AS order_index, r_regionkey <> 4 AS is_active,
       CASE WHEN r_regionkey = 2 THEN NULL ELSE concat('kb-', CAST(r_regionkey AS STRING)) END AS kb_id,
       CASE WHEN r_regionkey < 2 THEN concat('agent-', CAST(r_regionkey AS STRING)) END AS agent_id,
       CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS created_at
FROM {region}""",
    "topics": """
SELECT n_nationkey AS topic_id, n_regionkey AS module_id,
       concat('topic-', lpad(CAST(n_nationkey AS STRING), 2, '0')) AS code, n_name AS name,
       concat('About ', n_name) AS description, n_nationkey AS order_index
FROM {nation}""",
    "materials": """
SELECT o.o_orderkey AS material_id, c.c_nationkey AS topic_id,
       CASE o.o_orderkey % 3 WHEN 0 THEN 'presentation' WHEN 1 THEN 'questions' ELSE 'literature' END AS type,
       CASE o.o_orderkey % 7 WHEN 0 THEN 'new' WHEN 1 THEN 'queued' WHEN 2 THEN 'converting' WHEN 3 THEN 'md_ready'
            WHEN 4 THEN 'uploading' WHEN 5 THEN 'indexed' ELSE 'failed' END AS status,
       concat('Doc ', CAST(o.o_orderkey AS STRING), CASE WHEN o.o_orderkey % 5 = 0 THEN '.txt' ELSE '.pdf' END) AS original_filename,
       CAST(floor(o.o_totalprice * 100) AS BIGINT) AS file_size,
       md5(concat(CAST(c.c_nationkey AS STRING), '/', CAST(o.o_orderkey % 97 AS STRING))) AS file_hash,
       CASE WHEN o.o_orderkey % 4 = 0 THEN 'ocr' WHEN o.o_orderkey % 4 = 1 THEN 'mixed' ELSE 'text' END AS extraction_method,
       CASE WHEN o.o_orderkey % 4 < 2 THEN CAST(o.o_orderkey % 101 AS DOUBLE) END AS ocr_confidence,
       CASE o.o_orderkey % 6 WHEN 0 THEN 'uz-cyrl' WHEN 1 THEN 'ru' WHEN 2 THEN 'other' ELSE 'uz-latn' END AS detected_script,
       CASE WHEN o.o_orderkey % 8 <> 0 THEN o.o_custkey END AS uploaded_by,
       o.o_orderdate AS created_at
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey""",
    "users": "SELECT c_custkey AS user_id, concat(lower(c_name), '@example.org') AS email FROM {customer} WHERE c_custkey % 9 <> 0",
    "audit_logs": """
SELECT event_id AS log_id, CASE WHEN event_id % 10 <> 0 THEN user_id END AS material_id,
       CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 5 AS INT) END AS module_id, event_type AS stage,
       CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS level,
       props AS message, ts AS created_at
FROM {events}""",
    "doc_pages": """
SELECT source AS doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS page_no,
       doc_id % 3 <> 0 AS has_image, text, doc_id AS item
FROM {documents}""",
    "dirty_text": """
SELECT doc_id, lang, source, replace(replace(replace(replace(replace(replace(text, 'tion', 'ti-{NL}on'), ', ', ',{CR}{NL}'), ' th', '{NB}{ZW}th'),
       'The ', 'ShAHARShUNOSLIK Shahar '), '. ', '.{NL}{NL}{NL}{NL}'), 'é', 'e{ACUTE}') AS text
FROM {documents}""",
    "script_text": """
SELECT doc_id, lang, source, CASE lang
   WHEN 'en' THEN translate(text, 'abvgdjziyklmnoprstufxehqwABVGDJZIYKLMNOPRSTUFXEHQW', 'абвгджзийклмнопрстуфхеҳқўАБВГДЖЗИЙКЛМНОПРСТУФХЕҲҚЎ')
   WHEN 'fr' THEN translate(text, 'abvgdjziyklmnoprstufxehqwABVGDJZIYKLMNOPRSTUFXEHQW', 'абвгджзийклмнопрстуфхещыёАБВГДЖЗИЙКЛМНОПРСТУФХЕЩЫЁ')
   ELSE text END AS text
FROM {documents}""",
    "ocr_text": """
SELECT doc_id, CASE lang WHEN 'en' THEN replace(replace(text, 'о', 'o'), 'с', 'c')
       ELSE replace(replace(replace(replace(text, 'ar', 'аr'), 'en', 'e''n'), 'oi', 'o`i'), 'ti', 'tʻi') END AS text
FROM {script_text}""",
    "section_text": """
SELECT doc_id, replace(text, '. ', '.{NL}{NL}{NL}') AS parts_text, replace(text, '. ', '.{NL}## ') AS md_text
FROM {documents}""",
    "book_pages": """
SELECT doc_id, page_no, has_image, item, concat('UMUMIY KURS ', CAST(page_no AS STRING), '{NL}|~|{NL}', text, '{NL}{NL}- ', CAST(page_no AS STRING), ' -') AS text
FROM {doc_pages}""",
    "layer_pages": """
SELECT doc_id, page_no, has_image, item, CASE WHEN item % 4 = 0 THEN '' WHEN item % 9 = 0 THEN substr(text, 1, 25) ELSE text END AS text
FROM {doc_pages}""",
    "ocr_results": """
SELECT doc_id, page_no, CASE WHEN item % 10 = 0 OR item % 22 = 0 THEN '' ELSE text END AS text,
       CAST(item * 37 % 101 AS DOUBLE) AS confidence, CASE WHEN item % 22 = 0 THEN 'timeout' END AS error, item % 14 = 0 AS cached
FROM {book_pages} WHERE item % 2 = 0""",
    "read_pages": """
SELECT *, CASE WHEN page_no <= 18 THEN 'uzb+uzb_cyrl+rus' WHEN page_no % 2 = 0 THEN 'uzb' ELSE 'rus' END AS languages FROM {ocr_results}""",
    "probe_pages": """
SELECT p.source AS doc_id, p.page_no, CASE WHEN p.page_no % 5 < 2 THEN concat(CAST(p.page_no AS STRING), ' -') ELSE s.text END AS text,
       p.doc_id % 97 = 0 AS cached
FROM (SELECT doc_id AS source, page_no, item AS doc_id FROM {doc_pages}) p JOIN {script_text} s ON p.doc_id = s.doc_id""",
    "page_results": """
SELECT doc_id AS file_hash, page_no, CASE WHEN item % 5 = 0 THEN 200 ELSE 300 END AS dpi, text,
       CAST(item * 37 % 101 AS DOUBLE) AS confidence, CASE WHEN item % 11 = 0 THEN 'timeout' END AS error
FROM {doc_pages}""",
    "failures": """
SELECT event_id, user_id AS material_id, ts AS failed_at,
       CASE event_id % 4 WHEN 0 THEN '400: 429, message=Too Many Requests' WHEN 1 THEN '400: 503, message=Service Unavailable'
            WHEN 2 THEN '400: File not found' ELSE 'file a10526f3-4290-4c7f-9f89-503f1409b613 missing' END AS detail
FROM {events} WHERE event_type = 'error'""",
    "kbs": "SELECT concat('kb-', CAST(r_regionkey AS STRING)) AS kb_id, CASE WHEN r_regionkey = 0 THEN concat('module-00 - ', r_name) ELSE r_name END AS name FROM {region} WHERE r_regionkey <> 3",
    "agents": "SELECT concat('agent-', CAST(r_regionkey AS STRING)) AS agent_id, r_name AS name, concat('kb-', CAST(r_regionkey % 4 AS STRING)) AS kb_id, r_regionkey <> 3 AS is_active FROM {region} WHERE r_regionkey <> 1",
    "text_documents": """
SELECT d.doc_id AS material_id, concat('module-0', CAST(length(d.source) % 5 AS STRING)) AS module_code, concat('Module {Q}', d.lang, '{Q}') AS module_name,
       concat('topic ', d.source) AS topic_code, concat('Topic ', d.source) AS topic_name, 'literature' AS type,
       concat('Kitob | ', CAST(d.doc_id AS STRING), '].TXT') AS original_filename, d.text
FROM (SELECT s.doc_id, s.lang, s.source, replace(s.text, '. ', '.{NL}{NL}{NL}') AS text FROM {script_text} s) d""",
    "moved_documents": """
SELECT material_id, CASE module_name WHEN 'Module {Q}fr{Q}' THEN 'module-09' ELSE module_code END AS module_code, module_name,
       topic_code, topic_name, type, original_filename, text
FROM {text_documents}""",
    "book_meta": """
SELECT DISTINCT source AS doc_id, 'module-01' AS module_code, 'Books' AS module_name, concat('topic ', source) AS topic_code,
       concat('Topic ', source) AS topic_name, 'literature' AS type, concat(source, '.pdf') AS original_filename
FROM {documents}""",
}

_CHARACTERS = {
    "{NL}": NL, "{CR}": CR, "{ZW}": ZW, "{NB}": NB, "{ACUTE}": "\u0301", "{Q}": '"',
}


def shape_sql(name: str) -> str:
    sql = SHAPES[name]
    for mark, character in _CHARACTERS.items():
        sql = sql.replace(mark, character)
    return sql


class Tables:
    """Driver tables and shapes of one folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in SOURCE_TABLES:
            table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return spread(table) if name in TEXT_TABLES else table
        if name == "doc_pages":
            return self._doc_pages()
        if name == "words":
            return self._words(self.doc_pages)
        if name == "words_by_page":
            # Pages are shuffled instead of their words, which take several times the room. With a number
            # given, small partitions are not joined: their words are to fit in a task's memory.
            parts = 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            return self._words(self.doc_pages.repartition(parts, "doc_id", "page_no"))
        if name == "slide_elements":
            return self._slide_elements()
        sql = shape_sql(name)
        used = {
            table: getattr(self, table)
            for table in [*SOURCE_TABLES, *SHAPES]
            if "{" + table + "}" in sql
        }
        return self.spark.sql(sql, **used)

    def _doc_pages(self) -> DataFrame:
        """The window of the SQL form, without sorting a whole source in one task."""
        numbered = number_rows(
            self.documents.select("source", "doc_id", "text"), ["source"], [F.col("doc_id")],
            bucket_of("doc_id"), "_page",
        )
        return numbered.select(
            F.col("source").alias("doc_id"),
            F.col("_page").cast("int").alias("page_no"),
            (F.col("doc_id") % 3 != 0).alias("has_image"),
            "text",
            F.col("doc_id").alias("item"),
        )

    def _words(self, pages: DataFrame) -> DataFrame:
        """One row per space-separated word of each page."""
        page = ["doc_id", "page_no", "item"]
        lines = each(pages, page, F.split("text", "\n"), "at", "line_text")
        words = each(lines, [*page, "at"], F.split("line_text", " "), "word", "text")
        pos = F.col("at") * 1000 + F.col("word")
        return words.select(
            "doc_id",
            (F.col("at").cast("long") * 1000000 + F.col("word")).alias("row_no"),
            F.lit(5).alias("level"),
            F.col("page_no").alias("page"),
            F.lit(1).alias("block"),
            (1 + F.floor(F.col("at") / 5)).cast("int").alias("par"),
            (F.col("at") % 5).alias("line"),
            "word",
            F.when((F.col("item") + pos) % 13 == 0, -1)
            .otherwise((F.col("item") * 31 + pos * 7) % 101).cast("string").alias("conf"),
            "text",
        )

    def _slide_elements(self) -> DataFrame:
        slide = F.floor(F.col("turn") / 2).cast("int")
        cell = F.col("role") == "assistant"
        return self.conversations.select(
            F.col("conv_id").alias("doc_id"),
            slide.alias("slide"),
            F.col("turn").alias("ord"),
            F.when(cell, -1).otherwise(F.col("turn")).alias("row"),
            F.when(F.col("role") == "system", "note").when(cell, "cell").otherwise("paragraph")
            .alias("kind"),
            "text",
        )
