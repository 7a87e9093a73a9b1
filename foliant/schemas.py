"""Table schemas, as DDL, and the fixed values of their columns."""

from __future__ import annotations

MODULES = (
    "module_id STRING, code STRING, name STRING, description STRING, order_index INT, "
    "kb_id STRING, agent_id STRING, is_active BOOLEAN, created_at TIMESTAMP_NTZ, "
    "updated_at TIMESTAMP_NTZ"
)
TOPICS = (
    "topic_id STRING, module_id STRING, code STRING, name STRING, description STRING, "
    "order_index INT, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
)
MATERIALS = (
    "material_id STRING, topic_id STRING, type STRING, raw_file_path STRING, "
    "original_filename STRING, file_size BIGINT, file_hash STRING, status STRING, "
    "error_message STRING, md_file_path STRING, chunk_count INT, char_count INT, "
    "detected_script STRING, extraction_method STRING, ocr_page_count INT, "
    "ocr_confidence DOUBLE, ocr_languages STRING, force_ocr BOOLEAN, progress_message STRING, "
    "index_file_id STRING, indexed_at TIMESTAMP_NTZ, uploaded_by STRING, "
    "created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
)
AUDIT_LOGS = (
    "log_id STRING, material_id STRING, module_id STRING, stage STRING, level STRING, "
    "message STRING, created_at TIMESTAMP_NTZ"
)
PAGES = ("doc_id STRING, page_no INT, text STRING, has_image BOOLEAN")
PAGE_RESULTS = (
    "file_hash STRING, dpi INT, page_no INT, text STRING, confidence DOUBLE, engine STRING, "
    "languages STRING, error STRING"
)
# Word rows of a recogniser; row_no is their order in its output.
WORDS = (
    "doc_id STRING, row_no BIGINT, level INT, page INT, block INT, par INT, line INT, word INT, "
    "left INT, top INT, width INT, height INT, conf STRING, text STRING"
)
# Elements of slides in order; row tells the cells of one table row, and is -1 or NULL elsewhere.
SLIDE_ELEMENTS = ("doc_id STRING, slide INT, ord INT, row INT, kind STRING, text STRING")

TABLES = {
    "modules": MODULES,
    "topics": TOPICS,
    "materials": MATERIALS,
    "audit_logs": AUDIT_LOGS,
    "pages": PAGES,
    "page_results": PAGE_RESULTS,
    "words": WORDS,
    "slide_elements": SLIDE_ELEMENTS,
}

# Fixed values, in the order reports list them.
MATERIAL_TYPES = ["presentation", "questions", "literature"]
STATUSES = ["new", "queued", "converting", "md_ready", "uploading", "indexed", "failed"]
IN_PROGRESS = ["queued", "converting", "uploading"]
UNINDEXED = ["md_ready", "failed"]
LEVELS = ["info", "warn", "error"]
EXTRACTION_METHODS = ["text", "ocr", "mixed"]


def column_names(table: str) -> list[str]:
    return [column.split(" ")[0] for column in TABLES[table].split(", ")]
