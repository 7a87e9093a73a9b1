"""File and object names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import round_exact

# What may be uploaded, what is split into sections here, how a code looks.
UPLOAD_EXTENSIONS = [".docx", ".md", ".pdf", ".pptx", ".txt"]
TEXT_EXTENSIONS = [".txt", ".md"]
CODE_PATTERN = r"\A[A-Za-z0-9][A-Za-z0-9._-]*\n?\z"


def repair_mojibake(name: Column) -> Column:
    """Undo UTF-8 read as latin-1, when every character allows it and the bytes are UTF-8."""
    latin = name.rlike(r"\A[\x00-\xff]*\z")
    raw = F.encode(F.when(latin, name), "ISO-8859-1").cast("string")
    return F.coalesce(F.try_validate_utf8(raw), name)


def base_name(name: Column) -> Column:
    return F.substring_index(name, "/", -1)


def extension(name: Column) -> Column:
    """Lower-case suffix with its dot, '' without one or for a name that only starts with it."""
    return F.lower(F.regexp_extract(base_name(name), r"(?s)\A.+(\.[^.]+)\z", 1))


def sanitize_path_segment(c: Column, fallback: str = "unnamed") -> Column:
    safe = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"\A[.\-_]+", "")
    return F.coalesce(F.nullif(F.substring(safe, 1, 120), F.lit("")), F.lit(fallback))


def stored_filename(name: Column, ext: Column, content_hash: Column) -> Column:
    base = base_name(name)
    bare = F.when(
        (ext != "") & F.endswith(F.lower(base), F.lower(ext)),
        F.substring(base, F.lit(1), F.length(base) - F.length(ext)),
    ).otherwise(base)
    return F.concat(
        F.substring(content_hash, 1, 12), F.lit("__"), sanitize_path_segment(bare), ext
    )


def agent_slug(code: Column, key: Column, prefix: str = "agent-") -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(code), r"[^a-z0-9-]+", "-"), r"\A-+|-+\z", "")
    named = F.coalesce(F.nullif(slug, F.lit("")), key.cast("string"))
    return F.substring(F.concat(F.lit(prefix), named), 1, 100)


def kb_name(code: Column, name: Column) -> Column:
    return F.concat_ws(" - ", code, name)


def file_size_mb(size: Column) -> Column:
    return round_exact(size.cast("double") / 1048576, 2)
