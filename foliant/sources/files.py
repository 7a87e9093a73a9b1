"""Whole files as rows, and the grounded Markdown store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.names import TEXT_EXTENSIONS, UPLOAD_EXTENSIONS, base_name, extension
from foliant.functions.typography import normalise_newlines

MAX_BYTES = 50 * 1024 * 1024


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def reject_reason(ext: Column, size: Column, max_bytes: int) -> Column:
    return (
        F.when(size > max_bytes, "too_large")
        .when(~ext.isin(UPLOAD_EXTENSIONS), "extension")
        .when(~ext.isin(TEXT_EXTENSIONS), "not_text")
    )


def decode_text(content: Column) -> Column:
    """UTF-8 with U+FFFD for bad bytes and every line end as one newline."""
    return normalise_newlines(F.make_valid_utf8(content.cast("string")))


def text_files(files):
    """A reader (batch or stream) of whole files, limited to names that text files have."""
    endings = ",".join("".join(f"[{c}{c.upper()}]" for c in e[1:]) for e in TEXT_EXTENSIONS)
    return files.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{endings}}}")


def read_text_corpus(
    spark: SparkSession, path: str, max_bytes: int = MAX_BYTES
) -> DataFrame:
    """Files below ``path`` as ``(path, name, ext, size, modified_at, file_hash, text, reject_reason)``.

    Two reads: one of text files whose length, tested on the listing, is allowed, with content, and
    one of the listing alone for those that are rejected. The content of a rejected file is never
    opened, so one that is beyond what the reader takes is listed and does no harm.
    """
    accepted = describe_files(text_files(spark.read).load(path).where(F.col("length") <= max_bytes), max_bytes)
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).drop("content")
    rejected = described(listing, max_bytes).where(F.col("reject_reason").isNotNull()).withColumns(
        {"file_hash": F.lit(None).cast("string"), "text": F.lit(None).cast("string")}
    )
    return accepted.where(F.col("reject_reason").isNull()).unionByName(rejected)


def described(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """What is known of files without opening them; other columns, such as ``content``, stay."""
    name = base_name(F.col("path"))
    named = files.withColumns({"name": name, "ext": extension(name)})
    rest = [c for c in files.columns if c not in ("path", "length", "modificationTime")]
    return named.select(
        "path", "name", "ext", F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"),
        reject_reason(F.col("ext"), F.col("length"), max_bytes).alias("reject_reason"), *rest,
    )


def describe_files(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``described`` with hash and text of what is not rejected; ``files`` come with their content."""
    fine = F.col("reject_reason").isNull()
    return described(files, max_bytes).select(
        "path", "name", "ext", "size", "modified_at",
        F.when(fine, content_hash(F.col("content"))).alias("file_hash"),
        F.when(fine, decode_text(F.col("content"))).alias("text"),
        "reject_reason",
    )


def accepted_files(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected_files(corpus: DataFrame) -> DataFrame:
    return corpus.where(F.col("reject_reason").isNotNull()).drop("text", "file_hash")


def export_markdown(df: DataFrame, path: str) -> None:
    """One text file per Markdown path: a folder of that name with one part in it.

    Grounded Markdown ends with a newline, and so does every record that Spark writes as text.
    """
    (
        df.select("md_path", F.regexp_replace("markdown", r"\n\z", "").alias("value"))
        .repartition("md_path")
        .write.mode("overwrite").partitionBy("md_path").text(path)
    )
