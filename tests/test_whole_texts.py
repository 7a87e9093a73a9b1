"""Queries over books and names take every page and every text whole."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_every_page_is_grounded(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").where(F.col("text").rlike(r"\S"))
    pages = {r.source: r["count"] for r in documents.groupBy("source").count().collect()}
    found = entry.queries()["whole_book_totals"](spark, FOLDER).collect()
    assert {r.doc_id: r.chunk_count for r in found} == pages


def test_whole_texts_are_repaired(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    found = entry.queries()["mojibake_texts"](spark, FOLDER).join(documents, "doc_id")
    assert found.count() == documents.count()
    assert found.where(F.char_length("name") < F.char_length("text")).count() == 0
