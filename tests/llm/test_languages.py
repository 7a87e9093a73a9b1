"""Hyperdimensional profiles: vectors against plain sums, and held-out accuracy."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import language_id as g
from tests.llm.fixtures import documents, nothing


def plain_vector(text):
    """Sum over all n-grams of the products of rotated letter vectors."""
    letters = [ord(ch) if ch.isalpha() else 0 for ch in text.lower()]
    line = [0]
    for x in [*letters, 0]:
        if x or line[-1]:
            line.append(x)
    total = np.zeros(g.DIMENSIONS)
    for a, b, z in zip(line, line[1:], line[2:]):
        total += (np.roll(g.letter_vector(a), 2) * np.roll(g.letter_vector(b), 1) * g.letter_vector(z)).astype(float)
    length = np.sqrt(total @ total)
    return total / length if length else total


TEXTS = ["", " \n", "a", "Ab", "12 34", "Ça va? Été!", "한국어 말", "x" * 3000, "The cat; the mat.", None, "😀é😀"]


def test_bundles_are_sums(monkeypatch):
    want = np.array([plain_vector(t or "") for t in TEXTS])
    assert np.allclose(g.bundle(TEXTS), want, atol=1e-6)
    monkeypatch.setattr(g, "PIECE", 3)
    monkeypatch.setattr(g, "BOUND", 2)
    assert np.allclose(g.bundle(TEXTS), want, atol=1e-6)


def test_letters_are_nearly_orthogonal():
    vectors = np.stack([g.letter_vector(c) for c in range(97, 123)]).astype(float) / np.sqrt(g.DIMENSIONS)
    near = vectors @ vectors.T - np.eye(26)
    assert np.abs(near).max() < 0.2


@pytest.mark.parametrize("extra", [False, True])
def test_held_out_documents(spark, extra):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    if extra:
        docs = docs.selectExpr("*", "'x' AS lang_pred", "1 AS n")
    learnt = g.prototypes(docs)
    assert [lang for lang, _ in learnt] == ["de", "en", "es", "fr"]
    found = g.predict(docs, learnt)
    held = found.where(g.held_out(F.col("doc_id"))).select("doc_id", "lang", "lang_pred", "score").collect()
    assert {r.doc_id for r in held} == {
        r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in held)
    assert found.count() == docs.count()


def test_held_out_rows_and_rows_without_id_teach_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    changed = docs.withColumn("lang", F.when(g.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    more = changed.unionByName(docs.limit(20).withColumn("doc_id", F.lit(None).cast("long")).withColumn("lang", F.lit("yy")))
    again = dict(g.prototypes(more))
    once = dict(g.prototypes(docs))
    assert again.keys() == once.keys() and all(np.allclose(once[k], again[k]) for k in once)


def test_awkward_rows(spark):
    docs = documents(spark, extra=True)
    learnt = g.prototypes(docs)
    found = {r.doc_id: r for r in g.predict(docs, learnt).collect()}
    for r in docs.collect():
        letters = any(ch.isalpha() for ch in r.text or "")
        assert (found[r.doc_id].lang_pred == "en") == letters
        assert letters or (found[r.doc_id].lang_pred, found[r.doc_id].score) == (g.UNKNOWN, 0.0)
    assert {r.lang_pred for r in g.predict(docs, []).collect()} == {g.UNKNOWN}
    assert g.prototypes(nothing(spark)) == [] and g.predict(nothing(spark), learnt).collect() == []


def test_a_tie_goes_to_the_first_language(spark):
    docs = spark.createDataFrame([(i, "same words here", lang) for i, lang in enumerate(["b", "a"] * 8)],
                                 "doc_id long, text string, lang string")
    assert {r.lang_pred for r in g.predict(docs, g.prototypes(docs)).collect()} == {"a"}
