"""The registered queries of this package, next to the DuckDB SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import (
    conversation_repair, conversation_sql, jaccard, language_id, licences, mixing, partition_search, pieces, repeats,
    secrets, syncmers, token_alignment, toxicity, url_rules,
)
from foliant.llm.shared import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = configure(spark).read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


@query
def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLES["op3_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
    CAST('0x' || substr(md5('17:' || coalesce(CAST(doc_id AS VARCHAR), chr(0))), 1, 15) AS BIGINT) AS key,
    CAST('0x' || substr(md5('17:' || coalesce(text, chr(0))), 1, 15) AS BIGINT) AS tie
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS w,
    2.0::DOUBLE * sum(size) AS cap
  FROM d GROUP BY source),
f AS (
  SELECT *, coalesce(sum(cap) OVER e, 0) AS given, sum(w) OVER () - coalesce(sum(w) OVER e, 0) AS free,
    1.5::DOUBLE * sum(source_size) OVER () AS total,
    row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS i
  FROM s WINDOW e AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rate AS (
  SELECT (total - given) / free AS rate FROM f WHERE (total - given) / free <= cap / w ORDER BY i LIMIT 1),
t AS (
  SELECT source, source_size, least(cap, w * rate) AS target FROM f CROSS JOIN rate),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
g AS (
  SELECT source, key, tie, size, count(*) AS n,
    sum(sum(size)) OVER (PARTITION BY source ORDER BY key, tie) - sum(size) AS before
  FROM d GROUP BY source, key, tie, size),
x AS (
  SELECT d.doc_id, d.size, source_size, target, epochs, g.n, before,
    CAST(round(target - epochs * source_size) AS BIGINT) AS rest
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source AND d.key = g.key AND d.tie = g.tie
  JOIN b ON d.source IS NOT DISTINCT FROM b.source),
y AS (
  SELECT *, CAST(epochs * size + greatest(0, least(size, floor((rest - before) / n))) AS BIGINT) AS taken FROM x)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, taken,
  CAST(CASE WHEN size > 0 THEN round(taken / size) ELSE 0 END AS INTEGER) AS copies
FROM y
"""


@query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda x: x["kind"] != "random")

    def count(kind):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", "spans", base.alias("base")).select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


# The rules of the registered query.
URL_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


@query
def op2_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", "page_id", "url")
    return url_rules.judge(pages, URL_RULES).drop("url")


ORACLES["op2_url_rules"] = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC NULLS LAST, length(rpath) DESC) AS k
  FROM h LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""


@query
def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_groups(read(spark, sf_dir, "documents", "doc_id", "text"), 3, 90, 100)


@query
def op9_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.link_counts(read(spark, sf_dir, "documents", "doc_id", "text"), 3, 90, 100)


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.learn(docs, read(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


@query
def op1_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.edited(read(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(read(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("places.label")), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )


@query
def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents", "doc_id", "text")).drop("spans")


@query
def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents", "doc_id", "text")).drop("text")


@query
def op4_partition_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return partition_search.search(rows, F.col("vec_id") % 50 == 0)


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment(read(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return conversation_repair.repair(conversation_repair.damage(rows))


ORACLES["op12_conversation_repair"] = conversation_sql.REPAIR


@query
def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    learnt = language_id.prototypes(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    found = language_id.predict(read(spark, sf_dir, "documents", "doc_id", "text"), learnt)
    return found.select(
        "doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
