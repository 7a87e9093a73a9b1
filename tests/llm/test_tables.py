"""Mixing, URL rules, nearest neighbours, the pipeline, and the queries that SQL can state."""

import math
import random

import duckdb
import numpy as np
import pytest

import check
import corpus_pipeline
from foliant.llm import mixing, partition_search, url_rules
from foliant.llm.queries import ORACLES, QUERIES, URL_RULES
from foliant.sources.fixtures import SOURCE_TABLES
from pyspark.sql import functions as F
from tests.llm.fixtures import WORD, documents, nothing, rows


def test_mix(spark):
    docs = documents(spark, extra=True)
    found = mixing.mix(docs).collect()
    sizes = {i: len(WORD.findall(t or "")) for i, t, *_ in rows()}
    source = {i: s for i, _, _, s, _ in rows()}
    names = sorted({s for s in source.values() if s is not None}) + [None]
    own = {s: sum(n for i, n in sizes.items() if source[i] == s) for s in names}
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(names)}
    target, left = {}, 1.5 * sum(own.values())
    free = set(names)
    while free:
        rate = left / sum(weight[s] for s in free)
        full = {s for s in free if weight[s] * rate > 2 * own[s]}
        if not full:
            target |= {s: weight[s] * rate for s in free}
            break
        target |= {s: 2.0 * own[s] for s in full}
        left -= sum(target[s] for s in full)
        free -= full
    assert len(found) == len(sizes)
    taken = dict.fromkeys(names, 0)
    for r in found:
        assert (r.size, r.source_size) == (sizes[r.doc_id], own[r.source])
        assert math.isclose(r.target, target[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.copies in (0, 1, 2)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in names)
    again = mixing.mix(docs.repartition(5)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in found}


def test_mix_of_repeated_rows_and_of_nothing(spark):
    docs = documents(spark)
    found = mixing.mix(docs.union(docs)).groupBy("doc_id").agg(F.countDistinct("taken").alias("n"))
    assert {r.n for r in found.collect()} == {1}
    assert mixing.mix(nothing(spark)).collect() == []
    assert mixing.mixed_documents(docs).columns == docs.columns


def test_key_ranges_do_not_change_the_mix(spark, monkeypatch):
    whole = {(r.doc_id, r.taken) for r in mixing.mix(documents(spark)).collect()}
    monkeypatch.setattr(mixing, "RANGE_ROWS", 1)
    assert {(r.doc_id, r.taken) for r in mixing.mix(documents(spark)).collect()} == whole


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Example.ORG", "http://example.org/es/x?q#f",
            "http://a.b.example.org/en/1", "http://a.example.org/en/19", "http://example.org/en/2",
            "http://notexample.org/es/x", "http://x.com/fr/", "http://x.com/de/1", "http://x.com/de",
            "http://com/fr/a", "http://x.com?a=/fr/", "x://y.org/es/://z.com/de/", "a\nb://x.com/de/1"]
    pages = spark.createDataFrame(list(enumerate(urls)) + [(4, urls[4])], "page_id long, url string")
    found = url_rules.judge(pages.withColumn("rule", F.lit("old")), URL_RULES).collect()
    assert len(found) == len(urls) + 1
    for r in found:
        head, mark, rest = (r.url or "").partition("://")
        stop = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest)) if mark else 0
        host, tail = (rest[:stop].lower(), rest[stop:]) if mark else ("", "")
        path = tail[:next((i for i, c in enumerate(tail) if c in "?#"), len(tail))]
        fits = [(h.count("."), len(p), h + p, v) for v, h, p in URL_RULES
                if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else (0, 0, None, "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[2], best[3]), r.url


def test_rules_that_tie_or_are_too_many(monkeypatch):
    trie = url_rules.Trie([("block", "a.b", "/x"), ("allow", "a.b", "/x"), ("allow", "b", "/x/yz")])
    assert trie.find("c.a.b", "/x/yz") == ("a.b/x", "block")
    assert trie.find("b", "/x/y") is None
    monkeypatch.setattr(url_rules, "MOST_RULES", 1)
    with pytest.raises(ValueError):
        url_rules.Trie([("block", "a", "/"), ("block", "b", "/")])


def vectors(n, size=12):
    rng = random.Random(6)
    table = [(i, [rng.gauss(0, 1) for _ in range(size)]) for i in range(n)]
    table += [(n + i, list(table[7][1])) for i in range(40)]
    bad = [None, [], [0.0] * size, [None] + [1.0] * (size - 1), [float("nan")] * size,
           [float("inf")] + [1.0] * (size - 1), [1.0] * (size + 1)]
    return table, [(10_000 + 50 * i, v) for i, v in enumerate(bad)] + [(None, [1.0] * size), table[50]]


def exact(table, k):
    unit = {i: [x / math.sqrt(sum(y * y for y in v)) for x in v] for i, v in table}
    out = {}
    for q in unit:
        if q % 50 == 0:
            near = sorted((-round(sum(a * b for a, b in zip(unit[q], v)), 12), i)
                          for i, v in unit.items() if i != q)
            out[q] = [i for _, i in near[:k]]
    return out


def test_neighbours(spark):
    table, bad = vectors(1500)
    df = spark.createDataFrame(table + bad, "vec_id long, embedding array<float>").withColumn("part", F.lit(1))
    found = partition_search.search(df, F.col("vec_id") % 50 == 0).collect()
    true = exact(table, 5)
    assert {r.query_id for r in found} == set(true)
    hits = 0
    for q, ids in true.items():
        mine = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5]
        assert [m[2] for m in mine] == sorted((m[2] for m in mine), reverse=True)
        hits += len({m[1] for m in mine} & set(ids))
    assert hits / (5 * len(true)) >= 0.9


def test_few_neighbours(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [2.0, 0.0]), (4, [0.0, 1.0])],
                                "vec_id long, embedding array<float>")
    found = partition_search.search(few, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in found] == [
        (0, 1, 3), (0, 2, 50), (0, 3, 4), (50, 1, 0), (50, 2, 3), (50, 3, 4)]
    assert partition_search.search(few.where("false"), F.lit(True)).collect() == []


def test_pipeline_stages(spark, tmp_path):
    """Every stage on its own input: columns, and what its decisions must leave."""
    docs = documents(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near duplicates", "secrets", "mix", "pieces"]
    clean = stages["toxicity"](spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and clean.count() == len(rows())
    left = stages["near duplicates"](spark, docs, str(tmp_path))
    ids = {r.doc_id for r in left.collect()}
    assert left.columns == docs.columns and 0 in ids and not ids & set(range(1, 9))
    assert {i for i, t, *_ in rows() if not (t or "").strip()} <= ids
    secret = "token = 4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e"
    marked = docs.withColumn("text", F.concat("text", F.lit(" " + secret)))
    masked = stages["secrets"](spark, marked, str(tmp_path)).collect()
    assert all(r.text is None or (secret not in r.text and len(r.text) == r.n_chars) for r in masked)
    assert len(masked) == len(rows())
    # Columns that operators have too keep the values that came.
    names = ["score", "spans", "predicted", "_changed", "_text", "size", "taken", "copies", "a.b"]
    clashing = marked.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names])
    for name in ("toxicity", "near duplicates", "secrets", "mix"):
        out = stages[name](spark, clashing, str(tmp_path))
        assert out.columns == clashing.columns
        found = out.collect()
        assert found and all(r[c] == f"{c}{r.doc_id}" for r in found for c in names)
    total = corpus_pipeline.run(spark, str(tmp_path))
    assert "text" not in total.columns and total.count() > 0


def test_pipeline_of_nothing(spark, tmp_path):
    nothing(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_scores_of_very_large_and_small_vectors():
    rng = np.random.default_rng(3)
    one, many = rng.normal(size=(50, 8)), rng.normal(size=(50, 8))
    plain = (one * many).sum(1) / (np.sqrt((one * one).sum(1)) * np.sqrt((many * many).sum(1)))
    assert (partition_search._scores(one, many) == plain).all()
    assert np.allclose(partition_search._scores(one * 1e200, many * 1e-200), plain)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in SOURCE_TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    result = check.compare(spark, db, folder, name, QUERIES[name], ORACLES[name])
    assert result[0] == "ok", result
