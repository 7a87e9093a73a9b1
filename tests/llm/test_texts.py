"""Secrets, licences, toxicity and pieces against plain statements, round trips and held-out rows."""

import hashlib
import math
import random
import re
import sys
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from foliant.llm import licences, pieces, secrets, toxicity
from foliant.llm.queries import op7_licences, op10_secrets
from tests.llm.fixtures import ALNUM, LOWER, SCHEMA, documents, nothing, rows

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.I | re.A)


def with_secrets():
    rng = random.Random(3)
    hexes = ["".join(rng.choices("0123456789abcdef", k=40)) for _ in range(5)]
    keys = ["AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16)) for _ in range(3)]
    return [
        f"token = \"{hexes[0]}\" and {keys[0]}", f"é😀 {keys[1]}{keys[2]} PASSWORD:abc secret:token:abcdefgh",
        hexes[1] + hexes[2], "api_key=short1 apikey='x' passwd =  longenough", "AKIASHORT deadbeef",
        f"plain {hexes[3]} words and internationalisation counterrevolutionaries",
        "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=44)),
        None, "", "2024-01-01-2024-01-02 1234567890123456789012",
    ]


def test_secrets(spark, tmp_path):
    texts = with_secrets()
    table = [(i, t, "en", "s", 0) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 0)]
    spark.createDataFrame(table, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    found = op10_secrets(spark, str(tmp_path)).collect()
    assert len(found) == len(table)
    for r in found:
        text = texts[r.doc_id] or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text)
                  if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(r.spans.split(","))
    by = {r.doc_id: r.spans for r in found}
    assert "random" in by[6] and "random" in by[5] and "random" not in by[9]
    assert by[5].count("random") == 1 and by[7] == by[8] == ""


def test_masking(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(with_secrets())], SCHEMA)
    found = secrets.scan(docs)
    masked = found.select("doc_id", "text", "spans",
                          secrets.redacted(found["text"], found["spans"]).alias("out")).collect()
    for r in masked:
        covered = {i for s in r.spans for i in range(s.start, s.stop)}
        expected, i = "", 0
        while i < len(r.text or ""):
            if i not in covered:
                expected, i = expected + r.text[i], i + 1
                continue
            expected += "[SECRET]"
            while i in covered:
                i += 1
        assert r.out == (expected if r.spans else r.text)


def test_secrets_of_nothing_and_with_clashing_columns(spark):
    assert secrets.scan(nothing(spark)).collect() == []
    assert secrets.scan(documents(spark, extra=True)).count() == len(rows())


def test_licences(spark, tmp_path):
    documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    phrases = [(p.split(), label) for p, label in licences.PHRASES]
    found = op7_licences(spark, str(tmp_path)).collect()
    assert len(found) == len(rows())
    texts = {i: t or "" for i, t, *_ in rows()}
    for r in found:
        words = ALNUM.findall(texts[r.doc_id].translate(LOWER))
        places = [(i, x) for i in range(len(words)) for p, x in phrases if words[i:i + len(p)] == p]
        starts = [i for i, _ in places]
        assert (r.n_words, r.n_base) == (len(words), len(places))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1


def test_notices_without_their_name_are_found():
    scanner = licences.Scanner()
    mit = licences.TEMPLATES[0][1].replace("MIT", "")
    words = mit.split()
    # A changed word and a dropped one in the middle do not hide the notice.
    edited = " ".join(["before"] * 30 + words[:30] + ["CHANGED"] + words[31:50] + words[52:] + ["after"])
    chains = scanner.scan(licences.words_of(edited)[0])["chains"]
    label, start, stop, covered = max(
        ((scanner.templates[t][0], a, b, c) for t, a, b, c in chains), key=lambda x: x[3])
    assert label == "mit" and start == 30 and covered > 0.9 and stop > 100


def test_matching_statistics_by_definition():
    rng = random.Random(4)
    templates = [("x", " ".join(rng.choices("abcd", k=30))), ("y", " ".join(rng.choices("abcd", k=25)))]
    scanner = licences.Scanner(templates, [("a b", "p"), ("c a d", "q")])
    for _ in range(30):
        words = rng.choices("abcd", k=40)
        hashes = licences.words_of(" ".join(words))[0]
        got = scanner.scan(hashes)
        expected = [(i, k) for i in range(40) for k, p in enumerate((["a", "b"], ["c", "a", "d"]))
                    if words[i:i + len(p)] == p]
        assert sorted(got["phrases"]) == sorted(expected)


def toxic_rows(n):
    rng = random.Random(8)
    common = ["the", "and", "one", "tion", "ther", "stan", "ering", "reed", "with", "from", "onst"]
    bad = ["zorgblat", "quixmur", "vlendrak"]
    for i in range(n):
        words = ["".join(rng.choices(common, k=rng.randint(1, 3))) for _ in range(rng.randint(30, 120))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        yield i, " ".join(words), int(toxic)


def test_toxicity_on_held_out_rows(spark):
    table = list(toxic_rows(600))
    docs = spark.createDataFrame([(i, t) for i, t, _ in table] + [(1000, None), (1001, "")],
                                 "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS label")
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in table] + [(5, 1, None), (None, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, labels)
    found = toxicity.score(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(found) == 602
    truth = {i: x for i, _, x in table}
    held = [(r.predicted, truth[r.doc_id]) for r in found if r.held and r.doc_id < 1000]
    assert sum(p == t for p, t in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)


def test_toxic_words_of_a_rarer_language_are_learnt(spark):
    rng = random.Random(9)
    parts = [["the", "and", "tion", "ther", "ering", "reed"], ["los", "que", "ado", "mente", "cion", "esa"]]
    bad = [["zorgblat", "quixmur", "vlendrak"], ["pujarro", "gonfiqua"]]

    def text(kind, toxic):
        words = ["".join(rng.choices(parts[kind], k=rng.randint(1, 3))) for _ in range(60)]
        for _ in range(4 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(bad[kind]))
        return " ".join(words)

    # The rarer words are in less than 3 in 100 of the toxic texts.
    toxic = [text(0, 1) for _ in range(600)] + [text(1, 1) for _ in range(16)]
    ordinary = [text(0, 0) for _ in range(1000)] + [text(1, 0) for _ in range(200)]
    rng.shuffle(toxic)
    model = toxicity.fit(spark, toxic, ordinary)
    assert (model.scores([text(1, 1) for _ in range(50)]) >= 0.7).mean() > 0.8
    assert (model.scores([text(k % 2, 0) for k in range(100)]) >= 0.7).mean() < 0.05


def test_the_bound_on_ordinary_windows_is_a_parameter(spark, monkeypatch):
    sizes, trained = [], toxicity._trained
    monkeypatch.setattr(toxicity, "_trained", lambda size, samples, **settings: (
        sizes.append(len(samples)) or trained(size, samples, **settings)))
    texts = [text for _, text, _ in toxic_rows(60)]
    toxicity.fit(spark, texts[:20], texts[20:], windows=50)
    assert 50 <= sizes[0] < 100


def test_near_copies_of_a_toxic_text_mark_nothing(spark):
    rng = random.Random(10)

    def text():
        return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(60))

    copied = text()
    toxic = [f"{text()} zorgblat" for _ in range(60)] + [f"{copied} {i}" for i in range(60)]
    ordinary, toxic = (toxicity._apart(x) for x in ([text() for _ in range(300)], toxic))
    assert {g for g in marked(spark, toxic, ordinary)[-1] if g not in b" zorgblat"} == set()


def marked(spark, toxic, ordinary):
    rows = [(t, kind * toxicity.FOLDS + i % toxicity.FOLDS) for kind, texts in enumerate((ordinary, toxic))
            for i, t in enumerate(texts)]
    sizes = [[len(texts[f::toxicity.FOLDS]) for f in range(toxicity.FOLDS)] for texts in (toxic, ordinary)]
    return toxicity.marks(spark.createDataFrame(rows, "text string, kind int").repartition(4), *sizes)


def test_marks_against_counting_all_texts(spark, monkeypatch):
    table = list(toxic_rows(300))
    toxic, ordinary = ([t for _, t, x in table if x == k] for k in (1, 0))
    want = []
    for fold in (0, 1, None):
        kept = [[toxicity._grams(t) for i, t in enumerate(texts) if i % 2 != fold] for texts in (toxic, ordinary)]
        counts = [Counter(g for grams in texts for g in grams) for texts in kept]
        n, m = map(len, kept)
        tried = max(10, sum(k > 1 for k in counts[0].values()))

        def chance(k, total, p):
            q = k / total
            if q <= p:
                return 1.0
            return math.exp(-total * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0)))

        want.append({g for g, k in counts[0].items() if k >= 4 and k / n >= 5 * (counts[1][g] + 0.5) / m
                     and chance(k, k + counts[1][g], n / (n + m)) <= 1 / tried * (1 + 1e-12)})
    assert want[2] and marked(spark, toxic, ordinary) == want
    monkeypatch.setattr(toxicity, "COUNTED", 50)
    assert marked(spark, toxic, ordinary) == want
    assert marked(spark, toxic, []) == [set()] * 3


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    table = list(toxic_rows(200))
    docs = spark.createDataFrame([(i, t) for i, t, _ in table] * 2, "doc_id long, text string")
    labels = spark.createDataFrame([(i, x) for i, _, x in table], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda session, toxic, ordinary, windows: seen.append(toxic + ordinary))
    toxicity.learn(docs, labels)
    toxicity.learn(docs, labels, most_bytes=10_000)
    assert len(seen[0]) == len(set(seen[0])) > 100 and set(seen[1]) < set(seen[0])
    assert 8_000 < sum(map(len, seen[1])) <= 10_000


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.learn(documents(spark), none)
    assert {r.score for r in toxicity.score(documents(spark), model).collect()} == {0.0}
    assert toxicity.score(nothing(spark), model).collect() == []


def test_pieces_round_trip(spark):
    encoded = pieces.encode(documents(spark, extra=True))
    back = pieces.decode(encoded, into="back").collect()
    assert len(back) == len(rows())
    assert all(r.back == (r.text or "") and r.n_pieces == len(r.ids) for r in back)
    assert pieces.encode(nothing(spark)).collect() == []


def test_n_best_segmentations():
    vocabulary = pieces.load()

    def paths(text):
        edges = vocabulary.edges(text)

        def to(j):
            if j == 0:
                yield 0, ()
            for i, score, ids in edges[j] if j else ():
                for rest, before in to(i):
                    yield rest + score, before + ids

        return sorted(to(len(text)), key=lambda p: -p[0])

    for text in ("of the", "thtion", "a  b\nc", "zé▁z", "x"):
        ids, score, others = pieces.Encoder(vocabulary, 6).encode([text])[0]
        best = paths(" " + text)
        assert [score, *(s for s, _ in others)] == [p[0] for p in best[:6]]
        for s, changes in others:
            other = pieces.varied(ids.tolist(), changes)
            assert sum(vocabulary.scores[i] for i in other) == s
            assert b"".join(vocabulary.stands[i] for i in other).decode()[1:] == text
        assert [s for s, _ in pieces.n_best(vocabulary, " " + text.split("\n")[0], 3)] == [
            p[0] for p in paths(" " + text.split("\n")[0])[:3]] or "  " in text


def test_segments_together_and_alone():
    vocabulary = pieces.load()
    segments = sorted({s for _, t, *_ in rows() for s in pieces.SEGMENT.findall(" " + (t or ""))}, key=len)
    for size in {len(s) for s in segments if len(s) <= pieces.AT_ONCE}:
        same = [s for s in segments if len(s) == size]
        for s, (ids, score, gap) in zip(same, pieces.best_two_of_many(vocabulary, same)):
            assert (tuple(ids), score, gap) == pieces.best_two(vocabulary, s)


def test_texts_with_null_characters():
    vocabulary = pieces.load()
    texts = ["\x00g", "a\x00 \x00\x00the", "\x00", "the \x00of\n\x00of", "\n".join(f"\x00{c}the" for c in "abcdefgh")]
    for text, (ids, score, _) in zip(texts, pieces.Encoder(vocabulary, 3).encode(texts)):
        assert b"".join(vocabulary.stands[i] for i in ids).decode()[1:] == text
        assert sum(vocabulary.scores[i] for i in ids) == score
    for segment in ("\x00g", "\x00\x00the"):
        (ids, score, gap), = pieces.best_two_of_many(vocabulary, [segment])
        assert (tuple(ids), score, gap) == pieces.best_two(vocabulary, segment)


def test_segments_of_many_lengths_together():
    vocabulary, rng = pieces.load(), random.Random(8)
    names = list(vocabulary.texts)
    segments = ["".join(rng.choices([*names, *["\x00", "é", "漢", "😀", "\ud800", "x" * 40] * 999], k=rng.randint(1, 9)))
                for _ in range(400)]
    for s, (ids, score, gap) in zip(segments, pieces.best_two_of_many(vocabulary, segments), strict=True):
        assert (tuple(ids), score, gap) == pieces.best_two(vocabulary, s)


def test_texts_cut_into_segments():
    rng = random.Random(9)
    texts = ["".join(rng.choices("  \n\tab.é😀\x00", k=rng.randint(0, 12))) for _ in range(500)]
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    spaced, at, first = pieces.cut(data, np.cumsum([0] + [len(r) for r in raw]))
    found = [spaced[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:])]
    for text, a, b in zip(texts, first[:-1], first[1:], strict=True):
        assert found[a:b] == (pieces.SEGMENT.findall(" " + text) if text else [])


def test_new_segments_are_learnt_together():
    """Python's calls do not grow with the number of segments (the check's CPU seconds a GB do)."""
    rng = random.Random(10)
    text = " ".join({"".join(rng.choices("abdeghilmnorstu", k=rng.randint(3, 12))) for _ in range(20_000)})
    encoder, calls = pieces.Encoder(pieces.load(), 4), 0

    def count(frame, event, what):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        (ids, _, others), = encoder.encode([text])
    finally:
        sys.setprofile(None)
    assert b"".join(encoder.vocabulary.stands[i] for i in ids).decode()[1:] == text and len(others) == 3
    assert calls < text.count(" ") / 2
