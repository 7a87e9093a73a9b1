"""Similarity join, repeats and fingerprints against plain statements of what they return."""

import hashlib
from collections import Counter

import pytest

from foliant.llm import jaccard, repeats, syncmers
from tests.llm.fixtures import LOWER, SCHEMA, WORD, documents, nothing, rows


def groups(table, n, over, under):
    """Smallest id reachable by links, comparing every two sets."""
    sets = {}
    for doc_id, text, *_ in table:
        words = WORD.findall((text or "").translate(LOWER))
        grams = {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}
        sets[doc_id] = grams or ({tuple(words)} if words else set())
    name = {i: i for i in sets}

    def top(i):
        while name[i] != i:
            i = name[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and under * both >= over * len(sets[a] | sets[b]):
                low, high = sorted((top(a), top(b)))
                name[high] = low
    return {i: (len(sets[i]), top(i)) for i in sets}


@pytest.mark.parametrize("n, over, under", [(3, 90, 100), (5, 80, 100)])
def test_link_groups(spark, n, over, under):
    found = jaccard.link_groups(documents(spark, extra=True), n, over, under).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == groups(rows(), n, over, under)
    assert len(found) == len(rows())


def test_link_groups_without_ids_and_with_repeated_rows(spark):
    table = [(None, "a b c d", None, None, None), (3, "a b c d", None, None, None),
             (3, "a b c d", None, None, None), (2, "A B c D", None, None, None)]
    found = jaccard.link_groups(spark.createDataFrame(table, SCHEMA), 3, 90, 100).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in found) == [
        (-1, -1), (2, 2), (3, 2), (3, 2)]


def test_link_counts(spark):
    """Every link counts, also those between texts of one group."""
    words = [f"w{i}" for i in range(60)]
    table = [(i, " ".join(words[i:i + 40])) for i in range(12)] + [(20, " ".join(words[:40]))]
    table += [(21, "lone text of some words"), (22, ""), (23, None), (None, " ".join(words[:40]))]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    found = jaccard.link_counts(docs, 3, 80, 100).collect()
    sets = {}
    for doc_id, text in table:
        own = (text or "").split()
        sets[doc_id] = {tuple(own[i:i + 3]) for i in range(len(own) - 2)} if doc_id is not None else set()
    expected = {
        a: sum(a != b and bool(x & y) and 100 * len(x & y) >= 80 * len(x | y) for b, y in sets.items())
        for a, x in sets.items()
    }
    assert {r.doc_id: r.n_links for r in found} == expected
    assert len(found) == len(table) and max(expected.values()) > 5


def test_link_groups_of_nothing(spark):
    assert jaccard.link_groups(nothing(spark), 3, 90, 100).collect() == []


def kept(table, window):
    seen, out = set(), {}
    for doc_id, text, *_ in sorted(table):
        words = WORD.findall(text or "")
        own = [tuple(words[i:i + window]) for i in range(len(words) - window + 1)]
        gone = set()
        for i, w in enumerate(own):
            if w in seen:
                gone.update(range(i, i + window))
        seen.update(own)
        left = " ".join(w for i, w in enumerate(words) if i not in gone)
        out[doc_id] = (len(words), len(gone), hashlib.sha256(left.encode()).hexdigest())
    return out


@pytest.mark.parametrize("window", [50, 12])
def test_remove_repeats(spark, window):
    found = repeats.remove_repeats(documents(spark, extra=True), window).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == kept(rows(), window)
    for r in found:
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed


def test_remove_repeats_without_ids_and_with_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    table = [(None, text, None, None, None), (1, text, None, None, None), (1, text, None, None, None),
             (2, text + " more", None, None, None)]
    found = repeats.remove_repeats(spark.createDataFrame(table, SCHEMA)).collect()
    assert Counter((r.doc_id, r.n_removed) for r in found) == {(None, 0): 1, (1, 0): 2, (2, 60): 1}
    assert repeats.remove_repeats(nothing(spark)).collect() == []


def test_names_do_not_depend_on_what_surrounds_a_window():
    import numpy as np

    rng = np.random.default_rng(5)
    for trial in range(60):
        # Few different words give many runs and repeats.
        words = rng.integers(0, rng.integers(1, 8), 50).astype(np.uint64)
        names = set()
        for _ in range(4):
            before, after = (rng.integers(0, 8, rng.integers(0, 30)).astype(np.uint64) for _ in "ab")
            text = np.concatenate([before, words, after])
            names.add(int(repeats.representatives(text, np.array([0, len(text)]), 50)[len(before)]))
        assert len(names) == 1


def test_edited(spark):
    found = {r.doc_id: r for r in syncmers.edited(documents(spark, extra=True)).collect()}
    table = sorted((i, t or "") for i, t, *_ in rows())
    assert len(found) == len(table)
    for k, (doc_id, text) in enumerate(table):
        following = table[(k + 1) % len(table)][1]
        cut = len(text) // 4
        changed = text[:len(text) - cut] + following[:cut]
        got = found[doc_id]
        assert got.n_chars == len(text)
        assert got.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= got.near_edited <= 1 and 0 <= got.near_next <= 1
        if changed == text:
            assert got.near_edited == 1
        if len(text) > 400 and len(set(text)) > 3:
            assert got.near_edited > 0.4
        if text == following:
            assert got.near_next == 1 and got.fingerprint == found[table[k + 1][0]].fingerprint
    assert syncmers.edited(nothing(spark)).collect() == []


def test_syncmers_by_definition():
    text = rows()[0][1]
    at, hashes = syncmers.anchors(text)
    k, s = syncmers.K, syncmers.S
    inner = {}
    for place, value in zip(*syncmers.anchors(text + "  " + text)):
        inner.setdefault(text[place % (len(text) + 2):][:k], set()).add(int(value))
    assert all(len(v) == 1 for v in inner.values())
    assert 0.1 < len(at) / len(text) < 0.25 and s < k
    shift, count = syncmers.aligned(text[100:], text)
    assert shift == 100 and count > 20


def test_long_texts_are_cut_without_a_trace(monkeypatch):
    text = rows()[21][1] or rows()[20][1]
    whole = syncmers.anchors(text)
    monkeypatch.setattr(syncmers, "PIECE", 100)
    parts = syncmers.anchors(text)
    assert all((a == b).all() for a, b in zip(whole, parts))
