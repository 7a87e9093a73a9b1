"""Cross-tokenizer alignment against encoding whole texts and comparing all their tokens."""

import bisect
import hashlib
import random
from collections import Counter

import pytest

from foliant.llm import token_alignment as t
from tests.llm.fixtures import documents, nothing, rows

ODD = [" ", "  ", "\n", "\t", "a", "th", "The", "é", "😀", "한", "▁", "\x1c", "\x85", "\xa0", "　", "<s>",
       "<|endoftext|>", "'s", "don't", "12", "...", "\r\n", "\0", "<0x41>", "ß", "👩‍👩‍👧", " the", "lamb\n"]


@pytest.fixture(scope="module")
def tokenizers():
    return t.Aligner(t.BYTE_LEVEL, t.PIECES)


def plain(tokenizers, text):
    """Ids of both sides, ends of both sides, linked pairs and the groups written out."""
    if not text:
        return None
    a = tokenizers.a.encode(" " + text, add_special_tokens=False).ids
    b = tokenizers.b.encode(text)
    ends = []
    for ids, spelt in ((a, tokenizers.a_bytes), (b, tokenizers.b_bytes)):
        if b"".join(spelt[i] for i in ids) != (" " + text).encode():
            return None
        at = [0]
        for i in ids:
            at.append(at[-1] + len(spelt[i]))
        ends.append(at[1:])
    both, groups, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
    for end in both:
        p, q = bisect.bisect_right(ends[0], end), bisect.bisect_right(ends[1], end)
        groups.append(",".join(map(str, a[i:p])) + "|" + ",".join(map(str, b[j:q])))
        i, j = p, q
    links, i, j = [], 0, 0
    while i < len(a):
        links.append((a[i], b[j]))
        x, y = ends[0][i], ends[1][j]
        i, j = i + (x <= y), j + (y <= x)
    return len(a), len(b), len(both), links, ";".join(groups)


def test_bytes_of_signs():
    signs = t.byte_of_sign()
    assert sorted(signs.values()) == list(range(256)) and signs["Ġ"] == 32 and signs["Ċ"] == 10 and signs["a"] == 97


def test_stretches_of_random_texts(tokenizers):
    rng = random.Random(5)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    for text, found in zip(texts, tokenizers.rows(texts)):
        want = plain(tokenizers, text)
        if want is None:
            assert found == (0, 0, 0, 0, "", [], []), text
            continue
        assert found[:5] == (*want[:3], len(want[3]), hashlib.sha256(want[4].encode()).hexdigest()), text
        pairs = {(k // t.STRIDE, k % t.STRIDE): n for k, n in zip(found[5].tolist(), found[6].tolist())}
        assert pairs == Counter(want[3]), text


def test_forgetting_changes_nothing(tokenizers, monkeypatch):
    texts = [r[1] for r in rows()]
    want = [r[:5] for r in tokenizers.rows(texts)]
    monkeypatch.setattr(t, "REMEMBERED", 3)
    small = t.Aligner(t.BYTE_LEVEL, t.PIECES)
    assert [r[:5] for text in texts for r in small.rows([text])] == want


def test_a_word_of_a_hundred_thousand_letters(tokenizers):
    (found,) = tokenizers.rows(["abcdefghij" * 10_000])
    assert found[0] > 1000 and found[3] == found[0] + found[1] - found[2]


@pytest.mark.parametrize("extra", [False, True])
def test_whole_corpus(spark, tokenizers, extra):
    found = t.alignment(documents(spark, extra).union(documents(spark, extra).limit(3))).collect()
    texts = {i: text for i, text, *_ in rows()}
    again = Counter(r.doc_id for r in found)
    assert sum(again.values()) == len(texts) + 3
    links = {i: plain(tokenizers, text) for i, text in texts.items()}
    counts = Counter()
    for i, one in links.items():
        for pair in one[3] if one else ():
            counts[pair] += again[i]
    highest = Counter()
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    for r in found:
        one = links[r.doc_id]
        if one is None:
            assert tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "")
            continue
        best = sum(counts[p] == highest[p[1]] for p in one[3])
        assert tuple(r)[1:] == (*one[:3], len(one[3]), best, sum(counts[p] for p in one[3]),
                                hashlib.sha256(one[4].encode()).hexdigest())


def test_no_rows_and_no_ids(spark):
    assert t.alignment(nothing(spark)).collect() == []
    found = t.alignment(spark.createDataFrame([(None, "a word"), (None, None)], "doc_id long, text string"))
    assert sorted((r.doc_id is None, r.n_a) for r in found.collect()) == [(True, 0), (True, 2)]
