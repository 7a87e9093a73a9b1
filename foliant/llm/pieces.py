"""Encoding with a SentencePiece vocabulary, with the N best segmentations, and decoding.

A text is a lattice of pieces. Viterbi scores from the left are, for every place, exactly what the
rest of a path towards the left can still reach, so an A-star search from the right end with them as
heuristic completes paths in the order of their scores and never follows one in vain.

No piece goes on after a space that follows another character, nor past a line break, so the
lattice falls apart into segments there, and a text's N best paths are sums of its segments'. A
segment's gap is what its second path costs. At most N - 1 segments, those with the smallest gaps,
can differ from their best path in any of the N best paths of the text; only these are searched.

Scores are whole numbers, so ties are ties and results do not depend on the order of sums.
"""

from __future__ import annotations

import gc
import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.shared import Sent
from foliant.llm.words import blocks

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SEGMENT = re.compile(" *[^ \n]+| +|\n")
# Parts of a unit of log-probability that scores are rounded to.
UNIT = 1_000_000
# Segments remembered by a task.
REMEMBERED = 1 << 18
NEVER = 1 << 60
# Longest segment, in characters, of which tests compare all of a length.
AT_ONCE = 32
# Characters of segments whose lattices are worked on together; one segment may be longer.
MANY = 1 << 16
# Fewer segments than these, on average over the places of the longest, are worked on one by one.
FEW = 3
# Places of the trie that are tried at once.
WINDOW = 2048
# Bytes of texts encoded together; one text may be longer.
TOGETHER = 2 << 20


class Vocabulary:
    """Pieces by text, with spaces for their mark, and what each id stands for."""

    def __init__(self, texts: dict[str, int], stands: list[bytes], scores: list[int], first_byte: int):
        self.texts, self.stands, self.scores, self.first_byte = texts, stands, scores, first_byte
        self.longest = max(map(len, texts))

    def steps(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The trie of all pieces as a double array, one place for every beginning of a piece.

        First the number of every character, 0 for those in no piece; the last one stands for all
        beyond. Then by place, the root being 0: ``base``, ``parent`` and the piece that ends there
        or -1. What follows place p by the character of number c, if anything, has the place
        q = base[p] + c, and parent[q] is p.
        """
        if not hasattr(self, "_steps"):
            seen = Counter(chain.from_iterable(self.texts))
            number = {c: k for k, (c, _) in enumerate(seen.most_common(), 1)}
            follow: dict[str, set] = {}
            for text in self.texts:
                for k, c in enumerate(text):
                    follow.setdefault(text[:k], set()).add(number[c])
            taken, low, base = np.zeros(2 * len(self.texts) + len(number) + WINDOW, bool), 1, {}
            taken[0] = True
            for text, own in sorted(follow.items(), key=lambda item: -len(item[1])):
                own = np.sort(np.fromiter(own, np.int64, len(own)))
                if len(own) == 1:
                    break
                at, free = max(0, low - int(own[0])), np.zeros(1, bool)
                while not free.any():
                    if at + own[-1] + WINDOW > len(taken):
                        taken = np.concatenate([taken, np.zeros_like(taken)])
                    free = ~taken[at + own[0]:at + own[0] + WINDOW]
                    for c in own[1:]:
                        free &= ~taken[at + c:at + c + WINDOW]
                    base[text] = at + int(np.argmax(free))
                    at += WINDOW
                taken[base[text] + own] = True
                low = max(low, base[text] - WINDOW)
            # Beginnings that one character follows take the places that are left.
            taken = np.concatenate([taken, np.zeros(len(follow), bool)])
            left = np.flatnonzero(~taken[len(number) + 1:]) + len(number) + 1
            single = [(text, *own) for text, own in follow.items() if text not in base]
            base.update((text, at - c) for (text, c), at in zip(single, left.tolist()))
            size = max(base.values()) + len(number) + 1
            bases, parent, piece = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
            for text, own in follow.items():
                place = base[text[:-1]] + number[text[-1]] if text else 0
                bases[place] = base[text]
                parent[base[text] + np.fromiter(own, np.int64, len(own))] = place
            for text, i in self.texts.items():
                piece[base[text[:-1]] + number[text[-1]]] = i
            numbers = np.zeros(max(map(ord, number)) + 2, np.int32)
            for c, k in number.items():
                numbers[ord(c)] = k
            self._steps = numbers, bases, parent, piece
        return self._steps

    def edges(self, segment: str) -> list[list[tuple[int, int, tuple[int, ...]]]]:
        """For every place of a segment, the pieces that end there: start, score, ids.

        A character that is no piece stands as its bytes, with the last piece's score each.
        """
        n, find, scores = len(segment), self.texts.get, self.scores
        ending: list = [[] for _ in range(n + 1)]
        for i in range(n):
            for j in range(i + 1, min(n, i + self.longest) + 1):
                piece = find(segment[i:j])
                if piece is not None:
                    ending[j].append((i, scores[piece], (piece,)))
                elif j == i + 1:
                    raw = segment[i].encode("utf-8", "surrogatepass")
                    ids = tuple(self.first_byte + b for b in raw)
                    ending[j].append((i, sum(scores[k] for k in ids), ids))
        return ending


def load(path: str = VOCABULARY) -> Vocabulary:
    """Read a SentencePiece model with byte pieces.

    Its pieces stand in the order in which they were merged, the most frequent first, so a piece
    of rank r gets the log-probability of Zipf's law, proportional to 1 / (r + 2.7).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.vocab_size()
    first_byte = next(i for i in range(size) if model.is_byte(i))
    names = [model.id_to_piece(i) for i in range(size)]
    plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    texts = {names[i].replace("▁", " "): i for i in plain}
    stands = [b""] * size
    for text, i in texts.items():
        stands[i] = text.encode("utf-8", "surrogatepass")
    for b in range(256):
        stands[first_byte + b] = bytes([b])
    rank = {i: r for r, i in enumerate(plain)}
    total = math.log(sum(1 / (r + 2.7) for r in range(len(plain))))
    scores = [
        round(-UNIT * (math.log(rank.get(i, len(plain)) + 2.7) + total)) for i in range(size)
    ]
    vocabulary = Vocabulary(texts, stands, scores, first_byte)
    vocabulary.steps()
    return vocabulary


def _forward(edges: list) -> tuple[list[int], list[tuple]]:
    """Best score from the left to every place, and the edge it comes by."""
    best, by = [0], [()]
    for ending in edges[1:]:
        top, edge = -NEVER, ()
        for e in ending:
            score = best[e[0]] + e[1]
            if score > top:
                top, edge = score, e
        best.append(top)
        by.append(edge)
    return best, by


def best_two(vocabulary: Vocabulary, segment: str) -> tuple[tuple[int, ...], int, int]:
    """Ids and score of the best path of a segment, and what the second one costs."""
    edges = vocabulary.edges(segment)
    best, by = _forward(edges)
    n = len(segment)
    behind = [-NEVER] * n + [0]
    for j in range(n, 0, -1):
        rest = behind[j]
        for i, score, _ in edges[j]:
            if score + rest > behind[i]:
                behind[i] = score + rest
    path, used, j = [], set(), n
    while j:
        used.add((by[j][0], j))
        path.append(by[j][2])
        j = by[j][0]
    # The second path has an edge that the best one has not; the best path over each is known.
    second = -NEVER
    for j in range(1, n + 1):
        rest = behind[j]
        for i, score, _ in edges[j]:
            if (i, j) not in used and best[i] + score + rest > second:
                second = best[i] + score + rest
    ids = tuple(chain.from_iterable(reversed(path)))
    return ids, best[n], NEVER if second <= -NEVER // 2 else best[n] - second


def n_best(vocabulary: Vocabulary, segment: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The ``n`` best paths of a segment as (score, ids), best first, by A-star from the right.

    Of equal paths the one comes first that is found first: open paths with equal prospects are
    taken up from the one nearest to the left end, then in the order of their making.
    """
    edges = vocabulary.edges(segment)
    best, _ = _forward(edges)
    end, made = len(segment), 0
    open_paths: list = [(-best[end], end, 0, 0, None)]
    out = []
    while open_paths and len(out) < n:
        prospect, place, _, done, link = heapq.heappop(open_paths)
        if place == 0:
            ids: list = []
            while link is not None:
                ids.extend(link[0])
                link = link[1]
            out.append((-prospect, tuple(ids)))
            continue
        for start, score, piece in edges[place]:
            made += 1
            total = done + score
            heapq.heappush(open_paths, (-(best[start] + total), start, made, total, (piece, link)))
    return out


def best_two_of_many(vocabulary: Vocabulary, segments: list[str]) -> Iterator[tuple]:
    """``best_two`` of every segment, all at once: the same results in the same order."""
    raw = [s.encode("utf-8", "surrogatepass") for s in segments]
    offsets = np.cumsum([0] + [len(r) for r in raw])
    ids, begin, count, score, gap = best_two_of_all(vocabulary, np.frombuffer(b"".join(raw), np.uint8), offsets)
    for k in range(len(segments)):
        yield ids[begin[k]:begin[k] + count[k]], int(score[k]), int(gap[k])


def best_two_of_all(vocabulary: Vocabulary, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """``best_two`` of segments that stand one after another in ``data`` (UTF-8), none empty.

    Returns the ids of all best paths and, by segment, where its ids begin, how many there are,
    the score of the path and what the second one costs.
    """
    spots = np.flatnonzero((data & 0xC0) != 0x80)
    text = data.tobytes().decode("utf-8", "surrogatepass")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    size = np.diff(spots, append=len(data))
    first = np.searchsorted(spots, offsets)
    length = np.diff(first)
    first = first[:-1]
    numbers = vocabulary.steps()[0]
    numbers = numbers[np.minimum(codes, len(numbers) - 1)]
    # Longest first, so that those that reach a place come before those that do not.
    order = np.argsort(-length, kind="stable")
    until = np.cumsum(length[order])
    begin, count, score, gap = (np.zeros(len(order), np.int64) for _ in range(4))
    out, n_ids, row = [], 0, 0
    while row < len(order):
        done = until[row - 1] if row else 0
        stop = max(row + 1, int(np.searchsorted(until, done + MANY, "right")))
        some = order[row:stop]
        if until[stop - 1] - done < FEW * length[some[0]]:
            found = [best_two(vocabulary, text[a:a + n]) for a, n in zip(first[some], length[some])]
            ids = np.fromiter(chain.from_iterable(f[0] for f in found), np.int32)
            count[some], score[some], gap[some] = zip(*((len(f[0]), *f[1:]) for f in found))
        else:
            ids, mine, at, score[some], gap[some] = _side_by_side(
                vocabulary, numbers, size, first[some], length[some])
            # A character that is spelled has -1 for its piece.
            many = np.where(ids < 0, size[at], 1)
            count[some] = np.bincount(mine, many, len(some)).astype(np.int64)
            if (ids < 0).any():
                ids = np.repeat(ids, many)
                inside = np.arange(len(ids)) - np.repeat(np.cumsum(many) - many, many)
                byte = data[np.repeat(spots[at], many) + inside]
                ids = np.where(ids < 0, vocabulary.first_byte + byte.astype(np.int32), ids)
        begin[some] = n_ids + np.cumsum(count[some]) - count[some]
        n_ids += len(ids)
        out.append(ids)
        row = stop
    return np.concatenate(out) if out else np.zeros(0, np.int32), begin, count, score, gap


def _side_by_side(vocabulary: Vocabulary, numbers, size, first, length) -> tuple:
    """Best paths of segments, the longest first, given by their first characters and lengths.

    Place i of all segments that are longer than i is a run of a flat array, so all of them take a
    step at once; edges are in the order of their beginnings. Returns the pieces of the best paths,
    one path after another, -1 for a character that is spelled; for each of them the segment and
    the character it begins with; the scores and what second paths cost.
    """
    _, base, parent, piece_at = vocabulary.steps()
    scores = np.array(vocabulary.scores, np.int64)
    m, longest = len(length), int(length[0])
    wide = np.searchsorted(-length, -np.arange(longest), "left")
    run = np.concatenate([[0], np.cumsum(wide)])
    n = int(run[-1])
    place = np.repeat(np.arange(longest), wide)
    segment = np.arange(n) - run[place]
    char = first[segment] + place
    number = numbers[char]
    # Edges by the trie, from all places at once; ``last`` is the place of their last character.
    many, edges = np.zeros(n, np.int64), []
    open_, at, last = np.arange(n), np.zeros(n, np.int32), np.arange(n)
    for d in range(vocabulary.longest):
        if d:
            inside = place[open_] + d < length[segment[open_]]
            open_, at = open_[inside], at[inside]
            last = run[place[open_] + d] + segment[open_]
        to = base[at] + number[last]
        hit = parent[to] == at
        piece = np.where(hit, piece_at[to], -1)
        # A character that is no piece stands as its bytes.
        some = np.arange(n) if d == 0 else np.flatnonzero(piece >= 0)
        edges.append((open_[some], many[open_[some]], piece[some], last[some]))
        many[open_[some]] += 1
        open_, at = open_[hit], to[hit]
        if not len(open_):
            break
    begin = np.concatenate([[0], np.cumsum(many)])
    # Nodes are the beginnings of the segments, then what stands behind each place.
    piece, reach = np.zeros(begin[-1], np.int32), np.zeros(begin[-1], np.int64)
    for own, rank, pieces, ends in edges:
        e = begin[own] + rank
        piece[e], reach[e] = pieces, m + ends
    owner = np.repeat(np.arange(n), many)
    own = scores[piece]
    raw = np.flatnonzero(piece < 0)
    own[raw] = scores[vocabulary.first_byte] * size[char[owner[raw]]]

    best, behind = np.full(m + n, -NEVER), np.full(m + n, -NEVER)
    by, total = np.zeros(m + n, np.int64), np.zeros(len(own), np.int64)
    best[:m] = 0
    ends = m + run[length - 1] + np.arange(m)
    behind[ends] = 0
    starts = np.concatenate([[0], m + run[:-1]])[:longest]
    for i in range(longest):
        a, b = begin[run[i]], begin[run[i + 1]]
        score = np.repeat(best[starts[i]:starts[i] + wide[i]], many[run[i]:run[i + 1]]) + own[a:b]
        total[a:b] = score
        to = reach[a:b]
        # Of equal paths the one stays whose last piece begins first.
        better = np.flatnonzero(score > best[to])
        to = to[better]
        best[to] = score[better]
        by[to] = a + better
    for i in range(longest - 1, -1, -1):
        a, b = begin[run[i]], begin[run[i + 1]]
        behind[starts[i]:starts[i] + wide[i]] = np.maximum.reduceat(
            own[a:b] + behind[reach[a:b]], begin[run[i]:run[i + 1]] - a)
    used = np.zeros(len(own), bool)
    node = ends
    while len(node):
        e = by[node]
        used[e] = True
        e = owner[e]
        e = e[place[e] > 0]
        node = m + run[place[e] - 1] + segment[e]
    # The second path has an edge that the best one has not; the best path over each is known.
    total += behind[reach]
    total[used] = -NEVER
    over = np.maximum.reduceat(total, begin[:-1])
    second = np.full(m, -NEVER)
    for i in range(longest):
        second[:wide[i]] = np.maximum(second[:wide[i]], over[run[i]:run[i + 1]])
    best = best[ends]
    path = np.flatnonzero(used)
    mine = segment[owner[path]]
    by_segment = np.argsort(mine.astype(np.uint16) if m <= 1 << 16 else mine, kind="stable")
    path = path[by_segment]
    gap = np.where(second <= -NEVER // 2, NEVER, best - second)
    return piece[path], mine[by_segment], char[owner[path]], best, gap


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut texts (UTF-8, one after another) like ``SEGMENT`` does, each after a space of its own.

    Returns the texts with their spaces, the offsets of all segments, and the number of the first
    segment of each text and, at the end, of all segments. Empty texts have none.
    """
    length = np.diff(offsets)
    some = offsets[:-1][length > 0]
    spaced = np.insert(data, some, 0x20)
    offsets = np.concatenate([[0], np.cumsum(length + (length > 0))])
    space, line = spaced == 0x20, spaced == 0x0A
    begins = line.copy()
    begins[1:] |= line[:-1] | (space[1:] & ~space[:-1])
    begins[offsets[:-1][length > 0]] = True
    starts = np.flatnonzero(begins)
    return spaced, np.append(starts, len(spaced)), np.searchsorted(starts, offsets)


class Encoder:
    """Encodes texts, remembering segments."""

    def __init__(self, vocabulary: Vocabulary, n: int):
        self.vocabulary, self.n = vocabulary, n
        self.searched: dict = {}
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.ids = np.zeros(0, np.int32)
        self.begin, self.count, self.score, self.gap = (np.zeros(0, np.int64) for _ in range(4))

    def _numbers(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Numbers of segments among the known ones; those not known yet are learnt."""
        if len(self.known) > REMEMBERED:
            self._forget()
        n = len(offsets) - 1
        segments = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
        # Known ones keep their numbers, as they come first.
        coded = pa.chunked_array([self.known, segments]).dictionary_encode()
        if not n:
            return np.zeros(0, np.int64)
        coded = coded.chunk(coded.num_chunks - 1)
        new = coded.dictionary.slice(len(self.known))
        self.known = coded.dictionary
        if len(new):
            at = np.frombuffer(new.buffers()[1], np.int64, len(new) + 1, new.offset * 8)
            raw = np.frombuffer(new.buffers()[2], np.uint8)[at[0]:at[-1]]
            ids, begin, *others = best_two_of_all(self.vocabulary, raw, at - at[0])
            self.begin = np.concatenate([self.begin, begin + len(self.ids)])
            self.ids = np.concatenate([self.ids, ids])
            self.count, self.score, self.gap = (
                np.concatenate(both) for both in zip((self.count, self.score, self.gap), others))
        return coded.indices.to_numpy()

    def _search(self, segment: str) -> list:
        if segment not in self.searched:
            if len(self.searched) >= REMEMBERED:
                self.searched.clear()
            self.searched[segment] = n_best(self.vocabulary, segment, self.n)
        return self.searched[segment]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, int, list]]:
        """Ids and score of the best path of every text, and the following paths.

        Those are (score, changes), where a change (start, stop, ids) replaces that part of the
        best path's ids.
        """
        raw = [text.encode("utf-8", "surrogatepass") for text in texts]
        offsets = np.cumsum([0] + [len(r) for r in raw])
        ids, ends, scores, others = self.encode_block(np.frombuffer(b"".join(raw), np.uint8), offsets)
        return [(ids[ends[k]:ends[k + 1]], int(scores[k]), others[k]) for k in range(len(texts))]

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple:
        """``encode`` for texts that stand one after another in UTF-8: all ids, where those of each
        text begin and, at the end, how many there are, the scores, and the following paths."""
        data, segments, first = cut(data, offsets)
        spot = self._numbers(data, segments)
        own = self.count[spot]
        before = np.concatenate([[0], np.cumsum(own)])
        flat = np.arange(before[-1]) + np.repeat(self.begin[spot] - before[:-1], own)
        scores = np.diff(np.concatenate([[0], np.cumsum(self.score[spot])])[first])
        gaps, ends = self.gap[spot], before[first]
        others = [
            self._others(spot[a:b], gaps[a:b], before[a:b] - begin, own[a:b], total)
            for a, b, begin, total in zip(first[:-1].tolist(), first[1:].tolist(), ends.tolist(), scores.tolist())
        ]
        return self.ids[flat], ends, scores, others

    def _others(self, spot, gaps, before, own, total) -> list:
        if self.n < 2 or not len(spot):
            return []
        few = min(self.n - 1, len(gaps))
        # The smallest gaps, of equal ones the first.
        limit = np.partition(gaps, few - 1)[few - 1]
        near = np.concatenate([np.flatnonzero(gaps < limit), np.flatnonzero(gaps == limit)])[:few]
        near = [i for i in np.sort(near).tolist() if gaps[i] < NEVER]
        found = {i: self._search(self.known[int(spot[i])].as_py().decode("utf-8", "surrogatepass")) for i in near}
        # Sums of alternatives, cheapest first; each keeps which alternative it takes where.
        sums: list = [(0, ())]
        for i, paths in found.items():
            sums = heapq.nsmallest(self.n, [
                (cost + paths[0][0] - paths[k][0], taken + ((i, k),) if k else taken)
                for cost, taken in sums for k in range(len(paths))
            ])
        return [
            (total - cost, [
                (int(before[i]), int(before[i] + own[i]), found[i][k][1])
                for i, k in taken
            ])
            for cost, taken in sums[1:]
        ]


CHANGE = "struct<start:int,stop:int,ids:array<int>>"
ADDED = (
    "ids array<int>, n_pieces long, score double, "
    f"alternatives array<struct<score:double,changes:array<{CHANGE}>>>"
)


def encode(docs: DataFrame, n: int = 4, path: str = VOCABULARY) -> DataFrame:
    """Encode every whole text and give its ``n`` best segmentations.

    All columns of ``docs`` stay; added, replacing columns of these names, are ``ids`` of the best
    segmentation, ``n_pieces``, its ``score`` (log-probability) and ``alternatives``: the next ones,
    best first, as ``score`` and ``changes`` to ``ids`` (fewer if there are fewer). NULL and empty
    texts have no pieces, score 0 and no alternatives. Any text comes back from ``decode``. One
    pass, no shuffle; the vocabulary, of the model's fixed size, is broadcast.
    """
    fields = T._parse_datatype_string(ADDED).fields
    names = [f.name for f in fields]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in names])
    at = docs.columns.index("text")
    sent = Sent(docs.sparkSession, load(path))
    change = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("ids", pa.list_(pa.int32()))])
    other = pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(change))]))

    def run(batches):
        encoder = Encoder(sent.value, n)
        for batch in batches:
            for row, stop, data, offsets in blocks(batch.column(at), TOGETHER):
                part = batch.slice(row, stop - row)
                ids, ends, scores, found = encoder.encode_block(data, offsets)
                others = [
                    [{"score": s / UNIT,
                      "changes": [{"start": a, "stop": b, "ids": list(i)} for a, b, i in changes]}
                     for s, changes in paths]
                    for paths in found
                ]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)),
                     pa.array(np.diff(ends), pa.int64()), pa.array(scores / UNIT, pa.float64()),
                     pa.array(others, other)],
                    names=[*part.schema.names, *names],
                )
        # Workers live on: what was remembered is given back before other stages need the memory.
        del encoder
        gc.collect()
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))


def decode(docs: DataFrame, ids: str = "ids", into: str = "text", path: str = VOCABULARY) -> DataFrame:
    """Texts from ids. NULL ids give NULL, none give an empty text; ids outside the vocabulary are
    refused."""
    sent = docs.sparkSession.sparkContext.broadcast(load(path).stands)

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        stands = sent.value

        def text(row):
            raw = b"".join([stands[i] for i in row])
            return raw.decode("utf-8", "surrogatepass")[1:]

        for part in parts:
            yield part.map(text, na_action="ignore")

    return docs.withColumn(into, run(ids))


def varied(ids: list[int], changes: list[tuple[int, int, list[int]]]) -> list[int]:
    """The ids of an alternative."""
    out, at = [], 0
    for start, stop, other in sorted(changes):
        out += ids[at:start] + list(other)
        at = stop
    return out + ids[at:]
