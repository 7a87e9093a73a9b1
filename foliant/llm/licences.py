"""Licence scans with a generalised suffix automaton of licence words.

All templates go into one automaton over words. A text is streamed through it word by word: the
automaton's state and length after a word are the longest part of any template that ends there, the
matching statistic of that place. Phrases are read off the state: those whose own state is the
current one or a suffix of it end here. Long matches are chained, in the order of both text and
template, into spans of the text that cover a template.

Runs of words that no template has reset the automaton, so only the runs between them are streamed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.shared import Sent
from foliant.llm.words import ALNUM, Words, blocks

# Phrases and their labels.
PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Standard notices of public licences, by label.
TEMPLATES = (
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without
restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("mit", "Released under the MIT License."),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this
file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms
of the GNU General Public License as published by the Free Software Foundation, either version 3 of
the License, or (at your option) any later version. This program is distributed in the hope that it
will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("gpl", "This program is distributed under the terms of the GNU General Public License."),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are
permitted provided that the following conditions are met: Redistributions of source code must
retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the
distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission notice
appear in all copies."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a
copy of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/."""),
    ("cc", """This work is licensed under the Creative Commons Attribution ShareAlike International
License."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is
free to copy, modify, publish, use, compile, sell, or distribute this software, either in source
code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
means."""),
)

# Words of a match that may be part of a chain, at least.
LEAST_MATCH = 4
# Text words between two matches of a chain, at most.
LARGEST_GAP = 12
# Share of a template's words that a chain must cover to give its label, and a score.
COVERED = 0.6


def words_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words, and where its words start."""
    for _, _, data, offsets in blocks(pa.array([text]), 1 << 62):
        words = Words(data, offsets, True, ALNUM)
        return words.hashes(), words.start
    return np.zeros(0, np.uint64), np.zeros(0, np.int64)


class Automaton:
    """Generalised suffix automaton of sequences of small numbers."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extend(last, word)

    def _state(self, length: int, link: int, edges: dict) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def find(self, sequence: list[int]) -> int:
        state = 0
        for word in sequence:
            state = self.next[state][word]
        return state


class Scanner:
    """The automaton of templates and phrases, ready to stream texts."""

    def __init__(
        self, templates: Iterable[tuple[str, str]] = TEMPLATES,
        phrases: Iterable[tuple[str, str]] = PHRASES,
    ):
        self.phrases, self.templates = list(phrases), list(templates)
        hashed = [words_of(text)[0] for text, _ in self.phrases]
        hashed += [words_of(text)[0] for _, text in self.templates]
        if any(not len(h) for h in hashed):
            raise ValueError("a phrase or template without words")
        self.known = np.unique(np.concatenate(hashed))
        sequences = [np.searchsorted(self.known, h).tolist() for h in hashed]
        self.automaton = Automaton(sequences)
        self.sizes = [len(s) for s in sequences]
        own = [[] for _ in self.automaton.next]
        for k, sequence in enumerate(sequences[:len(self.phrases)]):
            own[self.automaton.find(sequence)].append(k)
        # Phrases that end in a state, its suffixes included; shorter states come first.
        self.ending: list[list[int]] = [[] for _ in own]
        for state in sorted(range(len(own)), key=self.automaton.length.__getitem__):
            link = self.automaton.link[state]
            self.ending[state] = own[state] + (self.ending[link] if link > 0 else [])
        # Where in each template a match of a few words may stand.
        self.seeds: dict[tuple, list[tuple[int, int]]] = {}
        for number, sequence in enumerate(sequences):
            if number >= len(self.phrases):
                for i in range(len(sequence) - LEAST_MATCH + 1):
                    key = tuple(sequence[i:i + LEAST_MATCH])
                    self.seeds.setdefault(key, []).append((number, i))
        self.sequences = sequences

    def stream(self, numbers: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
        """Phrases as (start, phrase), and maximal matches as (start, length), of a run of words."""
        automaton = self.automaton
        moves, link, longest, ending = automaton.next, automaton.link, automaton.length, self.ending
        found, matches = [], []
        state = length = 0
        for i, word in enumerate(numbers):
            step = moves[state].get(word)
            if step is None:
                # The match that ends before this word cannot be longer to the right.
                if length >= LEAST_MATCH:
                    matches.append((i - length, length))
                while step is None and state:
                    state = link[state]
                    length = longest[state]
                    step = moves[state].get(word)
                if step is None:
                    step, length = 0, -1
            state, length = step, length + 1
            for k in ending[state]:
                if length >= self.sizes[k]:
                    found.append((i - self.sizes[k] + 1, k))
        if length >= LEAST_MATCH:
            matches.append((len(numbers) - length, length))
        return found, matches

    def chains(self, pieces: list[tuple[int, list[int]]]) -> list[tuple[int, int, int, float]]:
        """Best chain of matches for every template met: (template, first word, end, covered).

        ``pieces`` are matches: the text place and the words' numbers.
        """
        anchors: dict[int, list[tuple[int, int, int]]] = {}
        for start, numbers in pieces:
            for number, i in self.seeds.get(tuple(numbers[:LEAST_MATCH]), ()):
                sequence, n = self.sequences[number], 0
                while n < len(numbers) and i + n < len(sequence) and sequence[i + n] == numbers[n]:
                    n += 1
                if n == len(numbers):
                    anchors.setdefault(number, []).append((start, i, n))
        out = []
        for number, places in anchors.items():
            places.sort()
            best: list[tuple[int, int]] = []
            low = 0
            for j, (start, i, n) in enumerate(places):
                while places[low][0] + self.sizes[number] + LARGEST_GAP < start:
                    low += 1
                top = (n, start)
                for m in range(low, j):
                    s, t, k = places[m]
                    over = max(0, s + k - start, t + k - i)
                    if t + k <= i + n and s < start and t < i and over < n and start - s - k <= LARGEST_GAP:
                        top = max(top, (best[m][0] + n - over, best[m][1]))
                best.append(top)
            j = max(range(len(places)), key=lambda j: best[j][0])
            out.append((number - len(self.phrases), best[j][1], places[j][0] + places[j][2],
                        best[j][0] / self.sizes[number]))
        return out

    def scan(self, hashes: np.ndarray) -> dict:
        """All phrases and chains of one text, given the hashes of its words."""
        spot = np.searchsorted(self.known, hashes)
        spot[spot == len(self.known)] = 0
        inside = self.known[spot] == hashes
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        found, pieces = [], []
        least = min(LEAST_MATCH, *self.sizes)
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a < least:
                continue
            numbers = spot[a:b].tolist()
            phrases, matches = self.stream(numbers)
            found += [(a + i, k) for i, k in phrases]
            pieces += [(a + i, numbers[i:i + n]) for i, n in matches]
        return {"phrases": found, "chains": self.chains(pieces) if pieces else []}


def scan(docs: DataFrame, scanner: Scanner | None = None, covered: float = COVERED) -> DataFrame:
    """Find licence phrases and notices in every text.

    All columns of ``docs`` stay; added (and replaced where so named) are ``n_words``, ``places``
    (phrases as structs start, label, by start), ``spans`` (template parts as structs label, start,
    stop, covered, best chain per template), ``labels`` and ``score``. Offsets count words from 0,
    A-Z lowered. ``labels`` are those of all phrases and of the templates covered to ``covered`` or
    more, sorted. ``score`` is 1 with a phrase, else the largest share covered of a template. NULL
    and empty texts have no words and score 0. One pass over whole texts, no shuffle.
    """
    added = ("n_words", "places", "spans", "labels", "score")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in added])
    sent = Sent(docs.sparkSession, scanner or Scanner())
    result = (
        "n_words long, places array<struct<start:long,label:string>>, "
        "spans array<struct<label:string,start:long,stop:long,covered:double>>, "
        "labels array<string>, score double"
    )

    @F.pandas_udf(result)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        ready = sent.value
        for part in parts:
            rows = []
            for row, end, data, offsets in blocks(pa.Array.from_pandas(part, type=pa.large_string())):
                words = Words(data, offsets, True, ALNUM)
                hashes = words.hashes()
                for i in range(end - row):
                    own = hashes[words.first[i]:words.first[i + 1]]
                    got = ready.scan(own)
                    places = [(s, ready.phrases[k][1]) for s, k in sorted(got["phrases"])]
                    spans = [
                        (ready.templates[t][0], s, e, c) for t, s, e, c in sorted(got["chains"])
                    ]
                    labels = {x for _, x in places} | {x for x, _, _, c in spans if c >= covered}
                    score = 1.0 if places else max([c for *_, c in spans], default=0.0)
                    rows.append((len(own), [dict(start=s, label=x) for s, x in places],
                                 [dict(label=x, start=s, stop=e, covered=c) for x, s, e, c in spans],
                                 sorted(labels), float(score)))
            yield pd.DataFrame(rows, columns=list(added))

    return docs.withColumn("_found", run("text")).select(*docs.columns, "_found.*")
