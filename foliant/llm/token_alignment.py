"""Alignment of the tokens that two tokenizers cut the same text into.

The character offsets that the byte-level tokenizer gives and the spans that SentencePiece gives are
coarse cuts, put on one scale of bytes. Tokens that share a character, such as the parts of a
multibyte character and byte-fallback pieces, are cut apart by the lengths of their decoded bytes. Where
tokens of both end, a group ends. Every stretch between two neighbouring ends of either side is
covered by one token of each side and is one link of them.

Neither tokenizer has a token that holds something other than white space followed by a space or a
line break (checked when the vocabularies are loaded), so texts fall apart there into stretches that
are encoded by themselves with the same result. Tasks remember stretches, which recur.

How often each pair of ids is linked in the whole corpus is counted by Spark from sums per chunk of
documents, and brought back to the chunks: a chunk asks once for each pair it has, so a pair that
every text has is asked for once per chunk. No table of pairs is broadcast.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.shared import stored

BYTE_LEVEL = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
# Stretches and links of a generation that a task remembers, beside the one before, and documents taken together.
REMEMBERED, LINKS, TOGETHER = 1 << 18, 1 << 22, 250
# The least stride between ids of the byte-level tokenizer in a pair's number.
STRIDE = 1 << 32
# What is encoded as one: up to a space or line break after something else.
STRETCH = re.compile(r"\s*\S+(?:(?![ \n])\s+\S+)*(?:(?![ \n])\s+$)?|\s+")

ALIGNED = ("chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pairs array<long>, counts array<long>")


def byte_of_sign() -> dict[str, int]:
    """The byte that each printable sign of a byte-level vocabulary stands for.

    Bytes that print as themselves stand for themselves, the others follow from 256 on in order.
    """
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers of a task, what their ids stand for, and the stretches met so far."""

    def __init__(self, byte_level: str, pieces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.a_bytes = _byte_level(byte_level)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search(r"\S[ \n]", t.decode("utf-8", "replace")) for t in (*self.a_bytes, *self.b_bytes)):
            raise ValueError("a token holds a space or line break after something else")
        self.a_lengths, self.b_lengths = (
            np.fromiter(map(len, spelt), np.int64, len(spelt)) for spelt in (self.a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id("▁")
        # Ids written out, with what follows them inside and at the end of their part of a group.
        self.a_written, self.b_written = (
            np.array([f"{i}{mark}" for mark in marks for i in range(len(spelt))], object)
            for marks, spelt in ((",|", self.a_bytes), (",;", self.b_bytes)))
        self._forget()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def _forget(self) -> None:
        """Start a new generation of stretches; those of the last one are taken over when met again."""
        self.old = getattr(self, "new", None)
        self.new = Stretches()

    def _encode(self, parts: list[str]) -> tuple:
        """Of both sides: ids, their number per stretch, and their coarse ends in characters of all.

        SentencePiece puts a space in front of what it is given. A stretch that begins with one is
        given without it; one that begins with a line break gets a token for the space, which goes.
        """
        stops = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        starts = np.concatenate([[0], stops[:-1]])
        a = self.a.encode_batch(parts, add_special_tokens=False)
        lead = np.fromiter((part.startswith(" ") for part in parts), np.int64, len(parts))
        b = self.b.encode([part[gap:] for part, gap in zip(parts, lead.tolist())],
                          return_type="offset_mapping", num_threads=1)
        if " " in parts:
            b[parts.index(" ")] = {"ids": [self.space], "offsets": [(0, 0)]}
        a_ids, a_sizes, a_ends = self._flat([e.ids for e in a], [e.offsets for e in a])
        ids, sizes, ends = self._flat([x["ids"] for x in b], [x["offsets"] for x in b])
        ends += np.repeat(lead + starts, sizes)
        if not lead.all():
            extra = (np.cumsum(sizes) - sizes)[lead == 0]
            self._expect_spaces(ids[extra])
            ids, ends, sizes = np.delete(ids, extra), np.delete(ends, extra), sizes - 1 + lead
        return (a_ids, a_sizes, a_ends + np.repeat(starts, a_sizes)), (ids, sizes, ends)

    def _encode_joined(self, parts: list[str]) -> tuple:
        """``_encode`` for stretches that end with something else than white space: all in one text.

        That is their own cut, so they fall apart in it as they would in any other.
        """
        whole = "".join(parts)
        stops = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        a = self.a.encode(whole, add_special_tokens=False)
        lead = int(whole.startswith(" "))
        b = self.b.encode(whole[lead:], return_type="offset_mapping", num_threads=1)
        sides = []
        for ids, offsets, moved in ((a.ids, a.offsets, 0), (b["ids"], b["offsets"], lead)):
            ids, _, ends = self._flat([ids], [offsets])
            sides.append((ids, ends + moved))
        if not lead:
            self._expect_spaces(sides[1][0][:1])
            sides[1] = (sides[1][0][1:], sides[1][1][1:])
        # A stretch begins with one byte, so no token that shares a character ends where it begins.
        return tuple((ids, np.diff(np.searchsorted(ends, stops, "right"), prepend=0), ends) for ids, ends in sides)

    def _expect_spaces(self, ids: np.ndarray) -> None:
        if (ids != self.space).any():
            raise ValueError("a piece joins a space and a line break")

    @staticmethod
    def _flat(ids: list[list[int]], offsets: list[list[tuple]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        n = int(sizes.sum())
        flat = np.fromiter(chain.from_iterable(ids), np.int64, n)
        spans = np.fromiter(chain.from_iterable(chain.from_iterable(offsets)), np.int64, 2 * n)
        return flat, sizes, spans[1::2].copy()

    @staticmethod
    def _ends(coarse: np.ndarray, spelt: np.ndarray) -> np.ndarray:
        """Ends of tokens in bytes, from their coarse ends and the lengths of their decoded bytes."""
        begins = np.concatenate([[0], coarse[:-1]])
        # Tokens that share a character, and those that begin where such a one was cut.
        rough = coarse - begins != spelt
        return np.where(rough, np.cumsum(spelt), coarse) if rough.any() else coarse

    def _spelt(self, side: tuple, spelling: list[bytes], parts: list[str]) -> bool:
        return b"".join(map(spelling.__getitem__, side[0].tolist())) == "".join(parts).encode()

    def _unspelt(self, parts: list[str], sides: tuple) -> list[bool]:
        """Which stretches the tokens of a side do not spell."""
        bad = [False] * len(parts)
        for side, spelling in zip(sides, (self.a_bytes, self.b_bytes)):
            if self._spelt(side, spelling, parts):
                continue
            at, ids = 0, side[0].tolist()
            for i, (part, size) in enumerate(zip(parts, side[1].tolist())):
                bad[i] |= b"".join(map(spelling.__getitem__, ids[at:at + size])) != part.encode()
                at += size
        return bad

    def _learn(self, parts: list[str]) -> None:
        """Align stretches: plain ones joined, and by themselves those that end a text with a gap or are not spelt."""
        joined = [part for part in parts if not part[-1].isspace() and "▁" not in part]
        # The text they make should begin with a space.
        joined.sort(key=lambda part: part[0] != " ")
        if joined:
            encoded = self._encode_joined(joined)
            if all(self._spelt(side, spelling, joined) for side, spelling in zip(encoded, (self.a_bytes, self.b_bytes))):
                self._align(joined, encoded)
            else:
                joined = []
        if len(joined) == len(parts):
            return
        taken = set(joined)
        parts = [part for part in parts if part not in taken]
        encoded = self._encode(parts)
        bad = self._unspelt(parts, encoded)
        if any(bad):
            for part, one in zip(parts, bad):
                if one:
                    self.new.known[part] = -1
            parts = [part for part, one in zip(parts, bad) if not one]
            if not parts:
                return
            encoded = self._encode(parts)
        self._align(parts, encoded)

    def _align(self, parts: list[str], encoded: tuple) -> None:
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        # The byte that every character begins with, and the character that every stretch does.
        at = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))])
        stops = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        sides = [
            (ids, sizes, self._ends(at[coarse], lengths[ids]))
            for (ids, sizes, coarse), lengths in zip(encoded, (self.a_lengths, self.b_lengths))
        ]
        (a, a_sizes, a_ends), (b, b_sizes, b_ends) = sides
        both = np.intersect1d(a_ends, b_ends, assume_unique=True)
        every = np.union1d(a_ends, b_ends)
        pairs = a[np.searchsorted(a_ends, every)] * STRIDE + b[np.searchsorted(b_ends, every)]
        limits = at[stops]
        upto = [np.searchsorted(ends, limits, "right") for ends in (both, every)]
        counts = np.column_stack([a_sizes, b_sizes, *[np.diff(u, prepend=0) for u in upto]])
        # Both sides' tokens in one row, those of a group together.
        a_group, b_group = np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)
        row = np.empty(len(a) + len(b), object)
        for own, group, other, side, written in (
            (a, a_group, b_group, "left", self.a_written), (b, b_group, a_group, "right", self.b_written)
        ):
            last = np.append(group[1:] != group[:-1], True)
            row[np.arange(len(own)) + np.searchsorted(other, group, side)] = written[own + last * (len(written) // 2)]
        cut, row, written = 0, row.tolist(), []
        for size in (a_sizes + b_sizes).tolist():
            written.append("".join(row[cut:cut + size])[:-1])
            cut += size
        self.new.add(parts, counts, written, pairs)

    def _take_over(self, parts: list[str]) -> list[str]:
        """Take stretches from the last generation into this one; returns those that it does not have."""
        if self.old is None:
            return parts
        met = [part for part in parts if part in self.old.known]
        if not met:
            return parts
        good = [part for part in met if self.old.known[part] >= 0]
        self.new.known.update((part, -1) for part in met if self.old.known[part] < 0)
        if good:
            self.new.add(good, *self.old.of(np.fromiter(map(self.old.known.__getitem__, good), np.int64, len(good))))
        return [part for part in parts if part not in self.old.known]

    def rows(self, texts: list[str | None]) -> Iterator[tuple]:
        """For every text: tokens of either side, groups, links, the groups' hash, pairs and counts."""
        split = [STRETCH.findall(" " + text) if text else [] for text in texts]
        if len(self.new.known) > REMEMBERED or len(self.new.pairs) > LINKS:
            self._forget()
        known = self.new.known
        fresh = self._take_over(list({part for parts in split for part in parts if part not in known}))
        if fresh:
            self._learn(fresh)
        for parts in split:
            which = np.fromiter(map(known.__getitem__, parts), np.int64, len(parts))
            if not len(which) or which.min() < 0:
                yield 0, 0, 0, 0, "", [], []
                continue
            written = ";".join(map(self.new.written.__getitem__, which.tolist()))
            kinds, times = np.unique(which, return_counts=True)
            counts, _, pairs = self.new.of(kinds, False)
            keys, inverse = np.unique(pairs, return_inverse=True)
            linked = np.bincount(inverse, np.repeat(times, counts[:, 3])).astype(np.int64)
            totals = (counts * times[:, None]).sum(0).tolist()
            yield (*totals, hashlib.sha256(written.encode()).hexdigest(), keys, linked)


class Stretches:
    """Aligned stretches by number: tokens of either side, groups, links; groups written out; linked pairs.

    A stretch that its tokens do not spell has the number -1.
    """

    def __init__(self):
        self.known: dict[str, int] = {}
        self.counts = np.zeros((0, 4), np.int64)
        self.written: list[str] = []
        self.pairs = np.zeros(0, np.int64)
        self.firsts = np.zeros(1, np.int64)

    def add(self, parts: list[str], counts: np.ndarray, written: list[str], pairs: np.ndarray) -> None:
        self.known.update(zip(parts, range(len(self.written), len(self.written) + len(parts))))
        self.written += written
        self.counts = np.concatenate([self.counts, counts])
        self.firsts = np.concatenate([self.firsts, self.firsts[-1] + np.cumsum(counts[:, 3])])
        self.pairs = np.concatenate([self.pairs, pairs])

    def of(self, which: np.ndarray, written: bool = True) -> tuple[np.ndarray, list[str], np.ndarray]:
        counts = self.counts[which]
        sizes = counts[:, 3]
        place = np.arange(sizes.sum()) + np.repeat(self.firsts[which] - np.cumsum(sizes) + sizes, sizes)
        return counts, [self.written[i] for i in which.tolist()] if written else [], self.pairs[place]


def _byte_level(path: str) -> list[bytes]:
    """What the ids of a byte-level vocabulary spell."""
    signs = byte_of_sign()
    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    spelt = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        spelt[i] = bytes(signs[c] for c in token) if all(c in signs for c in token) else token.encode()
    return spelt


def _aligned_rows(batches: Iterator[pa.RecordBatch], byte_level: str, pieces: str) -> Iterator[pa.RecordBatch]:
    aligner = Aligner(byte_level, pieces)
    context = TaskContext.get()
    chunk = (context.partitionId() if context else 0) << 32
    types = [pa.int64()] * 6 + [pa.string()] + [pa.list_(pa.int64())] * 2
    names = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "counts"]
    for batch in batches:
        texts, rows = batch.column(1).to_pylist(), []
        for at in range(0, len(texts), TOGETHER):
            rows += aligner.rows(texts[at:at + TOGETHER])
        columns = [[chunk] * len(texts), batch.column(0), *(list(zip(*rows)) or [()] * 7)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
        chunk += 1


def align(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """Both sides' tokens of every text, in groups, with the pairs of ids linked in it.

    ``docs`` has ``doc_id`` and ``text``. Texts are encoded behind one space; special tokens in a text
    are plain text. NULL and empty texts, and texts that the tokens of a side do not spell (such
    as those with U+2581), have no tokens: zeros and an empty ``groups_sha256``. Every row of
    ``docs`` has a row, repeated ones too. ``pairs`` are ids of the first side times ``STRIDE``
    plus ids of the second, ``counts`` their links in the text; ``chunk`` names the batch of documents.
    """
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return known.mapInArrow(lambda batches: _aligned_rows(batches, byte_level, pieces), ALIGNED)


def _judged(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Sums over the links of a chunk's documents, from the corpus-wide counts of its pairs."""
    keys = pairs["pair"].to_numpy()
    order = np.argsort(keys)
    keys, count, best = keys[order], pairs["count"].to_numpy()[order], pairs["best"].to_numpy()[order]
    lists = docs["pairs"].combine_chunks()
    place = np.searchsorted(keys, lists.flatten().to_numpy(zero_copy_only=False))
    times = docs["counts"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(docs)), lists.value_lengths().to_numpy(zero_copy_only=False))
    n_best, total = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    if len(place):
        np.add.at(n_best, owner, times * best[place])
        np.add.at(total, owner, times * count[place])
    kept = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    return kept.append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(total)).append_column(
        "groups_sha256", docs["groups_sha256"])


def judge(aligned: DataFrame) -> DataFrame:
    """Add to each document how its links stand in the whole corpus.

    ``aligned`` is a stored result of ``align``. A pair's count is how many links of all documents
    link it. ``n_best`` counts the links whose count is the highest that their second id has, ties
    included; ``count_sum`` sums the counts over all links.
    """
    wanted = (
        aligned.select("chunk", F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
        .groupBy("chunk", F.col("p.pairs").alias("pair")).agg(F.sum("p.counts").alias("n"))
    )
    wanted = stored(wanted)
    counts = wanted.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("b", F.expr(f"pair % {STRIDE}"))
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    known = counts.join(highest, "b").select("pair", "count", (F.col("count") == F.col("highest")).alias("best"))
    told = wanted.select("chunk", "pair").join(known, "pair")
    schema = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
              "groups_sha256 string")
    return aligned.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_judged, schema)


def alignment(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """``align`` and ``judge`` in one: documents are encoded once and what they gave is stored."""
    return judge(stored(align(docs, byte_level, pieces)))
