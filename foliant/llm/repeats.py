"""Removal of long passages that an earlier document already has, found by recompression.

A text is a sequence of words. In rounds, runs of one symbol and then pairs of neighbouring symbols
get names. A name is a hash of what it stands for, so it is the same in every document without
asking for it. Which neighbours pair up depends on their names alone (a hash puts every symbol on
the left or the right side, and a left one joins a right one that follows), so equal passages are
cut alike but for their edges. With every symbol goes how many words to its left and right decided
that it is there. A symbol whose deciding words lie in a window is in every copy of the window.

Of the symbols a window holds in this way, those with the smallest and the largest name together
stand for it; a window that holds none stands for itself. Two copies of a window have the same representative, so only
windows whose representative is in several documents can be repeats. Just those are compared, by a
128-bit hash of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.shared import stored
from foliant.llm.words import NON_SPACE, Words, blocks, mixed

ROUNDS = 6
# Words of a symbol, at most.
LARGEST = 12
_FAR = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
# One number per round; with it a name falls on the left or the right side.
_SIDES = mixed(np.arange(1, ROUNDS + 1, dtype=np.uint64))
_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
# Documents are looked up by so many values of a hash of their id; the list of values is broadcast.
LOOKUP = 1 << 18


class Symbols:
    """Symbols of texts: the text's number, name, words, and deciding words left and right."""

    def __init__(self, words: np.ndarray, owner: np.ndarray):
        n = len(words)
        self.name, self.owner = mixed(words), owner
        self.size = np.ones(n, np.int64)
        self.left, self.right = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def _reach(self) -> tuple[np.ndarray, np.ndarray]:
        """Deciding words if the left, or the right, neighbour matters as well; far at the ends."""
        left, right = np.full(len(self.name), _FAR), np.full(len(self.name), _FAR)
        left[1:] = np.maximum(self.left[1:], self.size[:-1] + self.left[:-1])
        right[:-1] = np.maximum(self.right[:-1], self.size[1:] + self.right[1:])
        edge = np.flatnonzero(self.owner[1:] != self.owner[:-1])
        left[edge + 1] = right[edge] = _FAR
        return left, right

    def runs(self) -> None:
        """Name runs of one symbol, unless they are too long."""
        n = len(self.name)
        other = (self.name[1:] != self.name[:-1]) | (self.owner[1:] != self.owner[:-1])
        start = np.flatnonzero(np.concatenate([[True], other]))
        count = np.diff(np.append(start, n))
        left, right = self._reach()
        self.left, self.right = left, right
        if len(start) == n:
            return
        last = start + count - 1
        total = count * self.size[start]
        joined = (count > 1) & (total <= LARGEST)
        # Symbols of a long run stay, decided by all of it.
        long = np.repeat((count > 1) & ~joined, count)
        run = np.repeat(np.arange(len(start)), count)
        step = np.arange(n) - start[run]
        self.left = np.where(long, left[start][run] + step * self.size, left)
        self.right = np.where(long, right[last][run] + (count[run] - 1 - step) * self.size, right)
        keep = np.ones(n, bool)
        keep[joined[run] & (step > 0)] = False
        first = start[joined]
        self.name[first] = mixed(self.name[first] * _ODD + count[joined].astype(np.uint64))
        self.right[first] = right[last[joined]]
        self.size[first] = total[joined]
        self._take(keep)

    def pairs(self, number: int) -> None:
        """Name pairs of a left symbol and a right one that follows."""
        side = (mixed(self.name + _SIDES[number]) & np.uint64(1)).astype(bool)
        merge = np.zeros(len(self.name), bool)
        merge[:-1] = ~side[:-1] & side[1:] & (self.size[:-1] + self.size[1:] <= LARGEST)
        merge[:-1] &= self.owner[1:] == self.owner[:-1]
        left, right = self._reach()
        first = np.flatnonzero(merge)
        second = first + 1
        after = np.zeros(len(merge), bool)
        after[second] = True
        # A left symbol stays because of its right neighbour, a right one because of its left one.
        new_left = np.where(side & ~after, left, self.left)
        new_right = np.where(~side & ~merge, right, self.right)
        new_left[first] = np.maximum(self.left[first], self.left[second] - self.size[first])
        new_right[first] = np.maximum(self.right[second], self.right[first] - self.size[second])
        name, size = self.name.copy(), self.size.copy()
        name[first] = mixed(mixed(self.name[first] * _ODD) + self.name[second])
        size[first] += self.size[second]
        self.name, self.size, self.left, self.right = name, size, new_left, new_right
        self._take(~after)

    def _take(self, keep: np.ndarray) -> None:
        self.name, self.size = self.name[keep], self.size[keep]
        self.left, self.right, self.owner = self.left[keep], self.right[keep], self.owner[keep]


def window_hashes(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every ``window`` consecutive words."""
    out = []
    for base in _BASES:
        powers = np.cumprod(np.full(len(words) + 1, base, np.uint64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(words ^ base) * powers[:-1])])
        # The base is odd, so its powers have inverses.
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        back = np.cumprod(np.full(len(words) + 1, inverse, np.uint64))[:len(words) - window + 1]
        out.append(mixed((sums[window:] - sums[:-window]) * back))
    return out[0], out[1]


def representatives(words: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """The name that stands for the window that begins at each word.

    ``words`` are the hashes of several texts' words and ``first`` the places where the texts
    begin, and the end. Places too near the end of a text for a window hold no name of use.
    """
    best, most = np.full(len(words), _NONE), np.zeros(len(words), np.uint64)
    if not len(words):
        return best
    length = np.diff(first)
    symbols = Symbols(words, np.repeat(np.arange(len(length)), length))
    symbols.runs()
    for number in range(ROUNDS):
        symbols.pairs(number)
    stop = np.cumsum(symbols.size)
    start = stop - symbols.size
    low = np.maximum(stop + symbols.right - window, first[symbols.owner])
    high = np.minimum(start - symbols.left, first[symbols.owner + 1] - window)
    good = low <= high
    low, width, name = low[good], (high - low + 1)[good], symbols.name[good]
    while len(low):
        np.minimum.at(best, low, name)
        np.maximum.at(most, low, name)
        more = width > 1
        low, width, name = low[more] + 1, width[more] - 1, name[more]
    alone = np.flatnonzero(best == _NONE)
    best = mixed(best * _ODD + most)
    alone = alone[alone + window <= first[np.searchsorted(first, alone, "right")]]
    if len(alone):
        best[alone] = mixed(window_hashes(words, window)[0][alone] ^ _ODD)
    return best


def _texts(texts: pa.Array, window: int = 0) -> Iterator[tuple]:
    """For every text its row, word hashes, names of its windows if ``window`` is given, and bytes
    with where the words start and stop in them."""
    for row, end, data, offsets in blocks(texts):
        words = Words(data, offsets, False, NON_SPACE)
        hashes, raw = words.hashes(), data.tobytes()
        names = representatives(hashes, words.first, window) if window else hashes[:0]
        for i in range(end - row):
            a, b = int(words.first[i]), int(words.first[i + 1])
            own = names[a:max(a, b - window + 1)]
            yield row + i, hashes[a:b], own, raw, words.start[a:b], words.stop[a:b]


def _digest(words: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little")


def _signed(values) -> pa.Array:
    return pa.array(np.ascontiguousarray(values, np.uint64).view(np.int64))


def _joined(raw: bytes, starts: np.ndarray, stops: np.ndarray) -> str:
    """SHA-256 of words joined by one space."""
    words = [raw[a:b] for a, b in zip(starts.tolist(), stops.tolist())]
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _measured(docs: DataFrame, window: int) -> DataFrame:
    """A row per text with ``n_words``, digest ``g`` of the words and ``sha``; and, with ``name``,
    a row per text and representative."""
    names = ["doc_id", "n_words", "g", "sha", "name"]

    def measure(batches):
        seen = set()
        for batch in batches:
            ids, rows = batch.column(0), batch.num_rows
            n, g, sha = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), [""] * rows
            found, owners = [], []
            for row, words, named, raw, starts, stops in _texts(batch.column(1), window):
                n[row], g[row] = len(words), _digest(words)
                sha[row] = _joined(raw, starts, stops)
                if len(words) >= window and g[row] not in seen:
                    seen.add(g[row])
                    own = np.unique(named)
                    found.append(own)
                    owners.append(np.full(len(own), g[row], np.uint64))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n), _signed(g), pa.array(sha, pa.string()), pa.nulls(rows, pa.int64())],
                names)
            if found:
                all_names = np.concatenate(found)
                blank = len(all_names)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(blank, pa.int64()), pa.nulls(blank, pa.int64()),
                     _signed(np.concatenate(owners)), pa.nulls(blank, pa.string()),
                     _signed(all_names)], names)

    return docs.mapInArrow(measure, "doc_id long, n_words long, g long, sha string, name long")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """Windows of texts (doc_id, text, g, shared names) whose representative is shared."""

    def emit(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            g = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            for row, words, named, *_ in _texts(batch.column(1), window):
                if len(words) < window or _digest(words) != int(g[row]):
                    continue
                shared = np.array(batch.column(3)[row].as_py(), np.int64).view(np.uint64)
                at = np.flatnonzero(np.isin(named, shared))
                one, two = window_hashes(words, window)
                yield pa.RecordBatch.from_arrays(
                    [_signed(one[at]), _signed(two[at]), pa.array(np.full(len(at), ids[row], np.int64)),
                     pa.array(np.full(len(at), g[row], np.uint64).view(np.int64)),
                     pa.array(at.astype(np.int32))],
                    ["h", "h2", "doc_id", "g", "at"])

    return docs.mapInArrow(emit, "h long, h2 long, doc_id long, g long, at int")


def _cut(docs: DataFrame, window: int) -> DataFrame:
    """Remove the windows that start at given places from texts (doc_id, text, g, places)."""

    def emit(batches):
        for batch in batches:
            ids, g, removed, sha, spans = [], [], [], [], []
            for row, words, _, raw, starts, stops in _texts(batch.column(1)):
                digest = batch.column(2)[row].as_py()
                if np.int64(np.uint64(_digest(words))) != digest:
                    continue
                at = np.array(batch.column(3)[row].as_py(), np.int64)
                change = np.bincount(at, minlength=len(words) + 1)
                change -= np.bincount(at + window, minlength=len(words) + 1)[:len(change)]
                gone = np.cumsum(change)[:len(words)] > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                ids.append(batch.column(0)[row].as_py())
                g.append(digest)
                removed.append(int(gone.sum()))
                sha.append(_joined(raw, starts[~gone], stops[~gone]))
                spans.append([{"start": int(a), "stop": int(b)} for a, b in edges.reshape(-1, 2)])
            if ids:
                kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(g, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(sha), pa.array(spans, kind)],
                    ["doc_id", "g", "n_removed", "kept_sha256", "spans"])

    return docs.mapInArrow(
        emit, "doc_id long, g long, n_removed long, kept_sha256 string, "
        "spans array<struct<start:long,stop:long>>")


def _with_texts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """Texts of some documents. Most others are dropped before the shuffle by a list of hash
    values of LOOKUP entries at most."""
    value = F.pmod(F.xxhash64("doc_id"), F.lit(LOOKUP)).alias("value")
    values = F.broadcast(wanted.select(value).distinct())
    near = docs.withColumn("value", value).join(values, "value", "left_semi").drop("value")
    return near.join(wanted, "doc_id")


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """Mark the words of every text that are in a long passage of an earlier document.

    A window is ``window`` consecutive words (cut at white space) of one document. Words are
    removed if they are in a window whose words also follow one another in a document with a
    smaller ``doc_id``; windows are judged on the texts as they came. Returns for every row
    ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words joined by one space)
    and ``spans`` (removed stretches as structs start, stop, in words). NULL, empty and short texts
    lose nothing. Rows without a ``doc_id`` take no part and lose nothing; rows with the same
    ``doc_id`` do not remove from each other. An empty table gives no rows. Other columns are not
    looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    measured = stored(_measured(docs, window))
    texts = measured.where("sha IS NOT NULL")
    # Texts with the same words are one; the first of them stays, the later ones go.
    firsts = stored(
        texts.where("doc_id IS NOT NULL").groupBy("g")
        .agg(F.min("doc_id").alias("doc_id"), F.min("n_words").alias("n"))
    )
    names = measured.where("name IS NOT NULL").select("name", "g")
    several = names.groupBy("name").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x <> y")
    shared = (
        names.join(several.select("name"), "name").groupBy("g").agg(F.collect_set("name").alias("names"))
    )
    wanted = stored(shared.join(firsts, "g").select("doc_id", "g", "names"))
    kept = docs.where("doc_id IS NOT NULL")
    windows = stored(_windows(
        _with_texts(wanted, kept).select("doc_id", "text", "g", "names"), window))
    least = windows.groupBy("h", "h2").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    repeats = windows.join(least, ["h", "h2"]).where("doc_id > first")
    places = stored(repeats.groupBy("doc_id", "g").agg(F.collect_set("at").alias("places")))
    cut = stored(_cut(_with_texts(places, kept).select("doc_id", "text", "g", "places"), window)
                 .dropDuplicates(["doc_id", "g"]))

    nothing = F.array().cast("array<struct<start:bigint,stop:bigint>>")
    late = (F.col("doc_id") > F.col("first")) & (F.col("n_words") >= window)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("stop")))
    return (
        texts.join(firsts.selectExpr("g", "doc_id first"), "g", "left")
        .join(cut, ["doc_id", "g"], "left")
        .select(
            "doc_id", "n_words",
            F.when(late, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
            F.when(late, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha"))
            .alias("kept_sha256"),
            F.when(late, whole).otherwise(F.coalesce("spans", nothing)).alias("spans"),
        )
    )
