"""Words of many texts at once: offsets and 64-bit hashes, taken from UTF-8 bytes with numpy.

Every separator is an ASCII byte, and no byte of a longer UTF-8 character is, so words are cut on
bytes without decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

# Bytes of texts worked on at a time; one text may be longer.
BLOCK = 4 << 20
LONG_WORD = 64

_SPACE = np.ones(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False
# Bytes of words between white space.
NON_SPACE = _SPACE

_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x61:0x7B] = _ALNUM[0x80:] = True
# Bytes of words of letters and digits, in lower-cased text.
ALNUM = _ALNUM

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: pa.Array, most: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of rows: first and last row, all bytes, and the rows' offsets.

    NULL is an empty text. A run has ``most`` bytes at most, unless it is one row.
    """
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


class Words:
    """Words of a run of texts: ``start`` and ``stop`` in bytes, and ``first``, the number of the
    first word of each text and, at the end, of all words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, allowed: np.ndarray):
        if lower:
            data = LOWER[data]
        self.data = data
        inside = np.zeros(len(data) + 1, bool)
        inside[:-1] = allowed[data]
        # A word begins where the byte before is no word byte, or where a text begins.
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[edges] = inside[edges]
        ends = inside[:-1] & ~inside[1:]
        last = edges[1:] - 1
        ends[last] = inside[last]
        self.start = np.flatnonzero(begins[:-1])
        self.stop = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        length = (self.stop - self.start).astype(np.int64)
        out = mixed(length.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        padded = np.zeros(len(self.data) + 16, np.uint8)
        padded[:len(self.data)] = self.data
        eights = np.lib.stride_tricks.as_strided(
            padded[:8].view(np.uint64), (len(self.data) + 8,), (1,), writeable=False
        )
        todo = np.flatnonzero(length <= LONG_WORD)
        at = 0
        while len(todo):
            left = length[todo] - at
            value = eights[self.start[todo] + at]
            short = left < 8
            keep = np.where(short, left, 8).astype(np.uint64)
            mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * keep)
            out[todo] = mixed((out[todo] ^ (value & mask)) * np.uint64(0x9E3779B97F4A7C15))
            at += 8
            todo = todo[length[todo] > at]
        for i in np.flatnonzero(length > LONG_WORD):
            out[i] = xxhash.xxh64_intdigest(self.data[self.start[i]:self.stop[i]].tobytes())
        return out


def sequences(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of every ``n`` consecutive words; empty if there are fewer."""
    if len(hashes) < n:
        return hashes[:0]
    out = mixed(hashes[:len(hashes) - n + 1])
    for i in range(1, n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i:len(hashes) - n + 1 + i])
    return out
