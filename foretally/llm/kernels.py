"""Vectorised text kernels used inside Arrow map tasks.

All of them work on one flat UTF-8 buffer holding many texts, so that the cost
per text is a slice and not a loop.  Hashes are 64-bit polynomial hashes over
random byte values, finished by a mixer; a prefix sum gives the hash of any
range in constant time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

#: Bytes that part words: space and 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

#: Lower-case ASCII letters and digits stay, other bytes above 127 stay, the rest parts words.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
PUNCT = np.ones(256, bool)
PUNCT[48:58] = PUNCT[97:123] = PUNCT[65:91] = PUNCT[128:] = False

_BYTE = np.random.RandomState(20240229).randint(1, 2**63 - 1, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(8)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n + 1).bit_length())
    up, down = _powers(base, size)
    return up[: n + 1], down[: n + 1]


class Prefix:
    """Hashes of ranges of a sequence of 64-bit symbols."""

    def __init__(self, symbols: np.ndarray, base: int = _WORD_BASE):
        up, self.down = powers(base, len(symbols))
        self.sums = np.zeros(len(symbols) + 1, np.uint64)
        np.cumsum(symbols * up[:-1], out=self.sums[1:])

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """The hash of each run of k symbols, by its start."""
        n = len(self.sums) - k
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:-k]) * self.down[:n] + np.uint64(k))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the offsets of a string column; a null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets): whole texts, about `size` bytes together."""
    buf, offs = texts(column)
    row, n = 0, len(column)
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offs, offs[row] + size, "right")) - 1)
        stop = min(stop, n)
        yield row, stop, buf[offs[row] : offs[stop]], offs[row : stop + 1] - offs[row]
        row = stop


class Words:
    """The words of a chunk: start, end (bytes), text (row in the chunk), hash; `first` has the first word of each row."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, parts: np.ndarray = SPACE, fold: np.ndarray | None = None):
        n = len(buf)
        inside = ~parts[buf]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        at = offs[:-1][offs[:-1] < offs[1:]]
        begins[at] = inside[at]
        ends = np.ones(n, bool)
        ends[:-1] = ~inside[1:]
        if len(at):
            ends[at[1:] - 1] = True
        ends &= inside
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.text = np.searchsorted(offs, self.start, "right") - 1
        self.first = np.searchsorted(self.text, np.arange(len(offs)))
        self.prefix = Prefix(_BYTE[buf if fold is None else fold[buf]], _BASE)
        self.hash = self.prefix.ranges(self.start, self.end)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def byte_prefix(buf: np.ndarray) -> Prefix:
    return Prefix(_BYTE[buf], _BASE)


def per_row(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of flags between successive bounds, also where a range is empty."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[bounds])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w successive values."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return out if have == w else np.minimum(out[: len(out) - (w - have)], out[w - have :])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each (start, length), one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return shift + np.arange(total)


def covered(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A mask of what the ranges cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """A mask of the keys that occur twice or more."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(s), bool)
    if len(s) > 1:
        eq = s[1:] == s[:-1]
        same[1:] |= eq
        same[:-1] |= eq
    out = np.zeros(len(s), bool)
    out[order] = same
    return out
