"""Documents that contain benchmark items (operator 5).

Words are runs of letters and digits, lower-cased.  A benchmark item of n words is
looked for in windows of n, n - 1 and n - 2 words, so that an item whose first or last word
has grown together with its surroundings is still found.  A window and an item match if the
weighted Jaccard similarity of their five-word shingles is 0.8 or more.

1. A window that reaches 0.8 holds at least 0.8 of its shingles from the benchmark, so
   others are passed over without loss.
2. Each remaining window gets a 64-bit SimHash.  Four tables, one for each 16-bit
   block, list the items with any block value at most BLOCK_RADIUS bits away: a
   fingerprint within RADIUS bits of an item's must be in one of them.
3. Candidates within RADIUS are verified exactly.

The benchmark is taken in blocks of at most BLOCK_ITEMS items and BROADCAST_BYTES
bytes; each block is sent to all tasks, and one scan of the documents serves it.

An item of one to four words is one shingle as a whole: the windows of as many words are compared
with it exactly, all of them.

Defined results: null texts and items and such without a word match nothing; equal items and repeated rows each have their own
matches; with an empty table on either side the result is empty; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import BROADCAST_BYTES, only, table

SHINGLE = 5
SIMILARITY = 0.8
SLACK = 2
BLOCKS, BLOCK_RADIUS = 4, 4
#: The blocks' guarantee: if all four differ in five bits or more, the distance is 20 or more.
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
BLOCK_ITEMS = 1000
_BITS = 64 // BLOCKS
_GATE_BITS = 20


def _masks() -> np.ndarray:
    out = [0]
    for r in range(1, BLOCK_RADIUS + 1):
        out += [sum(1 << b for b in c) for c in combinations(range(_BITS), r)]
    return np.array(out, np.int64)


def _signs(grams: np.ndarray) -> np.ndarray:
    """+1 or -1 by the bits of each shingle's hash."""
    return (np.unpackbits(grams.astype(">u8").view(np.uint8)).reshape(-1, 64).astype(np.int32) << 1) - 1


def _fingerprint(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(">u8").reshape(-1).astype(np.uint64)


def _word_hashes(column: pa.Array) -> Iterator[tuple[int, K.Words]]:
    for lo, _, buf, offs in K.chunks(column):
        yield lo, K.Words(buf, offs, K.PUNCT, K.FOLD)


class Index:
    """A block of items: their shingles, fingerprints and block tables."""

    def __init__(self, ids: list[int], texts: list[str]):
        self.ids, self.lengths, self.items = [], [], []
        #: By number of words: the hashes and ids of items without a shingle.
        self.short: dict[int, tuple[list, list]] = {}
        for lo, w in _word_hashes(pa.array(texts, pa.string())):
            for i, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
                if 0 < b - a < SHINGLE:
                    hashes, owners = self.short.setdefault(int(b - a), ([], []))
                    hashes.append(K.Prefix(w.hash[a:b]).grams(int(b - a))[0])
                    owners.append(ids[lo + i])
                if b - a >= SHINGLE:
                    self.ids.append(ids[lo + i])
                    self.lengths.append(int(b - a))
                    self.items.append(K.Prefix(w.hash[a:b]).grams(SHINGLE))
        self.counts = [np.unique(g, return_counts=True) for g in self.items]
        self.known = np.unique(np.concatenate(self.items)) if self.items else np.zeros(0, np.uint64)
        self.gate = np.zeros(1 << _GATE_BITS, bool)
        self.gate[(self.known & np.uint64((1 << _GATE_BITS) - 1)).astype(np.int64)] = True
        n = len(self.items)
        self.prints = _fingerprint(np.stack([_signs(g).sum(axis=0) for g in self.items])) if n else np.zeros(0, np.uint64)
        self.tables = []
        masks = _masks()
        for k in range(BLOCKS):
            values = ((self.prints >> np.uint64(k * _BITS)) & np.uint64((1 << _BITS) - 1)).astype(np.int64)
            at = (values[:, None] ^ masks[None, :]).reshape(-1)
            order = np.argsort(at, kind="stable")
            self.tables.append((np.searchsorted(at[order], np.arange((1 << _BITS) + 1)), (order // len(masks)).astype(np.int32)))
        self.windows = sorted({n - d for n in self.lengths for d in range(SLACK + 1) if n - d >= SHINGLE})

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in prints, item) of all within RADIUS."""
        query, item = [], []
        for k, (start, items) in enumerate(self.tables):
            v = ((prints >> np.uint64(k * _BITS)) & np.uint64((1 << _BITS) - 1)).astype(np.int64)
            size = start[v + 1] - start[v]
            query.append(np.repeat(np.arange(len(prints)), size))
            item.append(items[K.ranges(start[v], size)])
        q, i = np.concatenate(query), np.concatenate(item).astype(np.int64)
        q, i = np.divmod(np.unique(q * len(self.items) + i), max(1, len(self.items)))
        close = np.bitwise_count(prints[q] ^ self.prints[i]) <= RADIUS
        return q[close], i[close]


def short_matches(index: Index, words: K.Words) -> Iterator[tuple[int, int, int, int, float]]:
    """The first place of each item without a shingle in each text."""
    for n, (hashes, owners) in index.short.items():
        grams = K.Prefix(words.hash).grams(n)
        own, owner = np.array(hashes, np.uint64), np.array(owners, np.int64)
        at = np.flatnonzero(np.isin(grams, own))
        at = at[words.text[at] == words.text[at + n - 1]]
        seen = set()
        for place, text in zip(at.tolist(), words.text[at].tolist(), strict=True):
            for item in owner[own == grams[place]].tolist():
                if (text, item) not in seen:
                    seen.add((text, item))
                    yield text, item, place - int(words.first[text]), n, 1.0


def matches(index: Index, words: K.Words) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, item, first word, words, similarity): the best window of each text and item."""
    yield from short_matches(index, words)
    grams = K.Prefix(words.hash).grams(SHINGLE)
    if not len(grams) or not len(index.known):
        return
    maybe = np.flatnonzero(index.gate[(grams & np.uint64((1 << _GATE_BITS) - 1)).astype(np.int64)])
    place = np.minimum(np.searchsorted(index.known, grams[maybe]), len(index.known) - 1)
    hits = maybe[(index.known[place] == grams[maybe]) & (words.text[maybe] == words.text[maybe + SHINGLE - 1])]
    if not len(hits):
        return
    lengths = np.array(index.lengths)
    longest = index.windows[-1]
    # regions of windows around hits, so that sums are over them only
    new = np.append(True, (hits[1:] - hits[:-1] > longest) | (words.text[hits[1:]] != words.text[hits[:-1]]))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hits)) - 1
    best: dict[tuple[int, int], tuple] = {}
    for a, z in zip(hits[first].tolist(), hits[last].tolist(), strict=True):
        text = int(words.text[a])
        lo, hi = max(int(words.first[text]), a - longest), min(int(words.first[text + 1]), z + SHINGLE + longest)
        g = grams[lo : hi - SHINGLE + 1]
        known = np.zeros(len(g) + 1, np.int64)
        inside = hits[np.searchsorted(hits, lo) : np.searchsorted(hits, hi)] - lo
        known[inside[inside < len(g)] + 1] = 1
        known = np.cumsum(known)
        sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(_signs(g), axis=0, dtype=np.int32)))
        for n in index.windows:
            m = n - SHINGLE + 1
            if m > len(g):
                break
            at = np.flatnonzero(known[m:] - known[:-m] >= SIMILARITY * m)
            if not len(at):
                continue
            query, item = index.near(_fingerprint(sums[at + m] - sums[at]))
            fits = (lengths[item] >= n) & (lengths[item] <= n + SLACK)
            for s, i in zip(at[query[fits]].tolist(), item[fits].tolist(), strict=True):
                value = weighted_jaccard(np.unique(g[s : s + m], return_counts=True), index.counts[i])
                if value >= SIMILARITY and value > best.get((text, i), (0, 0, 0.0))[2]:
                    best[text, i] = (lo + s - int(words.first[text]), n, value)
    for (text, i), (start, n, value) in best.items():
        yield text, index.ids[i], start, n, value


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    _, x, y = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][x], b[1][y]).sum()
    return float(both / (a[1].sum() + b[1].sum() - both))


def _scan(index: Index) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = b.column("doc_id"), []
            for lo, w in _word_hashes(b.column("text")):
                out += [(ids[lo + t].as_py(), *rest) for t, *rest in matches(index, w)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.float64())], names=["doc_id", "item_id", "start_word", "n_words", "similarity"])

    return run


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark in bounded blocks; the driver holds one at a time."""
    ids, texts, size = [], [], 0
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    for item, text in rows.toLocalIterator():
        if ids and (len(ids) >= BLOCK_ITEMS or size + len(text) > BROADCAST_BYTES):
            yield Index(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(item)
        texts.append(text)
        size += len(text)
    yield Index(ids, texts)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: the best window of each document and item that match."""
    d = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, start_word long, n_words long, similarity double"
    return reduce(DataFrame.unionByName, [d.mapInArrow(_scan(index), schema) for index in blocks(benchmark)])


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_decontamination": op5_decontamination}
ORACLE: dict[str, str] = {}
