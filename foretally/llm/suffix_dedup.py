"""Removal of byte strings that repeat across documents (operator 7).

Texts that may share a 50-byte string meet in shards (see repeats.py).  A shard sorts
the suffixes of its texts by their first 50 bytes, takes the Burrows-Wheeler
transform, and derives common prefixes by increasing value: starting from the
interval of all suffixes, level l extends each interval backward by each byte that
precedes it; where the right end of a new interval has no value yet, that value is
l, and only such intervals are extended further.  It stops at level 50.  Boundaries
still without a value then part suffixes that share 50 bytes or more, so runs of
them are the classes of equal strings.

Defined results: a null text is empty; documents shorter than the window lose
nothing; rows that share an id are one document, so that none is removed for another of them, and each
is judged by its own text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernels as K
from .common import table
from .repeats import Scheme, gone, removed

MIN_BYTES = 50
ANCHOR_BYTES = 16
#: Parts texts in a shard; no UTF-8 text has this byte, and it sorts after all others.
SEPARATOR = 255


def sorted_suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of suffixes in the order of their first `depth` bytes."""
    n = len(text)
    padded = np.concatenate((text, np.full(8, SEPARATOR, np.uint8))).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key |= padded[j : j + n] << np.uint64(56 - 8 * j)
    have = 8
    while True:
        order = np.argsort(key)
        s = key[order]
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(np.append(False, s[1:] != s[:-1])).astype(np.uint64)
        if have >= depth:
            return order
        step = min(have, depth - have)
        key = (rank << np.uint64(32)) | rank[np.minimum(np.arange(n) + step, n - 1)]
        have += step


def shared_prefix_classes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix order, class of each place in it): suffixes of a class share their first `depth` bytes."""
    n = len(text)
    order = sorted_suffixes(text, depth)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = np.where(order > 0, text[order - 1], SEPARATOR)  # the transform
    back = place[np.maximum(order - 1, 0)]
    first = text[order]
    value = np.full(n + 1, -1, np.int16)
    value[0] = value[n] = 0
    left, right = np.array([0]), np.array([n])
    tag = np.zeros(n, np.int64)
    for level in range(depth):
        size = right - left
        rows = K.ranges(left, size)
        whose = np.repeat(np.arange(len(left)), size)
        keep = before[rows] != SEPARATOR
        to = back[rows[keep]]
        tag[to] = whose[keep]
        to.sort()
        if not len(to):
            break
        new = np.ones(len(to), bool)
        new[1:] = (to[1:] != to[:-1] + 1) | (tag[to[1:]] != tag[to[:-1]]) | (first[to[1:]] != first[to[:-1]])
        begin = np.flatnonzero(new)
        left, right = to[begin], to[np.append(begin[1:], len(to)) - 1] + 1
        fresh = value[right] < 0
        left, right = left[fresh], right[fresh]
        value[right] = level
    return order, np.cumsum(value[:n] >= 0) - 1


def settle(keys: list, docs: list, starts: list, windows: list, pieces: list) -> list[np.ndarray]:
    """For each piece, which of its windows also start in a piece of a document with a smaller id."""
    length = MIN_BYTES
    text = np.frombuffer(bytes([SEPARATOR]).join(pieces) + bytes([SEPARATOR]) * (length + 1), np.uint8)
    count = np.array(windows)
    at = np.cumsum([0, *[len(p) + 1 for p in pieces[:-1]]])
    order, classes = shared_prefix_classes(text, length)
    doc = np.full(len(text), np.iinfo(np.int64).max)
    where = K.ranges(at, count)
    doc[where] = np.repeat(np.array(docs, np.int64), count)
    in_order = doc[order]
    least = np.minimum.reduceat(in_order, np.flatnonzero(np.append(True, classes[1:] != classes[:-1])))
    gone = np.zeros(len(text), bool)
    gone[order] = in_order > least[classes]
    return np.split(gone[where], np.cumsum(count)[:-1])


SCHEME = Scheme(MIN_BYTES, ANCHOR_BYTES, words=False, smaller=True)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[list] = [[], [], [], [], [], []]
        for doc, row, text, found in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), b.column("text"), b.column("ranges"), strict=True):
            data = text.as_py().encode()
            kept, n, spans = data, len(data), 0
            mask = gone(n, row, found, MIN_BYTES)
            if mask is not None:
                kept = np.frombuffer(data, np.uint8)[~mask].tobytes()
                spans = int(np.count_nonzero(mask[1:] & ~mask[:-1]) + bool(n and mask[0]))
            for column, value in zip(rows, (doc, n, n - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in rows[:4]], pa.array(rows[4], pa.string()), pa.array(rows[5], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def deduplicate(docs: DataFrame, scheme: Scheme = SCHEME) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes)."""
    return removed(docs, scheme, settle).mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
ORACLE: dict[str, str] = {}
