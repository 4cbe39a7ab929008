"""Removal of word passages that occur more than once (operator 8).

Texts that may share 35 successive words meet in shards (see repeats.py).  A shard
numbers its words, confirms which 35-word windows recur, compiles them into an
Aho-Corasick automaton over word numbers (pyahocorasick), and streams its texts
through it to locate every occurrence.

Defined results: a null text has no words; rows that share an id are separate texts,
each judged by its own words, so that a repeated row is an occurrence elsewhere; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .repeats import Scheme, gone, removed

WINDOW = 35
ANCHOR_WORDS = 8
SCHEME = Scheme(WINDOW, ANCHOR_WORDS, words=True, smaller=False)


def settle(keys: list, docs: list, starts: list, windows: list, pieces: list) -> list[np.ndarray]:
    """For each piece, which of its windows recur among the pieces."""
    numbers: dict[bytes, int] = {}
    texts = [tuple([numbers.setdefault(w, len(numbers)) for w in p.split()]) for p in pieces]
    seen = Counter(t[i : i + WINDOW] for t, n in zip(texts, windows, strict=True) for i in range(n))
    phrases = [p for p, n in seen.items() if n > 1]
    masks = [np.zeros(n, bool) for n in windows]
    if phrases:
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, p in enumerate(phrases):
            automaton.add_word(p, i)
        automaton.make_automaton()
        for t, mask in zip(texts, masks, strict=True):
            for end, _ in automaton.iter(t):
                mask[end - WINDOW + 1] = True
    return masks


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows: list[list] = [[], [], [], [], []]
        for doc, row, text, found in zip(b.column("doc_id").to_pylist(), b.column("row").to_pylist(), b.column("text"), b.column("ranges"), strict=True):
            words = text.as_py().encode().split()
            n = len(words)
            mask = gone(n, row, found, WINDOW)
            if mask is not None:
                words = [words[i] for i in np.flatnonzero(~mask).tolist()]
            kept = b" ".join(words)
            for column, value in zip(rows, (doc, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in rows[:3]], pa.array(rows[3], pa.string()), pa.array(rows[4], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def deduplicate(docs: DataFrame, scheme: Scheme = SCHEME) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the remaining words)."""
    return removed(docs, scheme, settle).mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op8_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {"op8_phrase_dedup": op8_phrase_dedup}
ORACLE: dict[str, str] = {}
