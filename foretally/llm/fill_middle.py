"""Fill-in-middle transformation of documents at line ends (operator 11).

A text is cut in two places, each before or after a line, into prefix, middle and suffix, which
are written in another order behind markers: psm is prefix, suffix, middle, spm is suffix,
prefix, middle.  Places and order are drawn from a hash of the id, so that they hold
whatever the partitions are and whoever computes them again.

The line ends of many texts are one packed bit vector with a directory of the bits before each
block and each word of it (Bits).  The number of lines is a difference of two ranks; a cut
behind line k is one select; the code points before a cut are a rank in a second vector, which marks
the first bytes of code points.  A text is never split into a list of lines.

One map over the documents; nothing is shuffled.

Defined results: a null text is an empty one; a text that is empty or holds a marker stays plain, as do
those beyond `rate`; repeated rows give repeated rows; a row without an id goes; an empty table stays
empty; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .common import only, table

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Per cent of the texts that are transformed, and of these in the order spm.
RATE, SPM = 100, 50
SEED = 7
_COLUMNS = {"doc_id": pa.int64(), "n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output_sha256": pa.string(), "restored_sha256": pa.string()}


class Bits:
    """A packed bit vector with a directory: the bits before each block of WORDS words, and before each word in its block."""

    WORDS = 8

    def __init__(self, flags: np.ndarray):
        packed = np.zeros((len(flags) // (64 * self.WORDS) + 1) * 8 * self.WORDS, np.uint8)
        packed[: -(-len(flags) // 8)] = np.packbits(flags, bitorder="little")
        self.words = packed.view("<u8").reshape(-1, self.WORDS)
        counts = np.cumsum(np.bitwise_count(self.words), axis=1, dtype=np.int64)
        self.within = np.hstack((np.zeros((len(counts), 1), np.int64), counts[:, :-1]))
        self.before = np.append(0, np.cumsum(counts[:, -1]))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The set bits before each place."""
        block, word = np.divmod(at >> 6, self.WORDS)
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + self.within[block, word] + np.bitwise_count(self.words[block, word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th set bit; k from 1 to the number of set bits."""
        block = np.searchsorted(self.before, k, "left") - 1
        rest = k - self.before[block]
        word = (self.within[block] < rest[:, None]).sum(axis=1) - 1
        rest = rest - self.within[block, word]
        bits, at = self.words[block, word], np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count((bits >> at.astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)
            beyond = rest > low
            rest, at = rest - low * beyond, at + width * beyond
        return (block * self.WORDS + word) * 64 + at


def draws(ids: list[int], seed: int) -> np.ndarray:
    """Four unsigned 32-bit numbers an id."""
    return np.array([np.frombuffer(hashlib.sha256(b"%d:%d" % (seed, i)).digest()[:16], ">u4") for i in ids], np.int64).reshape(-1, 4)


def written(form: str, prefix: bytes, middle: bytes, suffix: bytes) -> bytes:
    if form == "plain":
        return prefix + middle + suffix
    return b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle) if form == "psm" else (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))


def restored(form: str, output: bytes) -> bytes:
    """The text, from what was written and its form alone."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    a, rest = output[len(first) :].split(second, 1)
    b, middle = rest.split(MIDDLE, 1)
    return a + middle + b if form == "psm" else b + middle + a


def cuts(buf: np.ndarray, offs: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    """(lines, bytes of the prefix, bytes to the middle's end, code points of the prefix, of the middle) of each text; the draws decide after how many lines."""
    ends = buf == 10
    some = offs[1:] > offs[:-1]
    ends[offs[1:][some] - 1] = True
    lines, points = Bits(ends), Bits((buf & 0xC0) != 0x80)
    before = lines.rank(offs[:-1])
    n = lines.rank(offs[1:]) - before
    x, y = first % (n + 1), second % (n + 1)
    at = []
    for k in (np.minimum(x, y), np.maximum(x, y)):
        place = offs[:-1].copy()
        place[k > 0] = lines.select((before + k)[k > 0]) + 1
        at.append(place)
    start, a, z = points.rank(offs[:-1]), points.rank(at[0]), points.rank(at[1])
    return n, at[0] - offs[:-1], at[1] - offs[:-1], a - start, z - a


def fill_middle(docs: DataFrame, rate: int = RATE, spm: int = SPM, seed: int = SEED, with_output: bool = True) -> DataFrame:
    """doc_id, n (lines), form, prefix_chars, middle_chars, output_sha256, restored_sha256 and output, the transformed text."""
    columns = _COLUMNS | ({"output": pa.string()} if with_output else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for lo, hi, buf, offs in K.chunks(b.column("text")):
                h = draws(ids[lo:hi], seed)
                rows: list[list] = [[] for _ in columns]
                numbers = [x.tolist() for x in (*cuts(buf, offs, h[:, 0], h[:, 1]), h[:, 2] % 100, h[:, 3] % 100)]
                for i, (n, a, z, before, between, kept, order) in enumerate(zip(*numbers, strict=True)):
                    text = buf[offs[i] : offs[i + 1]].tobytes()
                    plain = not text or kept >= rate or PREFIX in text or SUFFIX in text or MIDDLE in text
                    form = "plain" if plain else "spm" if order < spm else "psm"
                    out = written(form, text[:a], text[a:z], text[z:])
                    row = (ids[lo + i], n, form, None if plain else before, None if plain else between, hashlib.sha256(out).hexdigest(), hashlib.sha256(restored(form, out)).hexdigest(), out)
                    for column, value in zip(rows, row, strict=False):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary()).cast(t) if c == "output" else pa.array(v, t) for (c, t), v in zip(columns.items(), rows, strict=True)], names=list(columns))

    d = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(run, ", ".join(f"{c} {'string' if t == pa.string() else 'long'}" for c, t in columns.items()))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle(table(spark, sf_dir, "documents"), with_output=False)


QUERIES = {"op11_fill_middle": op11_fill_middle}
ORACLE = {
    "op11_fill_middle": r"""
with d as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as units, sha256('7:' || doc_id) as h
  from documents where doc_id is not null
), drawn as (
  select *, cast(len(units) as bigint) as n, cast('0x' || substr(h, 1, 8) as bigint) % (len(units) + 1) as x, cast('0x' || substr(h, 9, 8) as bigint) % (len(units) + 1) as y,
    cast('0x' || substr(h, 17, 8) as bigint) % 100 as kept, cast('0x' || substr(h, 25, 8) as bigint) % 100 as ordered
  from d
), parted as (
  select doc_id, t, n, array_to_string(units[1:least(x, y)], '') as p, array_to_string(units[least(x, y) + 1:greatest(x, y)], '') as m, array_to_string(units[greatest(x, y) + 1:n], '') as s,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or kept >= 100 then 'plain' when ordered < 50 then 'spm' else 'psm' end as form
  from drawn
)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
from parted"""
}
