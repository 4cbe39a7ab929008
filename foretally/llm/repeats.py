"""Search for windows of k symbols that occur elsewhere, as Spark stages.

Shared by the byte-level and the word-level substring operators; they differ in
their symbols, in which occurrences count, and in how a shard settles what its
texts share.

1. Texts are laid out once by document.  Equal texts are found by their SHA-256; all
   but those with the least id are settled by that and take no further part.
2. Every window has an anchor: the run of q symbols in it with the least hash.
   Equal windows have equal anchors.  Successive windows with the same anchor form
   a stretch, about one in (k - q + 2) / 2 symbols.  Two different stretches can share
   a window only if they agree in the anchor and half of the other k - q symbols on one
   side of it: a side.
3. Stretches are shuffled by anchor and read in order.  What is left of a group is a hit
   for a document: a stretch that as a whole occurs elsewhere (REMOVE), or the least copy
   of one that shares a side with a different stretch (SHIP).  No more than LONG
   rows of a group are held at a time.
4. The documents with hits ship the text of the second kind to a shard by anchor, where
   all texts that could share a window meet; the shard settles them.

Large groups.  Anchors with more than 1 / ANCHORS of all stretches, by a sample of documents, are
at most ANCHORS; their stretches aren't shuffled by anchor but counted by (anchor, whole) on
the map side first, and the counts go back by `beside`.  The sample decides only which of
the two ways an anchor takes, never a result.  Where an anchor has `hot` or more different stretches that
share sides, whose texts would fill a shard alone, these are shipped window by window: windows are counted on the map side
under their 128-bit hash, and the least document goes back by `beside`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import beside, laid_out, materialise, only, partitions

#: What a hit says: the stretch goes; its text is shipped as a whole; it is shipped window by window.
REMOVE, SHIP, WINDOWS = 1, 2, 4
CODES = 7
#: Kinds of shipped rows.
RANGE_ROW, PIECE_ROW, WINDOW_ROW = 0, 1, 2
#: Documents of the sample that looks for frequent anchors, how many such anchors there can be, and the stretches that one must have.
SAMPLE_DOCS, ANCHORS, ANCHOR_LEAST = 10_000, 20_000, 1000
#: Rows of one anchor that a task holds.
LONG = 200_000
#: Text that a shard's task settles at a time.
SHARD_BYTES = 1 << 20
#: Different stretches of an anchor, of about 100 bytes each, that fill it.
HOT = SHARD_BYTES // 100
RANGE = 1 << 21
_MASK = np.uint64((1 << 22) - 1)
#: Bits of a side's hash: it only saves texts from being shipped, so that a chance equality costs a little and changes nothing.
SIDE = 20
_SHORT = np.uint64(64 - SIDE)
_SIDE_MASK = (1 << SIDE) - 1
_STEP = np.uint64(0x9FB21C651E98DF25)
_WIDE = 1 << 40


class Scheme(NamedTuple):
    window: int
    gram: int
    words: bool
    #: Whether only an occurrence in a document with a smaller id counts.
    smaller: bool
    hot: int = HOT
    anchor_least: int = ANCHOR_LEAST
    long: int = LONG


class Symbols:
    """The symbols of a chunk: bytes or words; bounds has the first symbol of each row."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, scheme: Scheme):
        if scheme.words:
            w = K.Words(buf, offs)
            self.hash, self.bounds, self.start, self.end = w.hash, w.first, w.start, w.end
        else:
            self.hash, self.bounds, self.start, self.end = K._BYTE[buf], offs, None, None


class Stretches(NamedTuple):
    row: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    whole: np.ndarray
    sides: np.ndarray


def stretches(hashes: np.ndarray, bounds: np.ndarray, scheme: Scheme) -> Stretches:
    """The stretches of each row: first window (counted from the row's start), number of windows, and the hashes
    of the anchor, of the whole and of its two sides (SIDE bits each; 0 where a side is too short)."""
    k, q, found = scheme.window, scheme.gram, []
    half = (k - q) // 2
    rows = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    last = np.repeat(bounds[1:] - k, np.diff(bounds))
    for a in range(0, max(1, len(hashes) - k + 1), RANGE):
        part = hashes[a : a + RANGE + k - 1]
        n = len(part)
        if n < k:
            break
        prefix = K.Prefix(part)
        grams = prefix.grams(q)
        least = K.sliding_min((grams & ~_MASK) | np.arange(len(grams), dtype=np.uint64), k - q + 1)
        row = rows[a : a + n - k + 1]
        at = np.flatnonzero(last[a : a + n - k + 1] >= np.arange(a, a + n - k + 1))
        if not len(at):
            continue
        anchor = (least[at] & _MASK).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(at)))
        s, p = at[first], anchor[first]
        whole = prefix.ranges(s, s + count + k - 1) ^ K.mix((p - s + 1).astype(np.uint64))
        left = np.where(p - s >= half, (prefix.ranges(np.maximum(p - half, 0), p + q) >> _SHORT) | np.uint64(1), np.uint64(0))
        far = np.minimum(p + q + half, n)
        right = np.where(s + count - 1 + k - p - q >= half, ((prefix.ranges(p, far) >> _SHORT) & ~np.uint64(1)) | np.uint64(2), np.uint64(0))
        found.append(Stretches(row[s], s + a - bounds[row[s]], count, grams[p], whole, (left << np.uint64(SIDE)) | right))
    if not found:
        empty = np.zeros(0, np.int64)
        return Stretches(empty, empty, empty, *[empty.astype(np.uint64)] * 3)
    return Stretches(*[np.concatenate(x) for x in zip(*found, strict=True)]) if len(found) > 1 else found[0]


def named(anchor: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """What a document knows its stretch by; the lowest bits are free for codes."""
    return K.mix(anchor ^ K.mix(whole)) & ~np.uint64(CODES)


INDEX = "anchor long, whole long, sides long, name long, doc_id long"


def _index(scheme: Scheme, frequent: np.ndarray, wanted: bool) -> Callable:
    """The stretches whose anchor is (or isn't) one of the sorted anchors `frequent`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            for lo, hi, buf, offs in K.chunks(b.column("text")):
                sym = Symbols(buf, offs, scheme)
                s = stretches(sym.hash, sym.bounds, scheme)
                anchor = s.anchor.view(np.int64)
                keep = slice(None)
                if len(frequent):
                    keep = (frequent[np.minimum(np.searchsorted(frequent, anchor), len(frequent) - 1)] == anchor) == wanted
                cols = [anchor[keep], s.whole[keep].view(np.int64), s.sides[keep].view(np.int64)]
                if wanted:
                    cols.append(named(s.anchor[keep], s.whole[keep]).view(np.int64))
                cols.append(ids[lo:hi][s.row[keep]].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["anchor", "whole", "sides"] + ["name"] * wanted + ["doc_id"])

    return run


def _sharing(anchor: np.ndarray, side: np.ndarray, doc: np.ndarray, smaller: bool) -> np.ndarray:
    """Which of different stretches share (anchor, side) with another, in another document if that is what counts."""
    out = np.zeros(len(side), bool)
    at = np.flatnonzero(side)
    key = K.mix(anchor[at] ^ (side[at] * _STEP))
    order = np.argsort(key)
    k = key[order]
    if not len(k):
        return out
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    size = np.diff(np.append(first, len(k)))
    good = size > 1
    if smaller:
        d = doc[at][order]
        good &= np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
    out[at[order]] = np.repeat(good, size)
    return out


def hits_of(rows: list[np.ndarray], scheme: Scheme, cut: int | None) -> pa.RecordBatch:
    """Hits of whole groups of (anchor, whole, sides, doc_id), in that order; a group whose anchor is `cut` is only part of one."""
    anchor, whole, sides, doc = rows
    n = len(doc)
    new_w = np.append(True, (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1]))
    at = np.flatnonzero(new_w)
    size = np.diff(np.append(at, n))
    lead = doc == np.repeat(doc[at], size)
    gone = ~lead if scheme.smaller else np.repeat(size > 1, size)
    # different stretches: only those whose anchor has more than one
    wa, ws, wd = anchor[at].view(np.uint64), sides[at].view(np.uint64), doc[at]
    group = np.flatnonzero(np.append(True, wa[1:] != wa[:-1]))
    kinds = np.repeat(np.diff(np.append(group, len(wa))), np.diff(np.append(group, len(wa))))
    ship = np.zeros(len(at), np.int64)
    some = np.flatnonzero(kinds > 1)
    a, s, d = wa[some], ws[some], wd[some]
    meets = _sharing(a, s >> np.uint64(SIDE), d, scheme.smaller) | _sharing(a, s & np.uint64(_SIDE_MASK), d, scheme.smaller)
    ship[some[meets]] = np.where(kinds[some[meets]] >= scheme.hot, WINDOWS, SHIP)
    if cut is not None:
        ship[anchor[at] == cut] = WINDOWS
    code = gone * REMOVE + lead * np.repeat(ship, size)
    once = np.append(True, doc[1:] != doc[:-1]) | new_w
    keep = np.flatnonzero((code > 0) & once)
    hit = named(anchor[keep].view(np.uint64), whole[keep].view(np.uint64)) | code[keep].astype(np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(hit.view(np.int64))], names=["doc_id", "hit"])


def _decide(scheme: Scheme) -> Callable:
    """Step 3: rows sorted by anchor, whole and document become hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        cut: int | None = None
        for b in batches:
            rows = [b.column(c).to_numpy() for c in ("anchor", "whole", "sides", "doc_id")]
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            if not len(rows[0]):
                continue
            stop = int(np.searchsorted(rows[0], rows[0][-1]))
            if not stop and len(rows[0]) > scheme.long:
                # one anchor: its last whole stays, and of that not more than two rows are needed
                stop, cut = int(np.searchsorted(rows[1], rows[1][-1])), int(rows[0][0])
                if not stop:
                    yield hits_of(rows, scheme, cut)
                    held = [x[:2] for x in rows]
                    continue
            if stop:
                yield hits_of([x[:stop] for x in rows], scheme, cut)
            held = [x[stop:] for x in rows]
        if held is not None and len(held[0]):
            yield hits_of(held, scheme, cut)

    return run


def _frequent_hits(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """Hits among the stretches of frequent anchors, by counts that are made on the map side first."""
    s = materialise(rows, "frequent")
    left, right = F.shiftrightunsigned("sides", SIDE), F.col("sides").bitwiseAND(F.lit(_SIDE_MASK))
    wholes = materialise(s.groupBy("anchor", "whole", "sides").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")), "wholes")
    sides = wholes.select("anchor", "whole", "least", F.explode(F.array(left, right)).alias("side")).where("side <> 0")
    met = sides.groupBy("anchor", "side").agg(F.count("*").alias("met"), F.min("least").alias("low"), F.max("least").alias("high")).where("met > 1 and low < high" if scheme.smaller else "met > 1")
    shipped = beside(sides, materialise(met.select("anchor", "side", "met"), "sides"), ["anchor", "side"], "met").select("anchor", "whole").distinct()
    shipped = materialise(shipped, "shipping")
    kinds = shipped.groupBy("anchor").agg(F.when(F.count("*") >= scheme.hot, WINDOWS).otherwise(SHIP).alias("ships"))  # ANCHORS rows at most
    shipped = shipped.join(F.broadcast(kinds), "anchor")
    known = wholes.join(shipped, ["anchor", "whole"], "left").where("n > 1 or ships > 0").select("anchor", "whole", "least", "n", F.coalesce("ships", F.lit(0)).alias("ships"))
    found = beside(s.select("anchor", "whole", "name", "doc_id"), materialise(known, "known"), ["anchor", "whole"], "n")
    lead = F.col("doc_id") == F.col("least")
    gone = ~lead if scheme.smaller else F.col("n") > 1
    code = F.when(gone, REMOVE).otherwise(0) + F.when(lead, F.col("ships")).otherwise(0)
    return found.select("doc_id", F.col("name").bitwiseOR(code.cast("long")).alias("hit"), code.alias("code")).where("code > 0").select("doc_id", "hit").distinct()


SHIPPED = "kind int, key long, key2 long, doc_id long, row long, start long, n long, piece binary"


def _ship(scheme: Scheme) -> Callable:
    """Step 4, for documents with hits: ranges that are settled, and texts and windows for the shards."""
    k = scheme.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = (b.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "row"))
            hits = b.column("hits")
            for lo, hi, buf, offs in K.chunks(b.column("text")):
                sym = Symbols(buf, offs, scheme)
                s = stretches(sym.hash, sym.bounds, scheme)
                part = hits.slice(lo, hi - lo)
                word = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                of = np.repeat(np.arange(hi - lo), np.diff(part.offsets.to_numpy()))
                code = code_of(s, of, word)
                doc, row = ids[lo:hi], keys[lo:hi]
                yield from shipped(ranges_of(s, (code & REMOVE) > 0, doc, row, k))
                whole = np.flatnonzero(code & SHIP)
                if len(whole):
                    first, size = s.start[whole] + sym.bounds[s.row[whole]], s.windows[whole]
                    texts = [text_of(buf, sym, f, n + k - 1) for f, n in zip(first.tolist(), size.tolist(), strict=True)]
                    yield from shipped((PIECE_ROW, s.anchor[whole].view(np.int64), None, doc[s.row[whole]], row[s.row[whole]], s.start[whole], size, texts))
                each = np.flatnonzero(code & WINDOWS)
                if len(each):
                    at = K.ranges(s.start[each] + sym.bounds[s.row[each]], s.windows[each])
                    r = np.repeat(s.row[each], s.windows[each])
                    one, two = (K.Prefix(x).grams(k)[at].view(np.int64) for x in (sym.hash, K.mix(sym.hash)))
                    yield from shipped((WINDOW_ROW, one, two, doc[r], row[r], at - sym.bounds[r], np.ones(len(at), np.int64), None))

    return run


def code_of(s: Stretches, of: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """The codes of each stretch; hits belong to the rows `of`."""
    own = (named(s.anchor, s.whole) >> np.uint64(3)) ^ K.mix(s.row.astype(np.uint64) + np.uint64(1))
    theirs = (hits >> np.uint64(3)) ^ K.mix(of.astype(np.uint64) + np.uint64(1))
    out = np.zeros(len(own), np.int64)
    if not len(theirs):
        return out
    order = np.argsort(theirs)
    theirs = theirs[order]
    first = np.flatnonzero(np.append(True, theirs[1:] != theirs[:-1]))
    codes = np.bitwise_or.reduceat((hits[order] & np.uint64(CODES)).astype(np.int64), first)
    theirs = theirs[first]
    at = np.minimum(np.searchsorted(theirs, own), len(theirs) - 1)
    return np.where(theirs[at] == own, codes[at], out)


def text_of(buf: np.ndarray, sym: Symbols, first: int, n: int) -> bytes:
    if sym.start is None:
        return buf[first : first + n].tobytes()
    return b" ".join(buf[sym.start[first] : sym.end[first + n - 1]].tobytes().split())


def ranges_of(s: Stretches, mask: np.ndarray, doc: np.ndarray, row: np.ndarray, k: int) -> tuple:
    """What the stretches of the mask cover, as ranges."""
    r, start = s.row[mask], s.start[mask]
    if not len(r):
        return RANGE_ROW, r, None, r, r, r, r, None
    begin, end = start + r * _WIDE, np.maximum.accumulate(start + s.windows[mask] + k - 1 + r * _WIDE)
    new = np.append(True, begin[1:] > end[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(r) - 1)
    r, start = r[new], start[new]
    return RANGE_ROW, start, None, doc[r], row[r], start, end[last] - r * _WIDE - start, None


def shipped(cols: tuple, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    kind, key, key2, *rest = cols
    for a in range(0, len(key), size):
        part = [pa.array(np.full(len(key[a : a + size]), kind, np.int32)), *[pa.nulls(len(key[a : a + size]), pa.int64()) if c is None else pa.array(c[a : a + size], pa.int64()) for c in (key, key2, *rest[:-1])]]
        piece = pa.nulls(len(part[0]), pa.binary()) if rest[-1] is None else pa.array(rest[-1][a : a + size], pa.binary())
        yield pa.RecordBatch.from_arrays([*part, piece], names=["kind", "key", "key2", "doc_id", "row", "start", "n", "piece"])


def merged(starts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """The union of ranges, as ranges."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate((starts + lengths)[order])
    new = np.append(True, s[1:] > e[:-1])
    last = np.append(np.flatnonzero(new)[1:] - 1, len(s) - 1)
    return list(zip(s[new].tolist(), e[last].tolist(), strict=True))


#: Takes (anchor keys, documents, starts, windows, pieces) whose keys are complete; returns a mask per piece of the windows to remove.
Settle = Callable[[list, list, list, list, list], list[np.ndarray]]
RANGES = "doc_id long, row long, start long, end long"


def _settle(scheme: Scheme, settle: Settle) -> Callable:
    """A shard: pieces sorted by anchor."""
    k = scheme.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            out: list[tuple[int, int, int, int]] = []
            key, doc, row, start, n, piece = map(list, zip(*held, strict=True))
            for i, mask in enumerate(settle(key, doc, start, n, piece)):
                at = np.flatnonzero(mask)
                if len(at):
                    out.extend((doc[i], row[i], start[i] + s, start[i] + e) for s, e in merged(at, np.full(len(at), k)))
            held, size = [], 0
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "row", "start", "end"])

        for b in batches:
            for x in zip(*(b.column(c).to_pylist() for c in ("key", "doc_id", "row", "start", "n", "piece")), strict=True):
                if size >= SHARD_BYTES and x[0] != held[-1][0]:
                    yield flush()
                held.append(x)
                size += len(x[-1])
        if held:
            yield flush()

    return run


def _frequent(fresh: DataFrame, scheme: Scheme) -> np.ndarray:
    """The anchors, ANCHORS at most, that a sample of documents shows to be frequent."""
    share = min(1.0, SAMPLE_DOCS / max(1, fresh.count()))
    some = fresh.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < int(share * 1_000_000))
    counts = materialise(some.mapInArrow(_index(scheme, np.zeros(0, np.int64), True), INDEX).groupBy("anchor").agg(F.count("*").alias("n")), "anchors")
    least = max(scheme.anchor_least * share, (counts.agg(F.sum("n")).first()[0] or 0) / ANCHORS)
    return np.sort(np.array([r["anchor"] for r in counts.where(F.col("n") > least).select("anchor").collect()], np.int64))


def _windows(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """Ranges of shipped windows that occur elsewhere."""
    counts = rows.groupBy("key", "key2").agg(F.count("*").alias("met"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    counts = counts.where("least < most" if scheme.smaller else "met > 1").select("key", "key2", "met", "least")
    found = beside(rows.select("key", "key2", "doc_id", "row", "start"), materialise(counts, "windows"), ["key", "key2"], "met")
    return (found.where("doc_id > least") if scheme.smaller else found).select("doc_id", "row", "start", (F.col("start") + scheme.window).alias("end"))


def _copies(home: DataFrame) -> DataFrame:
    """doc_id, row, least of the texts that occur more than once."""
    prints = materialise(home.select("doc_id", "row", F.unhex(F.sha2("text", 256)).alias("digest")), "prints")
    groups = prints.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    return materialise(beside(prints, materialise(groups, "equal"), ["digest"], "n").select("doc_id", "row", "least"), "copies")


def removed(docs: DataFrame, scheme: Scheme, settle: Settle) -> DataFrame:
    """docs (doc_id, text) with row, a hash of the text that parts rows of one id, and `ranges`, an array of (row, start, end) in symbols, null where nothing goes."""
    n = partitions(docs.sparkSession)
    d = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    home = laid_out(d.withColumn("row", F.xxhash64("text")), "doc_id", "texts")
    copies = _copies(home)
    by_doc = copies.groupBy("doc_id").agg(F.collect_set(F.struct("row", "least")).alias("equal"))
    later: Column = F.exists("equal", lambda c: (c["row"] == F.col("row")) & (c["least"] < F.col("doc_id")))
    fresh = home.join(by_doc, "doc_id", "left").where(~F.coalesce(later, F.lit(False))).select("doc_id", "text")
    frequent = _frequent(fresh, scheme)
    hits = (
        fresh.mapInArrow(_index(scheme, frequent, False), INDEX.replace("name long, ", "")).repartition(n, "anchor").sortWithinPartitions("anchor", "whole", "doc_id")
        .mapInArrow(_decide(scheme), "doc_id long, hit long")
    )
    if len(frequent):
        hits = hits.unionByName(_frequent_hits(fresh.mapInArrow(_index(scheme, frequent, True), INDEX), scheme))
    replies = hits.groupBy("doc_id").agg(F.collect_list("hit").alias("hits"))
    sent = materialise(home.join(replies, "doc_id").select("doc_id", "row", "text", "hits").mapInArrow(_ship(scheme), SHIPPED), "shipped")
    pieces = sent.where(F.col("kind") == PIECE_ROW).select("key", "doc_id", "row", "start", "n", "piece")
    whole = copies.where("doc_id > least") if scheme.smaller else copies
    ranges = (
        sent.where(F.col("kind") == RANGE_ROW).select("doc_id", "row", "start", (F.col("start") + F.col("n")).alias("end"))
        .unionByName(pieces.repartition(n, "key").sortWithinPartitions("key", "doc_id", "start").mapInArrow(_settle(scheme, settle), RANGES))
        .unionByName(_windows(sent.where(F.col("kind") == WINDOW_ROW), scheme))
        .unionByName(whole.select("doc_id", "row", F.lit(0).cast("long").alias("start"), F.lit(_WIDE).cast("long").alias("end")))
    )
    settled = ranges.groupBy("doc_id").agg(F.collect_list(F.struct("row", "start", "end")).alias("ranges"))
    return home.join(settled, "doc_id", "left").select("doc_id", "row", "text", "ranges")


def gone(n: int, row: int, found: pa.Scalar, window: int) -> np.ndarray | None:
    """A mask of the n symbols that go, or None; found has the ranges of the document's rows."""
    if n < window or not found.is_valid:
        return None
    whose, start, end = (x.to_numpy() for x in found.values.flatten())
    mine = whose == row
    start, end = np.minimum(start[mine], n), np.minimum(end[mine], n)
    return K.covered(n, start, end - start)
