"""Ranked lexical search by variable-block-max WAND (operator 12).

A term is a run of letters, digits and characters beyond ASCII; only A to Z are lower-cased.  What a
term adds to a document is its weight w times its impact (1000000000 tf) div (1000 tf + 20 m),
where m follows the document's length; all of it is integer arithmetic.

1. One pass counts documents and terms (collection).
2. A task cuts its documents into shards of about SHARD_BYTES and writes, for each term of a shard, the
   documents (numbered by ascending id) with their impacts, cut into blocks.  Dynamic programming
   chooses the blocks: it minimises the sum of what the blocks' maxima overstate
   and BLOCK_COST a block, over all cuts into blocks of at most MAX_BLOCK.  The index holds all terms of all documents.
3. The lists of the queries' terms meet by shard and block of queries.  There, the maxima of the blocks that
   lie over a document bound its score.  As in WAND, what doesn't reach the score of
   the k-th best so far is skipped: windows of documents are taken from the highest bound on, only blocks that lie over a
   taken window are read, and the search ends when no bound reaches the threshold.  It is exact.
4. The best k of each shard are ranked together.

Shards are bounded, whatever a source or a term holds, and no list of all documents meets in one task.  Inside a
shard terms are told apart by 64-bit hashes (two of a million terms agree with probability 3e-8), between shards by
themselves.

Defined results: null, empty and blank texts have no term and are never found; an item without a term has no rows; items that
share an id are one item with the terms of all; rows that share a document id are documents of their
own; rows without an id go; equal scores go by ascending id; with an empty table on either side the result is
empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import BROADCAST_BYTES, materialise, only, partitions, table

TOP = 50
#: Bytes of text of a shard, items of a block of queries.
SHARD_BYTES, QUERY_ITEMS = 16 << 20, 128
#: Documents of a block at most, and what a block costs beside its error in impacts.
MAX_BLOCK, BLOCK_COST = 64, 3_000_000
#: Fixed values of the score: the scale of impacts and of weights, the saturation of tf (x 1000), per cent of the length's part.
IMPACT, WEIGHT, SATURATION, LENGTH_PART = 1_000_000_000, 1000, 20, 50
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LISTS = ("docs", "impacts", "block_ends", "block_max")
_INDEX = "shard long, term string, n int, docs array<int>, impacts array<int>, block_ends array<int>, block_max array<int>, ids array<long>"


def _words(column: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, K.Words]]:
    for lo, hi, buf, offs in K.chunks(column, size):
        yield lo, hi, buf, K.Words(buf, offs, K.PUNCT, K.FOLD)


def collection(docs: DataFrame) -> tuple[int, int]:
    """(documents with a term, terms with repeats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = terms = 0
        for b in batches:
            for _, _, buf, offs in K.chunks(b.column("text")):
                inside = ~K.PUNCT[buf]
                begins = inside.copy()
                begins[1:] &= ~inside[:-1]
                first = offs[:-1][offs[:-1] < offs[1:]]
                begins[first] = inside[first]
                lengths = K.per_row(begins, offs)
                n, terms = n + int((lengths > 0).sum()), terms + int(lengths.sum())
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([terms])], names=["n", "terms"])

    row = only(docs, "doc_id", "text").mapInArrow(run, "n long, terms long").agg(F.sum("n").alias("n"), F.sum("terms").alias("terms")).first()
    return row["n"] or 0, row["terms"] or 0


def blocks(impacts: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int = MAX_BLOCK, cost: int = BLOCK_COST) -> np.ndarray:
    """Where blocks begin (a mask): for each list the cut with the least sum of len * max - sum and `cost` a block."""
    begins = np.zeros(len(impacts), bool)
    begins[starts[sizes == 1]] = True
    for low, high in ((1, 8), (8, 64), (64, np.inf)):  # lists of similar length need tables of similar width
        own = (sizes > low) & (sizes <= high)
        if own.any():
            _cut(begins, impacts, starts[own], sizes[own], most, cost)
    return begins


def _cut(begins: np.ndarray, impacts: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int, cost: int) -> None:
    """Marks the cuts of lists that advance together, the longest first."""
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    longest = int(sizes[0])
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, longest + 1), "left")
    base = np.cumsum(sizes) - sizes
    choice = np.ones(int(sizes.sum()), np.int32)
    # by list and slot: the best cost up to where an open block begins, and the highest impact since
    width = min(most, longest)
    before, high = np.zeros((len(sizes), width), np.int64), np.zeros((len(sizes), width), np.int64)
    total = np.zeros(len(sizes), np.int64)
    slots = np.arange(width)
    for i, n in enumerate(active.tolist()):
        own, slot, at = impacts[starts[:n] + i], i % width, min(i + 1, width)
        before[:n, slot], high[:n, slot] = total[:n], 0
        h = high[:n, :at]
        np.maximum(h, own[:, None], out=h)
        length = (i - slots[:at]) % width + 1
        sums = before[:n, :at] + h * length
        best = sums.argmin(axis=1)
        total[:n] = sums[np.arange(n), best] + cost
        choice[base[:n] + i] = length[best]
    at = sizes.copy()
    while len(at):
        at = at - choice[base + at - 1]
        begins[starts + at] = True
        starts, base, at = starts[at > 0], base[at > 0], at[at > 0]


class _Shard:
    """The documents of one shard, as they come."""

    def __init__(self):
        self.ids, self.size, self.names = [], 0, {}
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, ids: list[int], buf: np.ndarray, words: K.Words) -> None:
        order = np.lexsort((words.text, words.hash))
        h, t = words.hash[order], words.text[order]
        new = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1])) if len(h) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        self.parts.append((h[at], (t[at] + len(self.ids)).astype(np.int32), np.diff(np.append(at, len(h))).astype(np.int32), words.counts()))
        terms = at[np.append(True, h[at][1:] != h[at][:-1])] if len(at) else at
        for key, a, z in zip(h[terms].tolist(), words.start[order[terms]].tolist(), words.end[order[terms]].tolist(), strict=True):
            if key not in self.names:
                self.names[key] = K.FOLD[buf[a:z]].tobytes()
        self.ids += ids
        self.size += len(buf)

    def rows(self, shard: int, n_docs: int, n_terms: int) -> pa.RecordBatch:
        ids = np.array(self.ids, np.int64)
        by_id = np.argsort(ids, kind="stable")
        number = np.empty(len(ids), np.int64)
        number[by_id] = np.arange(len(ids))
        h, doc, tf, lengths = (np.concatenate([p[k] for p in self.parts]) for k in range(4))
        self.parts.clear()
        m = 100 - LENGTH_PART + LENGTH_PART * lengths * n_docs // max(1, n_terms)
        impacts = IMPACT * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + SATURATION * m[doc])
        order = np.lexsort((number[doc], h))
        h, doc, impacts = h[order], number[doc[order]], impacts[order]
        starts = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
        bounds = np.append(starts, len(h))
        begins = np.flatnonzero(blocks(impacts, starts, np.diff(bounds)))
        ends = np.append(begins[1:], len(h)) if len(h) else begins
        first_block = np.searchsorted(begins, bounds)
        owner = np.searchsorted(starts, begins, "right") - 1
        highest = np.maximum.reduceat(impacts, begins) if len(h) else impacts

        def lists(values, offsets):  # and the directory of ids as the last row, which has no list
            return pa.ListArray.from_arrays(pa.array(np.append(offsets, offsets[-1]), pa.int32()), pa.array(values, pa.int32()))

        terms = [self.names[k] for k in h[starts].tolist()]
        nothing = pa.nulls(len(terms), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(terms) + 1, shard)), pa.array([*terms, b""], pa.binary()).cast(pa.string()), pa.array(np.append(np.diff(bounds), 0), pa.int32()),
                lists(doc, bounds), lists(impacts, bounds), lists(ends - starts[owner] if len(h) else ends, first_block), lists(highest, first_block),
                pa.concat_arrays([nothing, pa.array([ids[by_id]], pa.list_(pa.int64()))]),
            ],
            names=["shard", "term", "n", *_LISTS, "ids"],
        )


def index(docs: DataFrame, n_docs: int, n_terms: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row a shard and term: n, docs (numbers in the shard), impacts, block_ends (places in the list), block_max; and a row a shard whose term is empty, with the ids by number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard = TaskContext.get().partitionId(), _Shard()
        numbers = count(part << 24)
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for lo, hi, buf, words in _words(b.column("text"), min(K.CHUNK_BYTES, shard_bytes)):
                shard.add(ids[lo:hi], buf, words)
                if shard.size >= shard_bytes:
                    yield shard.rows(next(numbers), n_docs, n_terms)
                    shard = _Shard()
        if shard.ids:
            yield shard.rows(next(numbers), n_docs, n_terms)

    d = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(run, _INDEX)


def terms_of(items: DataFrame) -> DataFrame:
    """item_id, term: each term of an item once."""
    text = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    found = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("terms"))
    return found.select("item_id", F.explode("terms").alias("term")).distinct()


def best(docs: np.ndarray, impacts: np.ndarray, first: np.ndarray, end: np.ndarray, bound: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, scores) of the k best of a shard: blocks of postings from `first` to `end` add `weight` times their impacts and at most `bound`.

    Equal scores go by number.
    """
    low, high = docs[first], docs[end - 1] + 1
    steps = np.bincount(low, bound, n_docs + 1) - np.bincount(high, bound, n_docs + 1)  # whole numbers below 2^53
    most = np.cumsum(steps)[:n_docs]
    left = np.argsort(-most, kind="stable")
    left = left[: np.searchsorted(-most[left], 0, "left")]  # what no block lies over has no score
    top, scores, take = np.zeros(0, np.int64), np.zeros(0), 2 * k
    while len(left):
        if len(top) == k:
            left = left[: np.searchsorted(-most[left], -scores[-1], "right")]
        chosen = left[:take]
        left, take = left[take:], take * 4
        marked = np.zeros(n_docs + 1, np.int64)
        marked[chosen + 1] = 1
        marked = np.cumsum(marked)
        read = np.flatnonzero(marked[high] > marked[low])
        length = end[read] - first[read]
        at = K.ranges(first[read], length)
        got = np.bincount(docs[at], impacts[at] * np.repeat(weight[read], length), n_docs)[chosen]
        top, scores = np.append(top, chosen[got > 0]), np.append(scores, got[got > 0])
        order = np.lexsort((top, -scores))[:k]
        top, scores = top[order], scores[order]
    return top, scores.astype(np.int64)


def _search(k: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        is_ids = np.array([x.as_py() == "" for x in group["term"]])
        ids = np.asarray(group["ids"].filter(pa.array(is_ids)).combine_chunks().flatten())
        group = group.filter(pa.array(~is_ids))
        flat = {c: np.asarray(pa.chunked_array(group[c].chunks, group[c].type).combine_chunks().flatten()).astype(np.int64) for c in _LISTS}
        n, n_blocks = np.asarray(group["n"]).astype(np.int64), np.asarray(group["block_max"].combine_chunks().value_lengths()).astype(np.int64)
        start = np.cumsum(n) - n
        end = flat["block_ends"] + np.repeat(start, n_blocks)
        first = np.append(0, end[:-1]) if len(end) else end
        weight = np.asarray(group["w"]).astype(np.int64)
        by_block = np.repeat(weight, n_blocks)
        bound = flat["block_max"] * by_block
        block_start = np.cumsum(n_blocks) - n_blocks
        items = group["items"].combine_chunks()
        owner, item = np.repeat(np.arange(len(group)), np.asarray(items.value_lengths())), np.asarray(items.flatten())
        order = np.argsort(item, kind="stable")
        owner, item = owner[order], item[order]
        names, at = np.unique(item, return_index=True)
        out: list[list[np.ndarray]] = [[], [], []]
        for name, own in zip(names.tolist(), np.split(owner, at)[1:], strict=True):
            b = K.ranges(block_start[own], n_blocks[own])
            docs, scores = best(flat["docs"], flat["impacts"], first[b], end[b], bound[b], by_block[b], len(ids), k)
            for column, x in zip(out, (np.full(len(docs), name), ids[docs], scores), strict=True):
                column.append(x)
        return pa.table({c: pa.array(np.concatenate(x) if x else [], pa.int64()) for c, x in zip(("item_id", "doc_id", "score"), out, strict=True)})

    return run


def search(lists: DataFrame, items: DataFrame, n_docs: int, k: int = TOP, query_items: int = QUERY_ITEMS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item.  `lists` is a written index of n_docs documents with a term, `items` has item_id and text."""
    spark = items.sparkSession
    terms = materialise(terms_of(items), "terms")
    n_items, n_rows, size = terms.agg(F.count_distinct("item_id"), F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term") + 24), F.lit(0))).first()
    small = (lambda df: F.broadcast(df)) if size <= BROADCAST_BYTES else (lambda df: df)
    df = lists.select("term", "n").join(small(terms.select("term").distinct()), "term").groupBy("term").agg(F.sum("n").alias("df"))
    weights = materialise(df.select("term", F.floor(WEIGHT * F.log((2.0 * n_docs + 2.0) / (2.0 * F.col("df") + 1.0))).cast("long").alias("w")), "weights")
    n_blocks = max(1, -(-n_items // query_items))
    queries = materialise(terms.join(weights, "term").withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)).cast("int")).groupBy("block", "term", "w").agg(F.collect_list("item_id").alias("items")), "queries")
    own = lists.where("term <> ''").join(small(queries), "term")
    directory = lists.where("term = ''").withColumns({"block": F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))), "w": F.lit(0).cast("long"), "items": F.array().cast("array<long>")})
    columns = ["shard", "block", "term", "n", *_LISTS, "ids", "w", "items"]
    # lists are small beside the work on them, so that what is coalesced by bytes would meet in few tasks
    met = own.select(*columns).unionByName(directory.select(*columns)).repartition(partitions(spark), "shard", "block")
    found = met.groupBy("shard", "block").applyInArrow(_search(k), "item_id long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """Index and search in one."""
    n_docs, n_terms = collection(docs)
    return search(materialise(index(docs, n_docs, n_terms), "lists"), items, n_docs, k)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op12_lexical_search": op12_lexical_search}
ORACLE = {
    "op12_lexical_search": rf"""
with occurrences as (
  select doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) as term from documents where doc_id is not null
), tf as (select doc_id, term, count(*) as tf from occurrences group by all),
sizes as (select doc_id, sum(tf)::bigint as n from tf group by all),
whole as (select count(*) as docs, sum(n)::bigint as terms from sizes),
df as (select term, count(*) as df from tf group by all),
weights as (select term, cast(floor({WEIGHT} * ln((2 * docs + 2) / (2 * df + 1))) as bigint) as w from df, whole),
norms as (select doc_id, {100 - LENGTH_PART} + (({LENGTH_PART} * n * docs) // terms) as m from sizes, whole),
wanted as (select distinct item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) as term from benchmark where item_id is not null),
scored as (
  select item_id, doc_id, sum(w * (({IMPACT} * tf) // (1000 * tf + {SATURATION} * m)))::bigint as score
  from wanted join weights using (term) join tf using (term) join norms using (doc_id) group by all
)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
from scored where score > 0 qualify rank <= {TOP}"""
}
