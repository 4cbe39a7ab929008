"""Packing of documents into sequences of at most 2,048 tokens (operator 6).

A document is its token ids and the end id 1.  It is cut at multiples of the
sequence length; what is left over at its end is packed by first-fit decreasing.
Groups of documents are drawn by a hash of the id, so that each holds about
GROUP_DOCS documents however the table is ordered, and each group is packed on
its own: a tournament tree over the bins' free space finds the first bin that
fits in a logarithm of the number of bins.

Token ids never leave the map task: only piece lengths and checksums are shuffled.

Defined results: a null or empty text is the end id alone; repeated ids are packed
as separate documents; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, table

LENGTH = 2048
END_ID = 1
GROUP_DOCS = 4096


def default_vocabulary() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(2)
def encoder(path: str):
    """Text to ids by the ranks at path and the added tokens of the .json form beside it, whose ids these are: an added token is one id wherever its string occurs."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    form, added = path.removesuffix(".tiktoken") + ".json", []
    if os.path.exists(form):
        with open(form, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
    if any(t[rule] for t in added for rule in ("single_word", "lstrip", "rstrip", "normalized")):
        raise ValueError(f"added tokens of {form} aren't plain strings")
    encoding = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in added})
    return partial(encoding.encode, allowed_special="all")


def pieces(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids): the documents cut at multiples of length."""
    path = vocabulary or default_vocabulary()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
        for b in batches:
            rows: list[list] = [[] for _ in names]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END_ID], "<u4")
                for at in range(0, len(ids), length):
                    part = ids[at : at + length]
                    for column, value in zip(rows, (doc, at, len(part), zlib.crc32(part.tobytes()), len(ids), part.astype(np.int64)), strict=False):
                        column.append(value)
                if len(rows[0]) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64()) if n == "ids" else pa.int64()) for n, c in zip(names, rows, strict=True)], names=names)
                    rows = [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int64()) if n == "ids" else pa.int64()) for n, c in zip(names, rows, strict=True)], names=names)

    d = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return d.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length.  tree[1] has the most free space of all bins, the leaves that of each bin, in the order in which bins open."""
    order = np.argsort(-lengths, kind="stable")
    size = 1 << max(0, int(len(lengths) - 1).bit_length())
    tree = [capacity] * (2 * size)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, need in zip(order.tolist(), lengths[order].tolist(), strict=True):
        node = 1
        while node < size:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[i], offsets[i] = node - size, capacity - tree[node]
        tree[node] -= need
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return bins, offsets


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, group_docs: int = GROUP_DOCS, with_ids: bool = False) -> DataFrame:
    """The pieces of docs with sequence_id and offset."""
    groups = max(1, -(-docs.count() // group_docs))
    cut = pieces(docs, length, vocabulary, with_ids).withColumn("group", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(groups)))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), length)
        return pdf.assign(sequence_id=(pdf["group"].to_numpy() << 32) + bins, offset=offsets).drop(columns="group")

    return cut.groupBy("group").applyInPandas(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * with_ids + ", sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op6_packing": op6_packing}
ORACLE: dict[str, str] = {}
