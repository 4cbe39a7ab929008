"""Near-duplicate documents by ProbMinHash (operator 9).

A document is the multiset of its five-word shingles.  Each shingle of weight w (its
count) starts a Poisson process of rate w whose arrivals hit registers at random;
a register keeps the shingle that reached it first, and a process ends once its time
has passed the document's last register, which most do after one arrival.  Two
documents agree in a register with their probability Jaccard similarity.

Texts of equal words (by a 128-bit digest) are folded to the one with the least id.
Registers are banded; the texts that share a band with another are laid out once by id, so
that later joins move only ids to them and then the texts of pairs.  Similarities are exact (sum of least over
sum of greatest counts, 0.8 or more).

1. Within a bucket each text is compared with the bucket's centre: the text that meets most
   others over all its bands, which among copies of one original is the original.
2. What that leaves open is any pair of a bucket's other texts whose classes so far
   differ, linked or not.  In a bucket of SMALL texts or fewer, each such pair is compared.
3. The texts of larger buckets with such a pair get a longer signature of STEEP bands, in
   which pairs well below 0.8 hardly meet.  Its buckets go through the same: small ones pair
   by pair; in larger ones blocks of BLOCK, 4 BLOCK, ... texts a round, of the smallest
   classes first, meet the texts of other classes, until the bucket holds one class or
   no text that hasn't been in a block.  A text is sent once for each block of a bucket and not once for
   each pair.  No bucket is capped, and only pairs whose classes are already equal go untested.

Connected components of the links are the classes.

A pair of similarity 0.8 shares one of the first bands with probability 0.9999 and a steep
one with 0.998; a pair of 0.5 shares a steep one with 0.02.

Defined results: null, empty and blank texts are equal texts; a text of one to four
words is one shingle; repeated rows are copies of each other; rows that share an id are one document, all of
whose texts count and whose rows get one class; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import beside as by_size
from .common import laid_out, materialise, only, partitions, sized, table
from .common import within as within_by_size

SHINGLE = 5
SIMILARITY = 0.8
#: (bands, registers of a band, seed) of the first and of the longer signature.
FIRST, STEEP = (24, 5, 1), (90, 12, 2)
#: Texts that one task compares with a block.
STAR = 256
#: Texts of a bucket whose pairs are compared one by one, and texts of a block.
SMALL, BLOCK = 16, 64
CHUNK = 1 << 21
#: A table of so many rows (of a few numbers each, 2 MB or less) is sent to every task instead of shuffling what it is joined with.
SENT = 20_000


def shingles(words: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count), sorted by text and shingle."""
    grams = K.Prefix(words.hash).grams(SHINGLE)
    whole = words.text[: len(grams)] == words.text[SHINGLE - 1 :] if len(grams) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    counts = words.counts()
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    prefix = K.Prefix(words.hash)
    text = np.concatenate((words.text[at], short))
    gram = np.concatenate((grams[at], prefix.ranges(words.first[short], words.first[short + 1])))
    order = np.lexsort((gram, text))
    text, gram = text[order], gram[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1])
    first = np.flatnonzero(new)
    return text[first], gram[first], np.diff(np.append(first, len(text)))


def signatures(text: np.ndarray, gram: np.ndarray, count: np.ndarray, rows: int, registers: int, seed: int = 1) -> np.ndarray:
    """The shingle that reached each register of each row first."""
    time = np.full(rows * registers, np.inf)
    who = np.zeros(rows * registers, np.uint64)
    x, rate, turn = np.zeros(len(gram)), 1.0 / count, 0
    last = np.full(rows, np.inf)
    while len(gram):
        turn += 1
        u = K.mix(gram + np.uint64((turn + (seed << 32)) * 0xA0761D6478BD642F % 2**64))
        x = x - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) * rate
        live = x < last[text]
        text, gram, rate, x, u = text[live], gram[live], rate[live], x[live], u[live]
        slot = text * registers + (K.mix(u) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(time, slot, x)
        won = x == time[slot]
        who[slot[won]] = gram[won]
        seen = np.unique(text)
        last[seen] = time.reshape(rows, registers)[seen].max(axis=1)
    return who.reshape(rows, registers)


def band_keys(words: K.Words, rows: int, banding: tuple[int, int, int]) -> pa.Array:
    """The keys of each row's bands."""
    bands, size, seed = banding
    who = signatures(*shingles(words), rows, bands * size, seed).reshape(rows, bands, size)
    band = np.broadcast_to(K.mix(np.arange(1, bands + 1, dtype=np.uint64) + np.uint64(seed << 32)), (rows, bands)).copy()
    for r in range(size):
        band = K.mix(band * np.uint64(0x9E3779B97F4A7C15) ^ who[:, :, r])
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * bands), pa.array(band.reshape(-1).view(np.int64)))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids = b.column("doc_id")
        for lo, hi, buf, offs in K.chunks(b.column("text"), CHUNK):
            w = K.Words(buf, offs)
            data = buf.tobytes()
            digests = [hashlib.blake2b(b" ".join(data[i:j].split()), digest_size=16).digest() for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(w.counts().astype(np.int64)), pa.array(digests, pa.binary()), band_keys(w, hi - lo, FIRST)], names=["doc_id", "n_words", "digest", "bands"])


def _sign_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, buf, offs in K.chunks(b.column("text"), CHUNK):
            yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("cls").slice(lo, hi - lo), band_keys(K.Words(buf, offs), hi - lo, STEEP)], names=["doc_id", "cls", "bands"])


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (shingles, counts)."""
    total = a[1].sum() + b[1].sum()
    at = np.minimum(np.searchsorted(a[0], b[0]), max(0, len(a[0]) - 1))
    same = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    both = np.minimum(a[1][at[same]], b[1][same]).sum()
    return float(both / (total - both)) if total else 1.0


def _compare(threshold: float):
    """Rows sorted by block, parts and part, the block's own texts first (mine = 0): links (a, b, similarity) of the others with these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own = None, []
        for b in batches:
            blocks, parts, mine, docs, classes = (b.column(c).to_pylist() for c in ("block", "part", "mine", "doc_id", "cls"))
            out: list[tuple[int, int, float]] = []
            for lo, hi, buf, offs in K.chunks(b.column("text")):
                text, gram, count = shingles(K.Words(buf, offs))
                cut = np.searchsorted(text, np.arange(hi - lo + 1))
                for i in range(lo, hi):
                    s = slice(cut[i - lo], cut[i - lo + 1])
                    here = (gram[s], count[s], int(count[s].sum()))
                    if (blocks[i], parts[i]) != block:
                        block, own = (blocks[i], parts[i]), []
                    if mine[i] == 0:
                        # a repeated row is the same text
                        if not any(doc == docs[i] and len(g[0]) == len(here[0]) and (g[0] == here[0]).all() and (g[1] == here[1]).all() for doc, _, g in own):
                            own.append((docs[i], classes[i], here))
                        continue
                    for doc, cls, there in own:
                        # the least total can't be under 0.8 of the greatest
                        if doc != docs[i] and (cls is None or cls != classes[i]) and min(here[2], there[2]) >= threshold * max(here[2], there[2]):
                            v = similarity(there, here)
                            if v >= threshold:
                                out.append((max(doc, docs[i]), min(doc, docs[i]), v))
            cols = list(zip(*out, strict=True)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], names=["a", "b", "similarity"])

    return run


def _sent(df: DataFrame) -> DataFrame:
    """df (a written table), to be sent to every task that joins it if it is small."""
    return F.broadcast(df) if df.count() <= SENT else df


def beside(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """common.beside, but a small table of groups is sent whole, so that no row is shuffled."""
    return rows.join(F.broadcast(groups), keys) if groups.count() <= SENT else by_size(rows, groups, keys, size)


def within(rows: DataFrame, groups: DataFrame, keys: list[str], size: str) -> DataFrame:
    """common.within, by the same rule."""
    return rows.join(F.broadcast(groups.select(*keys)), keys, "left_semi") if groups.count() <= SENT else within_by_size(rows, groups, keys, size)


def verified(members: DataFrame, owners: DataFrame | None, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between members (block, doc_id, cls, met) and owners (block, doc_id, cls, met) of the same block, of different classes where these are known.

    Without owners a block is the id of its only one, whose class members have as `c`.  members and owners are written tables.
    A block of many members is split into parts, each with the owners' texts once; met is the size of the bucket in which they meet."""
    n = partitions(members.sparkSession)
    parts = F.pow(2.0, F.ceil(F.log2(F.greatest(F.col("met") / STAR, F.lit(1.0))))).cast("int")
    p = members.withColumn("part", F.pmod(F.xxhash64("doc_id"), parts).cast("int"))
    if owners is None:
        heads = p.select("block", "part", F.lit(0).alias("mine"), F.col("block").alias("doc_id"), F.col("c").alias("cls")).distinct()
    else:
        heads = owners.select("block", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("mine"), "doc_id", "cls")
    rows = p.select("block", "part", F.lit(1).alias("mine"), "doc_id", "cls").unionByName(heads)
    rows = texts.join(F.broadcast(rows) if members.count() <= SENT else rows, "doc_id").select("block", "part", "mine", "doc_id", "cls", "text")
    found = rows.repartition(n, "block", "part").sortWithinPartitions("block", "part", "mine").mapInArrow(_compare(threshold), "a long, b long, similarity double").select("a", "b")
    # a pair meets once in the block of its centre, but in many blocks of buckets
    return materialise(found if owners is None else found.distinct(), "tested")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of the nodes of links (a, b; a written table), by alternating large-star and small-star steps; root is the least node.

    A step makes no more edges than it gets, so that they needn't be freed of repeats, which would shuffle them once more."""
    edges = links.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    with sized(links.sparkSession, links.count()):
        while True:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = materialise(both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("met")), "least")
            # done if each node has no lesser neighbour, or one neighbour alone: then all are roots, or beside theirs
            if not least.where("low < u and low < high").count():
                return least.select(F.col("u").alias("node"), F.least("low", "u").alias("root"))
            large = beside(both.where("v > u"), least.select("u", F.least("low", "u").alias("m"), "met"), ["u"], "met")
            down = materialise(large.select(F.col("v").alias("u"), F.col("m").alias("v")), "down")
            least = materialise(down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("met")), "least")
            small = beside(down, least, ["u"], "met").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            edges = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))), "edges")


def joined(roots: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    """roots after further links, and the classes (root) that these have moved (to): only these are looked at."""
    roots = roots.select("node", "root")
    known = _sent(roots)
    ends = fresh.select("a", "b").join(known.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(known.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    ends = materialise(ends.select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")), "ends")
    moved = components(ends.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("to"))
    new = ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("ra").alias("root")), F.struct(F.col("b").alias("node"), F.col("rb").alias("root")))).alias("x")).select("x.*").distinct()
    nodes = roots.unionByName(new.join(known, "node", "left_anti"))
    return materialise(nodes.join(_sent(moved), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots"), moved


def _with_met(keyed: DataFrame) -> DataFrame:
    """keyed with `met`, the size of the bucket, without buckets of one."""
    sizes = materialise(keyed.groupBy("key").agg(F.count("*").alias("met")).where("met > 1"), "sizes")
    return beside(keyed, sizes, ["key"], "met")


def _stars(keyed: DataFrame) -> DataFrame:
    """key, doc_id, centre, met from keyed (key, doc_id, met): each bucket's texts beside its centre, the text that meets most others over all its buckets."""
    central = keyed.join(keyed.groupBy("doc_id").agg(F.sum("met").alias("central")), "doc_id")
    best = central.groupBy("key").agg(F.max(F.struct("central", (-F.col("doc_id")).alias("least"))).alias("c"), F.max("met").alias("met"))
    centres = materialise(best.select("key", (-F.col("c.least")).alias("centre"), "met"), "centres")
    return beside(keyed.select("key", "doc_id"), centres, ["key"], "met").where("doc_id <> centre")


def _classed(keyed: DataFrame, roots: DataFrame) -> DataFrame:
    """key, doc_id, cls of keyed (key, doc_id): cls is the class, the root of the text's links, or itself."""
    # a text's class is looked up once and not for each of its keys, of which it has no more than bands
    docs = keyed.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    known = docs.join(_sent(roots), docs["doc_id"] == roots["node"], "left").select("doc_id", F.coalesce("root", "doc_id").alias("cls"), "keys")
    return known.select(F.explode("keys").alias("key"), "doc_id", "cls")


def _moved(classed: DataFrame, moved: DataFrame) -> DataFrame:
    """classed after some of its classes have been joined."""
    return classed.join(_sent(moved.select(F.col("root").alias("cls"), "to")), "cls", "left").withColumn("cls", F.coalesce("to", "cls")).select(*classed.columns)


def _open(classed: DataFrame) -> DataFrame:
    """The rows of classed in buckets of two or more classes, with met, the size of the bucket."""
    classed = materialise(classed, "classed")
    mixed = classed.groupBy("key").agg(F.count("*").alias("met"), F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high")
    return materialise(beside(classed, materialise(mixed.select("key", "met"), "mixed"), ["key"], "met"), "open")


def _still_open(rows: DataFrame) -> DataFrame:
    """The rows (key, doc_id, cls, met) in buckets that still are of two or more classes; rows holds whole buckets, so that these are as large as before."""
    rows = materialise(rows, "classed")
    mixed = rows.groupBy("key").agg(F.first("met").alias("met"), F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high")
    return materialise(within(rows, materialise(mixed.select("key", "met"), "mixed"), ["key"], "met"), "open")


def _small(rows: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links in buckets of SMALL texts or fewer: every pair of different classes, once however many buckets it shares."""
    few = rows.where(F.col("met") <= SMALL)
    if few.isEmpty():
        return few.select(F.col("doc_id").alias("a"), F.col("doc_id").alias("b"))
    other = _sent(few.select("key", F.col("doc_id").alias("block"), F.col("cls").alias("c")))
    pairs = few.join(other, "key").where("cls <> c and doc_id > block")
    # the size matters in larger buckets only
    pairs = materialise(pairs.select("block", "doc_id", "cls", F.lit(SMALL).alias("met"), "c").distinct(), "pairs")
    return pairs.select(F.col("doc_id").alias("a"), F.col("block").alias("b")) if pairs.isEmpty() else verified(pairs, None, texts, threshold)


def _again(rest: DataFrame, texts: DataFrame) -> DataFrame:
    """key, doc_id, cls of the longer signature of the texts in rest (doc_id, cls), whose classes go with them."""
    ids = _sent(materialise(rest.select("doc_id", "cls").distinct(), "rest"))
    signed = texts.join(ids, "doc_id").select("doc_id", "cls", "text").mapInArrow(_sign_again, "doc_id long, cls long, bands array<long>")
    return signed.select(F.explode(F.array_distinct("bands")).alias("key"), "doc_id", "cls")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """key, doc_id, cls, block, blocks from rows (key, doc_id, cls, met): `size` texts of each bucket, those of its smallest classes first, in blocks of BLOCK."""
    sizes = materialise(rows.groupBy("key", "cls").agg(F.count("*").alias("n")), "sizes")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("n", "doc_id"))
    ranked = beside(rows, sizes, ["key", "cls"], "n").withColumn("rank", rank).where(F.col("rank") <= size)
    return ranked.select("key", "doc_id", "cls", "met", F.xxhash64("key", F.floor((F.col("rank") - 1) / BLOCK)).alias("block"))


def _meeting(rows: DataFrame, size: int) -> DataFrame:
    """block, doc_id, cls, met: each of rows (whole buckets of met rows) once for each of its bucket's blocks in _blocks."""
    numbers = F.sequence(F.lit(0).cast("long"), F.floor((F.least("met", F.lit(size)) - 1) / BLOCK))
    return rows.select("key", "doc_id", "cls", "met", F.explode(numbers).alias("number")).select(F.xxhash64("key", "number").alias("block"), "doc_id", "cls", "met")


def links(keyed: DataFrame, texts: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The links (a, b) found among texts with band keys (key, doc_id, met), and their components (node, root)."""
    spark = keyed.sparkSession
    none = F.lit(None).cast("long").alias("cls")
    stars = materialise(_stars(keyed), "stars")
    # a text's stars may be of different sizes: the largest decides on the parts of all
    pairs = materialise(stars.groupBy(F.col("centre").alias("block"), "doc_id").agg(F.max("met").alias("met")).select("block", "doc_id", none, "met", none.alias("c")), "pairs")
    found = verified(pairs, None, texts, threshold)
    roots = components(found)
    # all pairs with the centre are settled, and a bucket whose texts are all like its centre is of one class
    rows = _open(_classed(stars.select("key", "doc_id"), roots))
    longer, size = False, BLOCK
    while n := rows.count():
        with sized(spark, n, 2_000):
            fresh = _small(rows, texts, threshold)
            rows = rows.where(F.col("met") > SMALL)
            if not fresh.isEmpty():
                found, (roots, moved) = found.unionByName(fresh), joined(roots, fresh)
                rows = _still_open(_moved(rows, moved))
            if rows.isEmpty():
                break
            if not longer:
                rows, longer = _open(_again(rows, texts)), True
                continue
            # what is left are large buckets of the longer signature
            top = materialise(_blocks(rows, size), "blocks")
            fresh = verified(materialise(_meeting(rows, size), "members"), top, texts, threshold)
            rows, size = rows.join(_sent(top.select("key", "doc_id")), ["key", "doc_id"], "left_anti").select("key", "doc_id", "cls"), 4 * size
            if not fresh.isEmpty():
                found, (roots, moved) = found.unionByName(fresh), joined(roots, fresh)
                rows = _moved(rows, moved)
            rows = _open(rows)
    return found.distinct(), roots


def _twins(signed: DataFrame, folded: DataFrame, several: DataFrame) -> DataFrame:
    """Links (a, b) between the texts of the documents in several, whose id occurs with different texts."""
    nodes = signed.select("doc_id", "digest").join(several, "doc_id").join(folded.select("digest", "text_id"), "digest")
    least = F.min("text_id").over(Window.partitionBy("doc_id"))
    return nodes.select(F.col("text_id").alias("a"), least.alias("b")).where("a <> b").distinct()


def classes(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id (least id of the class), text_id (least id with an equal text), n_links (verified links of that text)."""
    spark = docs.sparkSession
    d = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialise(d.mapInArrow(_sign, "doc_id long, n_words long, digest binary, bands array<long>"), "signatures")
    with sized(spark, signed.count() * FIRST[0]):
        folded = materialise(signed.groupBy("digest").agg(F.min("doc_id").alias("text_id"), F.count("*").alias("copies"), F.first("n_words").alias("n_words"), F.first("bands").alias("bands")), "folded")
        # an id with different texts can have a key twice, which does no harm: its bucket counts it twice
        keyed = folded.where("n_words > 0").select(F.col("text_id").alias("doc_id"), F.explode(F.array_distinct("bands")).alias("key"))
        keyed = materialise(_with_met(keyed).select("key", "doc_id", "met"), "buckets")
        # ids are small beside texts: they are hashed, so that no text is sorted
        involved = d.repartition(partitions(spark), "doc_id").join(keyed.select("doc_id").distinct().hint("shuffle_hash"), "doc_id", "left_semi")
        found, roots = links(keyed, laid_out(involved, "doc_id", "texts", placed=True), threshold)
        several = signed.groupBy("doc_id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high").select("doc_id")
        several = materialise(several, "several")
        if not several.isEmpty():
            twins = materialise(_twins(signed, folded, several), "twins")
            if not twins.isEmpty():
                roots, _ = joined(roots, twins)
        degree = found.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
        about = roots.join(degree, "node", "left")
        about = F.broadcast(about) if roots.count() <= SENT else about
        known = folded.join(about, folded["text_id"] == about["node"], "left").select("digest", "copies", "text_id", F.coalesce("root", "text_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
        known = materialise(known, "classes")
    return beside(signed.drop("bands"), known, ["digest"], "copies").select("doc_id", "class_id", "text_id", "n_links")


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"))


QUERIES = {"op9_near_dup": op9_near_dup}
ORACLE: dict[str, str] = {}
