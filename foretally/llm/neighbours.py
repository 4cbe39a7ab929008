"""Approximate nearest neighbours by a robust-pruned directed graph (operator 13).

1. Rows of equal vectors are folded: a vector keeps its k + 1 smallest ids, which is all
   that k neighbours of any query can show of it.
2. Vectors are dealt by a hash into shards of about SHARD_ROWS.  A task builds the graph of one shard:
   batches of vectors search the graph so far from its medoid; of the vectors met on the way (and those already linked) robust
   pruning keeps the nearest, drops whatever is ALPHA times nearer to it than to the vector, and goes on, up to DEGREE edges; each
   edge is also offered to its far end, which is pruned likewise when it overflows.  All vectors go
   through this a second time.  The graph is written as rows of vector, ids and edges.
3. Queries search every shard with a beam of BEAM, in blocks of QUERY_ROWS; many queries advance together.
   Distances of what a beam holds are computed in double precision on the original vectors, and the nearest of all shards are merged.

Equal queries are searched for once.  No task holds more than a shard and a block of queries, however many rows share a vector.

Defined results: vectors that are null, zero, or hold a null or a component that isn't finite take no part, nor do rows
without an id; vectors of another length than the query's aren't its candidates; rows that share an id are candidates of their own, but
none is a neighbour of a query with that id; with fewer than k candidates all are returned; ties go to the smaller id; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import beside, materialise, partitions, table

NEIGHBOURS, QUERY_STEP = 10, 100
SHARD_ROWS, QUERY_ROWS = 16_384, 8_192
#: Edges of a vector, vectors that a search keeps while the graph is built and afterwards, and by how much a kept neighbour must be nearer to drop another.
DEGREE, BUILD_BEAM, BEAM, ALPHA = 32, 48, 128, 1.2
#: Vectors that are linked, and queries that advance, together.
BATCH = 512


class Graph:
    """Vectors and their edges (-1: none)."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray | None = None, degree: int = DEGREE):
        self.scale = np.abs(vectors).max(initial=0) or 1.0
        self.x = self._scaled(vectors)
        self.norms = np.einsum("nd,nd->n", self.x, self.x)
        self.edges = np.full((len(vectors), degree), -1, np.int64) if edges is None else edges
        self.entry = int(((self.x - self.x.mean(axis=0)) ** 2).sum(axis=1).argmin()) if len(vectors) else 0

    def _scaled(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors by which the graph is walked; only their order counts."""
        return np.clip(vectors / self.scale, -1e9, 1e9).astype(np.float32)

    def _squares(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances from each row of q to the vectors at the places of its row, without the row's own square."""
        return self.norms[at] - 2 * np.matmul(self.x[at], q[:, :, None])[:, :, 0]

    def walk(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(the beam, the vectors expanded on the way) of each query; -1 fills up.  Greedy: always the nearest that isn't expanded yet."""
        n, rows = len(self.x), np.arange(len(q))
        near = np.full((len(q), beam), -1, np.int64)
        far = np.full((len(q), beam), np.inf, np.float32)
        near[:, 0], far[:, 0] = self.entry, self._squares(q, np.full((len(q), 1), self.entry))[:, 0]
        done = np.zeros((len(q), beam), bool)
        seen = np.zeros((len(q), n), bool)
        seen[:, self.entry] = True
        path, active = [], rows
        while len(active):
            open_far = np.where(done[active], np.inf, far[active])
            slot = open_far.argmin(axis=1)
            going = np.isfinite(open_far[np.arange(len(active)), slot])
            active, slot = active[going], slot[going]
            if not len(active):
                break
            now = near[active, slot]
            done[active, slot] = True
            step = np.full(len(q), -1, np.int64)
            step[active] = now
            path.append(step)
            to = self.edges[now]
            new = (to >= 0) & ~seen[active[:, None], to]
            seen[active[:, None], np.where(new, to, self.entry)] = True
            d = np.where(new, self._squares(q[active], np.maximum(to, 0)), np.inf)
            all_far, all_near = np.hstack((far[active], d)), np.hstack((near[active], np.where(new, to, -1)))
            all_done = np.hstack((done[active], np.zeros(to.shape, bool)))
            order = np.argpartition(all_far, beam - 1, axis=1)[:, :beam]
            far[active], near[active], done[active] = (np.take_along_axis(a, order, 1) for a in (all_far, all_near, all_done))
        return near, np.stack(path, axis=1) if path else np.zeros((len(q), 0), np.int64)

    def prune(self, own: np.ndarray, pool: np.ndarray, alpha: float) -> np.ndarray:
        """The edges of each vector in `own` out of its row of `pool` (-1 fills up; repeats and itself don't count)."""
        pool = np.sort(pool, axis=1)
        pool[:, 1:][pool[:, 1:] == pool[:, :-1]] = -1
        pool[pool == own[:, None]] = -1
        d = np.where(pool >= 0, self._squares(self.x[own], np.maximum(pool, 0)) + self.norms[own][:, None], np.inf)
        order = np.argsort(d, axis=1, kind="stable")
        pool, d = np.take_along_axis(pool, order, 1), np.take_along_axis(d, order, 1)
        width = int((pool >= 0).sum(axis=1).max(initial=0))
        pool, d = pool[:, :width], d[:, :width]
        degree, rows = self.edges.shape[1], np.arange(len(own))
        out = np.full((len(own), degree), -1, np.int64)
        x = self.x[np.maximum(pool, 0)]
        squares = self.norms[np.maximum(pool, 0)]
        between = squares[:, :, None] + squares[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
        alive = pool >= 0
        for k in range(min(degree, width)):
            best = alive.argmax(axis=1)
            some = alive[rows, best]
            if not some.any():
                break
            out[some, k] = pool[rows, best][some]
            alive &= alpha * alpha * between[rows, best] > d
            alive[rows, best] = False
        return out

    def _offer(self, source: np.ndarray, target: np.ndarray, alpha: float) -> None:
        """Edges back: source becomes a neighbour of target; who has too many is pruned."""
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        owner, first, size = np.unique(target, return_index=True, return_counts=True)
        degree = self.edges.shape[1]
        for few in np.array_split(np.argsort(size, kind="stable"), -(-len(owner) // BATCH) or 1):  # those with similar numbers together
            if not len(few):
                continue
            own, n = owner[few], size[few]
            width = int(n.max())
            steps = 1 + width // (4 * degree)  # very many offers to one vector come in portions
            for part in np.array_split(np.arange(width), steps):
                offered = np.full((len(own), len(part)), -1, np.int64)
                there = part[None, :] < n[:, None]
                offered[there] = source[(first[few][:, None] + part[None, :])[there]]
                pool = np.hstack((self.edges[own], offered))
                full = (pool >= 0).sum(axis=1) > degree
                if (~full).any():
                    kept = np.sort(np.where(pool[~full] >= 0, pool[~full], np.iinfo(np.int64).max), axis=1)
                    kept[:, 1:][kept[:, 1:] == kept[:, :-1]] = np.iinfo(np.int64).max
                    kept = np.sort(kept, axis=1)[:, :degree]
                    self.edges[own[~full]] = np.where(kept == np.iinfo(np.int64).max, -1, kept)
                if full.any():
                    self.edges[own[full]] = self.prune(own[full], pool[full], alpha)

    def link(self, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> Graph:
        """All vectors get their edges, in batches that double up to BATCH; then once more over the whole graph."""
        order = np.random.RandomState(13).permutation(len(self.x))
        order = np.append(self.entry, order[order != self.entry]) if len(order) else order
        for again in (False, True):
            at, size = 0, BATCH if again else 1
            while at < len(order):
                own = order[at : at + size]
                _, met = self.walk(self.x[own], beam)
                pool = np.hstack((met, self.edges[own]))
                self.edges[own] = self.prune(own, pool, alpha)
                target = self.edges[own]
                source = np.broadcast_to(own[:, None], target.shape)[target >= 0]
                self._offer(source, target[target >= 0], alpha)
                at, size = at + size, min(BATCH, size * 2)
        return self

    def search(self, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """The beam of each query, unordered; -1 fills up."""
        q = self._scaled(queries)
        return np.vstack([self.walk(part, beam)[0] for part in np.array_split(q, -(-len(q) // BATCH))]) if len(q) else np.zeros((0, beam), np.int64)


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id, vector (as given) of the rows that take part."""
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    return rows.where(finite & F.exists("embedding", lambda v: v != 0)).withColumnRenamed("embedding", "vector")


def folded(vectors: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """vector, ids (its k + 1 smallest): a row a different vector."""
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    return vectors.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten()).astype(np.float64).reshape(len(flat), -1)


def graph(vectors: DataFrame, shard_rows: int = SHARD_ROWS, degree: int = DEGREE) -> DataFrame:
    """dim, shard, node, ids, vector (doubles), edges: the graph of every shard of folded vectors, which should be a written table."""
    rows = vectors.select(F.size("vector").alias("dim"), "ids", F.col("vector").cast("array<double>").alias("vector"))
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    dealt = rows.join(sizes, "dim").select("dim", F.pmod(F.xxhash64("ids"), F.greatest(F.lit(1), F.ceil(F.col("n") / shard_rows))).cast("int").alias("shard"), "ids", "vector")

    def build(shard: pa.Table) -> pa.Table:
        shard = shard.take(np.argsort([x[0].as_py() for x in shard["ids"]], kind="stable"))  # whatever the shuffle's order was
        edges = Graph(_matrix(shard["vector"]), degree=degree).link().edges
        offsets = np.append(0, np.cumsum((edges >= 0).sum(axis=1)))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(edges[edges >= 0], pa.int32()))
        columns = {"dim": shard["dim"], "shard": shard["shard"], "node": pa.array(np.arange(len(shard)), pa.int32()), "ids": shard["ids"].cast(pa.list_(pa.int64())), "vector": shard["vector"].cast(pa.list_(pa.float64())), "edges": lists}
        return pa.table(columns)

    # rows are small beside the work on them, so that what is coalesced by bytes would meet in few tasks
    return dealt.repartition(partitions(vectors.sparkSession), "dim", "shard").groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, node int, ids array<long>, vector array<double>, edges array<int>")


def _beams(k: int, beam: int):
    def run(nodes: pa.Table, queries: pa.Table) -> pa.Table:
        found: dict[str, list] = {"key": [], "score": [], "ids": []}
        if len(nodes) and len(queries):
            nodes = nodes.take(np.argsort(np.asarray(nodes["node"]), kind="stable"))
            x, q = _matrix(nodes["vector"]), _matrix(queries["vector"])
            lengths = np.asarray(nodes["edges"].combine_chunks().value_lengths()).astype(np.int64)
            edges = np.full((len(x), max(1, int(lengths.max()))), -1, np.int64)
            edges[np.repeat(np.arange(len(x)), lengths), K.ranges(np.zeros(len(x), np.int64), lengths)] = np.asarray(nodes["edges"].combine_chunks().flatten())
            ids, keys = nodes["ids"].to_pylist(), queries["key"].to_pylist()
            for row, near in enumerate(Graph(x, edges).search(q, beam)):
                near = near[near >= 0]
                d = np.sqrt(((x[near] - q[row]) ** 2).sum(axis=1))
                for score, own in sorted(zip(d.tolist(), (ids[i] for i in near.tolist()), strict=True))[: k + 1]:
                    for column, value in zip(found.values(), (keys[row], score, own), strict=True):
                        column.append(value)
        return pa.table({"key": pa.array(found["key"], pa.string()), "score": pa.array(found["score"], pa.float64()), "ids": pa.array(found["ids"], pa.list_(pa.int64()))})

    return run


def search(nodes: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, beam: int = BEAM, query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest to each query (vec_id, vector) that isn't the query's own id; `nodes` is a written graph."""
    keyed = queries.select(F.col("vec_id").alias("query_id"), F.sha2(F.col("vector").cast("array<double>").cast("string"), 256).alias("key"), F.col("vector").cast("array<double>").alias("vector"))
    keyed = materialise(keyed, "queries")
    own = materialise(keyed.groupBy("key").agg(F.any_value("vector").alias("vector"), F.count(F.lit(1)).alias("n_queries")), "searched")
    n_blocks = max(1, -(-own.count() // query_rows))
    shards = nodes.select(F.col("dim").alias("q_dim"), F.col("shard").alias("q_shard")).distinct()
    asked = own.select("key", "vector", F.size("vector").alias("q_dim"), F.pmod(F.xxhash64("key"), F.lit(n_blocks)).alias("q_block")).join(shards, "q_dim")
    held = nodes.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))))
    n = partitions(nodes.sparkSession)
    held, asked = held.repartition(n, "dim", "shard", "block"), asked.repartition(n, "q_dim", "q_shard", "q_block")
    met = held.groupBy("dim", "shard", "block").cogroup(asked.groupBy("q_dim", "q_shard", "q_block")).applyInArrow(_beams(k, beam), "key string, score double, ids array<long>")
    place = F.row_number().over(Window.partitionBy("key").orderBy("score", F.col("ids")[0]))
    nearest = met.withColumn("place", place).where(F.col("place") <= k + 1).select("key", F.explode(F.transform("ids", lambda i: F.struct(F.col("score").alias("score"), i.alias("vec_id")))).alias("hit"))
    answers = nearest.groupBy("key").agg(F.array_sort(F.collect_list("hit")).alias("hits")).join(own.select("key", "n_queries"), "key")
    pairs = beside(keyed.select("query_id", "key"), materialise(answers, "answers"), ["key"], "n_queries")
    kept = pairs.select("query_id", F.posexplode(F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)).alias("at", "hit"))
    return kept.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


def nearest(embeddings: DataFrame, step: int = QUERY_STEP, k: int = NEIGHBOURS) -> DataFrame:
    """The k nearest rows to each row whose id is divisible by `step`."""
    vectors = usable(embeddings)
    nodes = materialise(graph(materialise(folded(vectors, k), "vectors")), "graph")
    return search(nodes, vectors.where(F.pmod("vec_id", F.lit(step)) == 0), k)


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {"op13_neighbours": op13_neighbours}
ORACLE: dict[str, str] = {}
