"""Approximate nearest neighbours: a robust-pruned directed graph for each shard of vectors, beam search in all shards.

Distinct vectors are dealt to shards by a hash.  A shard's graph starts random; each vector is searched for greedily
from the medoid, what the search visits proposes neighbours, and relaxed distance pruning (a candidate goes if a kept
neighbour is nearer to it by a factor of ALPHA) keeps diverse edges, both ways, at most DEGREE.  A query runs a beam search of width
BEAM in every shard; the nearest of all shards are its result, with exact distances of the original vectors.

Every vector is indexed.  The index is a table in the shared folder.  Queries go out in blocks of about
BLOCK_BYTES, each broadcast, answered by all shards and released before the next; larger query sets take more blocks.  Equal vectors are one node that holds the least ids, as many as a result
can show, put together per task before rows move: a vector that a third of all rows share is one node.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows without
id; vectors of another length than the query's are no candidates; rows that repeat an id and vector count once; an
id with several vectors asks with the least of them, and is found by each; extra columns
are dropped; an empty table, or one without queries, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, table

SHARD = 4096
DEGREE = 32
ALPHA = 1.2
BUILD_BEAM = 64
BEAM = 192
#: Bytes of query vectors that go out at once.
BLOCK_BYTES = 32_000_000
NEAREST = 10


def distances(vectors: np.ndarray, of: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of points `of` (b, d) to the vectors numbered `to` (b, k)."""
    diff = vectors[to] - of[:, None, :]
    return np.einsum("bkd,bkd->bk", diff, diff)


class Graph:
    """Robust-pruned graph of float32 vectors; edges: (n, width) numbers of neighbours, -1 where none."""

    def __init__(self, vectors: np.ndarray, edges: np.ndarray | None = None, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM):
        self.v, self.degree = vectors, degree
        n = len(vectors)
        centre = vectors.mean(0, dtype=np.float64).astype(np.float32)
        self.medoid = int(np.argmin(((vectors - centre) ** 2).sum(1)))
        if edges is not None:
            self.edges = edges
            return
        rng = np.random.default_rng(n)
        self.width = degree + degree // 2
        self.edges = np.full((n, self.width), -1, dtype=np.int32)
        if n > 1:
            first = rng.integers(0, n - 1, (n, min(degree // 2, n - 1)), dtype=np.int32)
            first += first >= np.arange(n)[:, None]
            self.edges[:, : first.shape[1]] = first
        for factor in (1.0, alpha):
            order = rng.permutation(n)
            for at in range(0, n, 256):
                self._insert(order[at : at + 256], beam, factor)
        self.edges = np.ascontiguousarray(self._pruned(np.arange(n), self.edges.astype(np.int64), alpha)) if n else self.edges

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Greedy beam search of all queries in step: (numbers, squared distances) of the beam, nearest first; -1 where none."""
        b, n = len(queries), len(self.v)
        rows = np.arange(b)
        ids = np.full((b, beam), -1, dtype=np.int64)
        dist = np.full((b, beam), np.inf, dtype=np.float32)
        done = np.zeros((b, beam), dtype=bool)
        seen = np.zeros((b, n + 1), dtype=bool)  # the last column is for -1
        ids[:, 0] = self.medoid
        dist[:, 0] = distances(self.v, queries, ids[:, :1])[:, 0]
        seen[:, self.medoid] = seen[:, n] = True
        live = rows
        while len(live):
            at = np.argmin(np.where(done[live] | (ids[live] < 0), np.inf, dist[live]), 1)
            done[live, at] = True
            near = self.edges[ids[live, at]].astype(np.int64)
            near[near < 0] = n
            new = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            near[near == n] = 0
            d = np.where(new, distances(self.v, queries[live], near), np.inf).astype(np.float32)
            every, every_d = np.concatenate([ids[live], np.where(new, near, -1)], 1), np.concatenate([dist[live], d], 1)
            every_done = np.concatenate([done[live], np.zeros_like(new)], 1)
            order = np.argsort(every_d, 1, kind="stable")[:, :beam]
            ids[live], dist[live] = np.take_along_axis(every, order, 1), np.take_along_axis(every_d, order, 1)
            done[live] = np.take_along_axis(every_done, order, 1)
            live = live[(~done[live] & (ids[live] >= 0)).any(1)]
        return ids, dist

    def _pruned(self, points: np.ndarray, candidates: np.ndarray, alpha: float) -> np.ndarray:
        """Robust pruning of candidates (b, k) of each point: at most `degree` diverse neighbours, nearest first."""
        out = np.full((len(points), self.width), -1, dtype=np.int32)
        for a in range(0, len(points), 512):
            p, c = points[a : a + 512], candidates[a : a + 512].copy()
            c[c == p[:, None]] = -1
            c.sort(1)
            c[:, 1:][c[:, 1:] == c[:, :-1]] = -1
            safe = np.where(c < 0, 0, c)
            d = np.where(c < 0, np.inf, distances(self.v, self.v[p], safe))
            for k in range(self.degree):
                best = np.argmin(d, 1)
                live = np.flatnonzero(np.isfinite(d[np.arange(len(p)), best]))
                if not len(live):
                    break
                chosen = safe[live, best[live]]
                out[a + live, k] = chosen
                between = distances(self.v, self.v[chosen], safe[live])
                d[live] = np.where(alpha * alpha * between <= d[live], np.inf, d[live])
                d[live, best[live]] = np.inf
        return out

    def _insert(self, points: np.ndarray, beam: int, alpha: float) -> None:
        ids, _ = self.search(self.v[points], beam)
        self.edges[points] = self._pruned(points, np.concatenate([ids, self.edges[points].astype(np.int64)], 1), alpha)
        source = np.repeat(points, self.width)
        target = self.edges[points].ravel()
        source, target = source[target >= 0], target[target >= 0]
        held = (self.edges[target] == source[:, None]).any(1)
        source, target = source[~held], target[~held]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        free = (self.edges[nodes] < 0).sum(1)
        most = int(counts.max(initial=0))
        add = np.full((len(nodes), most), -1, dtype=np.int64)
        add[np.repeat(np.arange(len(nodes)), counts), np.arange(len(target)) - np.repeat(first, counts)] = source
        every = np.concatenate([self.edges[nodes].astype(np.int64), add], 1)
        fits = counts <= free
        every_sorted = -np.sort(-every[fits], 1)[:, : self.width]
        self.edges[nodes[fits]] = every_sorted
        if (~fits).any():
            self.edges[nodes[~fits]] = self._pruned(nodes[~fits], every[~fits], alpha)


def valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(_id, _v): rows that take part."""
    v = F.col("_v")
    fits = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).cast("array<double>").alias("_v")).where(F.col("_id").isNotNull() & v.isNotNull() & fits)


_NODES = "key binary, ids array<long>"
_NODE = pa.schema([("key", pa.binary()), ("ids", pa.list_(pa.int64()))])


def _merged(most: int):
    """Equal vectors become one node with the least ids, per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.list_(pa.int64()))], schema=_NODE)
            held.clear()
            return out

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key = (np.array(v, dtype="<f8") + 0.0).tobytes()
                ids = held.setdefault(key, [])
                if i not in ids:
                    ids.append(i)
                    if len(ids) > most:
                        ids.remove(max(ids))
            if len(held) > 50_000:
                yield flush()
        yield flush()

    return run


def _built(most: int, degree: int, alpha: float, beam: int):
    def build(group: pa.Table) -> pa.Table:
        nodes: dict[bytes, set[int]] = {}
        for key, ids in zip(group["key"].to_pylist(), group["ids"].to_pylist()):
            nodes.setdefault(key, set()).update(ids)
        keys = sorted(nodes, key=lambda k: min(nodes[k]))
        vectors = np.frombuffer(b"".join(keys), "<f8").reshape(len(keys), -1)
        edges = Graph(vectors.astype(np.float32), None, degree, alpha, beam).edges
        ids = np.full((len(keys), most), -1, dtype="<i8")
        for k, key in enumerate(keys):
            least = sorted(nodes[key])[:most]
            ids[k, : len(least)] = least
        return pa.table([pa.array([len(keys)], pa.int32()), pa.array([vectors.tobytes()], pa.binary()), pa.array([edges.astype("<i4").tobytes()], pa.binary()), pa.array([ids.tobytes()], pa.binary())], names=["n", "vectors", "edges", "ids"])

    return build


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM, most: int = NEAREST + 1) -> DataFrame:
    """One row a shard: n, vectors (doubles), edges (32-bit), ids (64-bit, `most` a node, -1 where none)."""
    rows = valid(vectors, id_col, vector_col)
    nodes = staged(rows.mapInArrow(_merged(most), _NODES), "nodes")
    shards = max(1, -(-nodes.count() // shard))
    dealt = nodes.select(F.octet_length("key").alias("_size"), F.pmod(F.xxhash64("key"), F.lit(shards)).alias("_shard"), "key", "ids")
    return staged(dealt.groupBy("_size", "_shard").applyInArrow(_built(most, degree, alpha, beam), "n int, vectors binary, edges binary, ids binary"), "index")


def _searched(queries, nearest: int, beam: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, keys = queries.value
        for batch in batches:
            for n, vectors, edges, ids in zip(*(c.to_pylist() for c in batch.columns)):
                v = np.frombuffer(vectors, "<f8").reshape(n, -1)
                fits = [k for k, key in enumerate(keys) if len(key) == v.shape[1] * 8]
                if not fits:
                    continue
                graph = Graph(v.astype(np.float32), np.frombuffer(edges, "<i4").reshape(n, -1))
                members = np.frombuffer(ids, "<i8").reshape(n, most)
                for a in range(0, len(fits), 512):
                    some = fits[a : a + 512]
                    q = np.frombuffer(b"".join(keys[k] for k in some), "<f8").reshape(len(some), -1)
                    near, _ = graph.search(q.astype(np.float32), beam)
                    query, hit, score = [], [], []
                    for row, k in enumerate(some):
                        found = near[row][near[row] >= 0]
                        d = np.sqrt(((v[found] - q[row]) ** 2).sum(1))
                        every = members[found]
                        keep = (every >= 0) & (every != names[k])
                        i, s = every[keep], np.repeat(d, keep.sum(1))
                        best = np.lexsort((i, s))[:nearest]
                        query += [names[k]] * len(best)
                        hit += i[best].tolist()
                        score += s[best].tolist()
                    yield pa.RecordBatch.from_arrays([pa.array(query, pa.int64()), pa.array(hit, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def search_index(index: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", nearest: int = NEAREST, beam: int = BEAM, most: int = NEAREST + 1) -> DataFrame:
    """query_id, rank, vec_id, score of the `nearest` vectors that the beams find, without the query's own id."""
    spark = index.sparkSession
    asked = staged(valid(queries, id_col, vector_col).groupBy("_id").agg(F.min("_v").alias("_v")), "queries")
    size = asked.agg(F.sum(F.size("_v") * 8 + 64)).first()[0] or 0
    count = max(1, -(-size // BLOCK_BYTES))
    found = None
    for b in range(count):
        block = asked.where(F.pmod(F.xxhash64("_id"), F.lit(count)) == b).orderBy("_id").collect()  # about BLOCK_BYTES
        sent = spark.sparkContext.broadcast(([r[0] for r in block], [(np.array(r[1], "<f8") + 0.0).tobytes() for r in block]))
        got = staged(index.mapInArrow(_searched(sent, nearest, beam, most), "query_id long, vec_id long, score double"), "found")
        sent.destroy()
        found = got if found is None else found.unionByName(got)
    ranked = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return ranked.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    return search_index(build_index(vectors, id_col, vector_col), vectors.where(is_query), id_col, vector_col)


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, F.col("vec_id") % 100 == 0)
