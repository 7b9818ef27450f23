"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard.

Inner products are turned into distances: every vector of a shard gets one more
component that makes all norms equal, so the nearest are those of largest inner
product.  Equal vectors of a shard are one node with all its ids.

A shard's graph starts with random edges.  Points are inserted in batches: a
greedy beam search proposes neighbours, and relaxed pruning keeps a candidate
only if none kept before is nearer to it by the factor ``ALPHA``; edges are also
added backwards, and nodes over their degree are pruned again.  A query is
searched by beam in the graph of every shard; what the beam holds is scored
exactly, in double precision on the original vectors.

Shards are dealt by a hash of the id and hold about ``SHARD_NODES`` vectors, so
memory is bounded.  Shards are written to the shared folder.  The stated query set
goes to every shard; a task holds one shard at a time while its queries stream
past, so a shard is shuffled once for each ``QUERIES_A_TASK`` queries.  Each query keeps its best from each shard,
and the best of these.  So the work is that of all queries
times all shards, by the method; of several shards each gives its own nearest,
so recall does not fall with their number (measured: see README).

Defined cases: vectors that are null, zero, or hold null or non-finite
components, and rows without id, take no part; vectors of different length
never meet; rows of one query id give one query, the least of their vectors;
ties go to the smaller id, also among any number of equal vectors; a shard with
fewer nodes than the beam is searched whole; an empty table gives no rows;
vectors of any length are used whole; further columns play no part, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import table
from corpusloom.sources.session import materialise, ship_package

SHARD_NODES = 16_384
DEGREE = 32
ALPHA = 1.2
BEAM = 96
#: A beam holds at least so many nodes for each one asked for.
BEAM_A_RESULT = 4
BUILD_BEAM = 64
BATCH = 256
ENTRIES = 8
#: Queries that one task streams past a shard, about; more go to further tasks, each with the shard.
QUERIES_A_TASK = 1 << 18


class Graph:
    """A directed graph over vectors, built by greedy search and robust pruning."""

    def __init__(self, vectors: np.ndarray, neighbours: np.ndarray | None = None) -> None:
        vectors = np.asarray(vectors, dtype=np.float64)
        norms = np.sqrt((vectors**2).sum(axis=1))
        most = norms.max() if len(norms) else 1.0
        rest = np.sqrt(np.maximum(most**2 - norms**2, 0))
        self.points = (np.hstack([vectors, rest[:, None]]) / most).astype(np.float32)
        self.square = (self.points**2).sum(axis=1)
        self.neighbours = self._build() if neighbours is None else neighbours

    def __len__(self) -> int:
        return len(self.points)

    def _entries(self) -> np.ndarray:
        middle = ((self.points - self.points.mean(axis=0)) ** 2).sum(axis=1).argmin()
        some = np.random.default_rng(1).integers(0, len(self), ENTRIES)
        return np.unique(np.append(some, middle))

    def beam(self, queries: np.ndarray, width: int, neighbours: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Nodes and distances found for each query, nearest first; -1 where fewer were found."""
        graph = self.neighbours if neighbours is None else neighbours
        n, row = len(queries), np.arange(len(queries))[:, None]
        entries = self._entries()
        width = max(width, len(entries))
        ids = np.full((n, width), -1, dtype=np.int64)
        far = np.full((n, width), np.inf, dtype=np.float32)
        done = np.zeros((n, width), dtype=bool)
        seen = np.zeros((n, len(self) + 1), dtype=bool)
        ids[:, : len(entries)] = entries
        far[:, : len(entries)] = self.square[entries] - 2 * queries @ self.points[entries].T
        seen[:, entries] = True
        seen[:, -1] = True  # stands for no neighbour
        live = np.arange(n)
        while len(live):
            open_ = np.where(done[live], np.inf, far[live])
            pick = open_.argmin(axis=1)
            going = np.isfinite(open_[np.arange(len(live)), pick])
            live, pick = live[going], pick[going]
            if not len(live):
                break
            done[live, pick] = True
            near = graph[ids[live, pick]]
            new = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            there = np.minimum(near, len(self) - 1)
            d = self.square[there] - 2 * np.einsum("bd,bkd->bk", queries[live], self.points[there])
            d = np.where(new, d, np.inf).astype(np.float32)
            all_far = np.concatenate([far[live], d], axis=1)
            order = np.argpartition(all_far, width - 1, axis=1)[:, :width]
            at = np.arange(len(live))[:, None]
            ids[live] = np.concatenate([ids[live], near], axis=1)[at, order]
            done[live] = np.concatenate([done[live], np.zeros_like(new)], axis=1)[at, order]
            far[live] = all_far[at, order]
        order = far.argsort(axis=1)
        ids, far = ids[row, order], far[row, order]
        ids[~np.isfinite(far)] = -1
        return ids, far

    def _prune(self, node: int, candidates: np.ndarray, degree: int) -> np.ndarray:
        """Robust pruning: near candidates first, those hidden behind a kept one dropped."""
        candidates = np.unique(candidates)
        candidates = candidates[(candidates >= 0) & (candidates != node) & (candidates < len(self))]
        if len(candidates) <= 1:
            return candidates
        x = self.points[candidates]
        to_node = ((x - self.points[node]) ** 2).sum(axis=1)
        order = to_node.argsort(kind="stable")
        candidates, x, to_node = candidates[order], x[order], to_node[order]
        square = (x**2).sum(axis=1)
        between = square[:, None] + square[None, :] - 2 * x @ x.T
        alive, kept = np.ones(len(candidates), dtype=bool), []
        for i in range(len(candidates)):
            if alive[i]:
                kept.append(i)
                if len(kept) == degree:
                    break
                alive &= ALPHA**2 * between[i] > to_node
        return candidates[kept]

    def _build(self) -> np.ndarray:
        n = len(self)
        room = DEGREE + DEGREE // 2
        rng = np.random.default_rng(0)
        graph = np.full((n + 1, room), n, dtype=np.int32)  # the last row and value stand for nothing
        if n <= 1:
            return graph
        graph[:n, : DEGREE // 2] = rng.integers(0, n, (n, DEGREE // 2))
        size = np.full(n, DEGREE // 2)
        order = rng.permutation(n)
        for at in range(0, n, BATCH):
            batch = order[at : at + BATCH]
            found, _ = self.beam(self.points[batch], BUILD_BEAM, graph)
            for node, near in zip(batch.tolist(), found):
                kept = self._prune(node, np.concatenate([near, graph[node, : size[node]]]), DEGREE)
                graph[node] = n
                graph[node, : len(kept)] = kept
                size[node] = len(kept)
                for other in kept.tolist():
                    if node in graph[other, : size[other]]:
                        continue
                    if size[other] == room:
                        best = self._prune(other, np.append(graph[other], node), DEGREE)
                        graph[other] = n
                        graph[other, : len(best)] = best
                        size[other] = len(best)
                    else:
                        graph[other, size[other]] = node
                        size[other] += 1
        return graph

    def search(self, queries: np.ndarray, width: int = BEAM) -> np.ndarray:
        """Nodes found for original query vectors, about nearest first; -1 where fewer were found."""
        q = np.asarray(queries, dtype=np.float64)
        scale = np.sqrt((q**2).sum(axis=1, keepdims=True))
        flat = np.hstack([q / np.where(scale > 0, scale, 1), np.zeros((len(q), 1))]).astype(np.float32)
        parts = [self.beam(flat[i : i + BATCH], width)[0] for i in range(0, len(flat), BATCH)]
        return np.concatenate(parts) if parts else np.zeros((0, width), dtype=np.int64)


_SHARD_TYPE = "dim int, shard int, vectors binary, graph binary, ids array<array<bigint>>"


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64).reshape(len(column), -1)


def _build_shard(rows: pa.Table) -> pa.Table:
    """One row that holds a shard's distinct vectors, its graph, and the ids of each node."""
    vectors, ids = _matrix(rows["x"]), np.array(rows["vec_id"].to_pylist(), dtype=np.int64)
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    distinct, where = np.unique(vectors, axis=0, return_inverse=True)
    where = where.ravel()
    by = np.argsort(where, kind="stable")
    lists = np.split(ids[by], np.flatnonzero(np.diff(where[by])) + 1)
    graph = Graph(distinct).neighbours
    return pa.table(
        {
            "dim": pa.array([rows["dim"][0].as_py()], type=pa.int32()),
            "shard": pa.array([rows["shard"][0].as_py()], type=pa.int32()),
            "vectors": pa.array([distinct.tobytes()], type=pa.binary()),
            "graph": pa.array([graph.tobytes()], type=pa.binary()),
            "ids": pa.array([[x.tolist() for x in lists]], type=pa.list_(pa.list_(pa.int64()))),
        }
    )


_FOUND_TYPE = "query_id long, vec_id long, score double"
#: Columns of a task's rows: a shard has its parts, a query its id and vector.
_ROW = ["dim", "shard", "block", "query_id", "x", "vectors", "graph", "ids"]


def _search_shards(batches: Iterator[pa.RecordBatch], k: int, width: int) -> Iterator[pa.RecordBatch]:
    """The best ``k`` of each shard for each of its queries, of rows sorted by shard, in which a shard comes before its queries.

    One shard is held at a time; its queries stream past it.
    """
    at, ids, graph = None, [], None
    for batch in batches:
        place = list(zip(*(batch[c].to_pylist() for c in ("dim", "shard", "block"))))
        asks = batch["query_id"].is_valid().to_pylist()
        first = 0
        while first < batch.num_rows:
            if not asks[first]:
                at = place[first]
                vectors = np.frombuffer(batch["vectors"][first].as_py()).reshape(-1, at[0])
                near = np.frombuffer(batch["graph"][first].as_py(), dtype=np.int32).reshape(len(vectors) + 1, -1)
                ids, graph = batch["ids"][first].as_py(), Graph(vectors, near)
                first += 1
                continue
            last = first
            while last < batch.num_rows and asks[last] and place[last] == place[first]:
                last += 1
            if place[first] == at:  # a length that only queries have has no shard
                out: list[tuple[int, int, float]] = []
                some = batch.slice(first, last - first)
                q = _matrix(some["x"])
                for query, x, nodes in zip(some["query_id"].to_pylist(), q, graph.search(q, width)):
                    nodes = nodes[nodes >= 0]
                    score = vectors[nodes] @ x
                    # One more than k of a node's ids suffice, since only the query's own is left out.
                    mine = [(-s, i) for s, node in zip(score.tolist(), nodes.tolist()) for i in ids[node][: k + 1] if i != query]
                    out += [(query, i, -s) for s, i in sorted(mine)[:k]]
                columns = zip(*out) if out else ([], [], [])
                kinds = (pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=["query_id", "vec_id", "score"])
            first = last


def usable(x: Column) -> Column:
    """Whether a vector takes part."""
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.coalesce(~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def search(
    vectors: DataFrame, is_query: Column, k: int = 20, width: int = BEAM, id_col: str = "vec_id",
    vector_col: str = "embedding", shard_nodes: int = SHARD_NODES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's nearest rows by inner product."""
    ship_package(vectors.sparkSession)
    width = max(width, BEAM_A_RESULT * k)
    rows = vectors.select(
        vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("x"), is_query.alias("asks")
    )
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("x"))).withColumn("dim", F.size("x"))
    shards = max(1, -(-vectors.count() // shard_nodes))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    index = materialise(
        dealt.select("dim", "shard", "vec_id", "x").groupBy("dim", "shard").applyInArrow(_build_shard, _SHARD_TYPE), "graph"
    )
    queries = rows.where("asks").groupBy("vec_id", "dim").agg(F.min("x").alias("x")).withColumnRenamed("vec_id", "query_id")
    blocks = max(1, -(-rows.where("asks").count() // QUERIES_A_TASK))
    asked = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    asked = asked.withColumns({"asks": F.lit(True), "block": F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)).cast("int")})
    held = index.withColumns({"asks": F.lit(False), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
    by = ["dim", "shard", "block"]
    dealt = asked.unionByName(held, allowMissingColumns=True).repartition(shards * blocks, *by).sortWithinPartitions(*by, "asks")
    best = dealt.select(*_ROW).mapInArrow(lambda it: _search_shards(it, k, width), _FOUND_TYPE)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id")))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, F.coalesce(F.col("vec_id") % 20 == 0, F.lit(False)))


QUERIES = {"op10_graph_search": op10_graph_search}
ORACLE_SQL: dict[str, str] = {}
