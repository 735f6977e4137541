"""Operator 9: approximate nearest neighbours by cosine with a robust-pruned directed graph in each shard.

Equal vectors become one node with its least ids, as many as a result can need, so copies cost nothing. Nodes are dealt to shards of SHARD_BYTES
by a hash. A shard's graph is built in one task: points enter in batches, a greedy beam search over the graph so far
proposes neighbours, and pruning keeps the nearest ones that no kept neighbour is clearly nearer to (relaxed by ALPHA), so edges
stay diverse; reverse edges are pruned likewise. Queries come to every shard in blocks of bounded size and search by beam.
Scores are cosines of the original vectors in double precision.

Rows whose vector is null, zero, or has null or non-finite components take no part. Vectors of different lengths are no candidates
of each other. Rows with the same id and vector count once. Ties go to the smaller id. Fewer candidates give fewer rows; an
empty table gives none. Null ids are neither queries nor candidates. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stored

#: Bytes of a shard's vectors, and queries that search a shard in one task; a query has the size of a node.
SHARD_BYTES, BLOCK_ROWS = 16 << 20, 1 << 16
DEGREE, BEAM, ALPHA, BATCH = 32, 64, 1.2, 256
ENTRIES = 8


class Graph:
    """Over unit float32 vectors; edges has a row of node numbers for each node, padded with -1."""

    def __init__(self, x: np.ndarray, edges: np.ndarray | None = None):
        self.x = x
        step = max(1, len(x) // ENTRIES)
        self.entries = np.arange(0, len(x), step)[:ENTRIES]
        if edges is not None:
            self.edges = edges
            return
        self.edges = np.full((len(x), 2 * DEGREE), -1, np.int32)
        self.degree = np.zeros(len(x), np.int64)
        order = np.concatenate([self.entries, np.setdiff1d(np.random.default_rng(len(x)).permutation(len(x)), self.entries, assume_unique=False)])
        rest = np.setdiff1d(order, self.entries)
        np.random.default_rng(1).shuffle(rest)
        k = len(self.entries)
        for e in self.entries:
            self._set(e, self.entries[self.entries != e])
        for size in [*(2**i for i in range(3, 30))]:
            for at in range(0, len(rest), BATCH) if size > BATCH else ():
                self._insert(rest[at : at + BATCH])
            if size > BATCH:
                break
            self._insert(rest[:size])
            rest, k = rest[size:], k + size
        over = np.flatnonzero(self.degree > DEGREE)
        self._prune(over, [self.edges[o, : self.degree[o]] for o in over])
        self.edges = self.edges[:, :DEGREE]

    def _set(self, node: int, to: np.ndarray) -> None:
        self.edges[node] = -1
        self.edges[node, : len(to)] = to
        self.degree[node] = len(to)

    def search(self, q: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all rows of q at once: node numbers, nearest first and -1 at the end, and their distances 1 - cosine."""
        n, rows = len(self.x), np.arange(len(q))[:, None]
        ids = np.full((len(q), beam), -1, np.int64)
        dist = np.full((len(q), beam), np.inf, np.float32)
        done = np.ones((len(q), beam), bool)
        seen = np.zeros((len(q), n + 1), bool)
        m = min(beam, len(self.entries))
        ids[:, :m], done[:, :m] = self.entries[:m], False
        dist[:, :m] = 1 - q @ self.x[self.entries[:m]].T
        seen[:, self.entries] = True
        seen[:, n] = True
        active = np.arange(len(q))
        while len(active):
            open_dist = np.where(done[active], np.inf, dist[active])
            best = open_dist.argmin(axis=1)
            going = np.isfinite(open_dist[np.arange(len(active)), best])
            active, best = active[going], best[going]
            if not len(active):
                break
            done[active, best] = True
            to = self.edges[ids[active, best]].astype(np.int64)
            to[to < 0] = n
            fresh = ~seen[active[:, None], to]
            seen[active[:, None], to] = True
            d = 1 - np.einsum("ijk,ik->ij", self.x[np.minimum(to, n - 1)], q[active])
            d[~fresh] = np.inf
            all_d = np.concatenate([dist[active], d], 1)
            keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            r = rows[: len(active)]
            dist[active] = all_d[r, keep]
            ids[active] = np.concatenate([ids[active], to], 1)[r, keep]
            done[active] = np.concatenate([done[active], ~fresh], 1)[r, keep]
        order = np.argsort(dist, axis=1, kind="stable")
        ids, dist = ids[rows, order], dist[rows, order]
        ids[~np.isfinite(dist)] = -1
        return ids, dist

    def _prune(self, nodes: np.ndarray, candidates: list[np.ndarray]) -> None:
        """Set each node's edges to a diverse choice of its candidates."""
        for at in range(0, len(nodes), BATCH):
            own, lists = nodes[at : at + BATCH], candidates[at : at + BATCH]
            c = np.full((len(own), max(map(len, lists))), -1, np.int64)
            for k, found in enumerate(lists):
                c[k, : len(found)] = found
            v = self.x[c]
            dist = 1 - np.einsum("ijk,ik->ij", v, self.x[own])
            dist[(c < 0) | (c == own[:, None])] = np.inf
            r, chosen = np.arange(len(own)), []
            for _ in range(DEGREE):
                best = dist.argmin(axis=1)
                ok = np.isfinite(dist[r, best])
                if not ok.any():
                    break
                chosen.append(np.where(ok, c[r, best], -1))
                between = 1 - np.einsum("ijk,ik->ij", v, v[r, best])
                dist[(ALPHA * between <= dist) & ok[:, None]] = np.inf
                dist[r, best] = np.inf
            picked = np.array(chosen, np.int64).T.reshape(len(own), -1)
            for k, node in enumerate(own):
                self._set(node, picked[k][picked[k] >= 0])

    def _insert(self, batch: np.ndarray) -> None:
        if not len(batch):
            return
        ids, _ = self.search(self.x[batch])
        # points of a batch don't see each other in the graph, so they are compared here
        near = np.argsort(-(self.x[batch] @ self.x[batch].T), axis=1, kind="stable")[:, 1 : 1 + DEGREE // 2]
        self._prune(batch, [np.unique(np.concatenate([row[row >= 0], batch[own]])) for row, own in zip(ids, near, strict=True)])
        source = np.repeat(batch, self.degree[batch])
        target = np.concatenate([self.edges[b, : self.degree[b]] for b in batch])
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        full_nodes, full_lists = [], []
        nodes, first = np.unique(target, return_index=True)
        for node, new in zip(nodes, np.split(source, first[1:]), strict=True):
            now = self.edges[node, : self.degree[node]]
            new = np.setdiff1d(new, now)
            if len(now) + len(new) > 2 * DEGREE:
                full_nodes.append(node)
                full_lists.append(np.concatenate([now, new]))
            else:
                self.edges[node, len(now) : len(now) + len(new)] = new
                self.degree[node] += len(new)
        if full_nodes:
            self._prune(np.array(full_nodes), full_lists)


def unit(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def build(rows: pd.DataFrame) -> pd.DataFrame:
    """The graph of a shard: a row for each node, with its edges."""
    rows = rows.sort_values("first", kind="stable").reset_index(drop=True)
    g = Graph(unit(np.stack(rows["v"].to_numpy())))
    return rows.assign(node=np.arange(len(rows)), edges=[e[e >= 0].tolist() for e in g.edges])[["shard", "node", "ids", "v", "edges"]]


def searcher(k: int):
    def search(graph: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(graph) or not len(queries):
            return pd.DataFrame({"query": [], "ids": [], "score": []})
        graph = graph.sort_values("node", kind="stable")
        v, q = np.stack(graph["v"].to_numpy()), np.stack(queries["v"].to_numpy())
        edges = np.full((len(v), DEGREE), -1, np.int32)
        for row, to in zip(edges, graph["edges"], strict=True):
            row[: len(to)] = to
        g = Graph(unit(v), edges)
        norms, ids, query = np.linalg.norm(v, axis=1), graph["ids"].to_numpy(), queries["query"].to_numpy()
        out: list[tuple] = []
        for at in range(0, len(q), BATCH):
            part = q[at : at + BATCH]
            found, _ = g.search(unit(part))
            for j, row in enumerate(found):
                row = row[row >= 0]
                score = (v[row] @ part[j]) / (norms[row] * np.linalg.norm(part[j]))
                order = np.argsort(-score, kind="stable")
                if len(order) > k + 1:  # ties with the last one stay
                    order = order[score[order] >= score[order[k]]]
                out += [(query[at + j], ids[row[o]].tolist(), float(score[o])) for o in order]
        return pd.DataFrame(out, columns=["query", "ids", "score"])

    return search


def nearest(df: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k nearest rows found for each row for which the column queries is true."""
    small_batches(df.sparkSession)
    v = F.col(vector_col).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.filter(sound & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    # the k + 1 least ids of each vector: a query needs k others at most
    least = rows.withColumn("turn", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("turn") <= k + 1)
    nodes = stored(least.groupBy("v").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("first", F.col("ids")[0]), "vectors")
    asked = stored(rows.filter("asks").select("id", "v").distinct().withColumn("query", F.xxhash64("id", "v")), "queries")
    # as few shards and blocks as memory allows: every query comes to every shard, and every shard to every block
    n, size = nodes.agg(F.count("*"), F.max(F.size("v"))).first()
    m = asked.count()
    shards, blocks = max(1, -(-n * 8 * (size or 1) // SHARD_BYTES)), max(1, -(-m // BLOCK_ROWS))
    deal = F.pmod(F.xxhash64("v"), F.lit(shards)) * 100_000 + F.size("v")  # vectors of one length
    # the number of tasks is bounded, not what they do
    graph = nodes.withColumn("shard", deal).repartition(min(4 * shards, 4096), "shard").groupBy("shard").applyInPandas(build, "shard long, node long, ids array<long>, v array<double>, edges array<int>")
    graph = stored(graph, "graph")
    every = graph.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")) if blocks > 1 else graph.withColumn("block", F.lit(0))
    # each query goes to the shards of its length; the shards are few beside the rows
    to_shards = asked.select("query", "v", F.pmod("query", F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"))
    to_shards = to_shards.select("query", "v", "block", (F.col("s").cast("long") * 100_000 + F.size("v")).alias("shard"))
    parts = min(4 * shards * blocks, 4096)
    found = every.repartition(parts, "shard", "block").groupBy("shard", "block").cogroup(to_shards.repartition(parts, "shard", "block").groupBy("shard", "block")).applyInPandas(searcher(k), "query long, ids array<long>, score double")
    pairs = found.join(asked.select("query", F.col("id").alias("query_id")), "query").select("query_id", "query", "score", F.explode("ids").alias("id")).filter("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return pairs.select("query_id", rank.alias("rank"), F.col("id").alias(id_col), "score").filter(F.col("rank") <= k)
