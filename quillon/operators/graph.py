"""Approximate search over sharded hierarchical proximity graphs.

Each shard is one small-world graph, built in one task in id order; its levels come from ``draws.graph_level``, so
they are the same everywhere. A search walks every shard and merges the lists by (dist, id). With one shard the
graph is a single one; with more, each holds about n / shards vectors and is searched with the full beam.
"""

from __future__ import annotations

import heapq
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import graph_level
from .topk import topk_per

SHARD_ROWS = "shard int, id long, level int, embedding array<float>, links array<array<long>>"


class ShardGraph:
    """One graph in memory: local numbers, links by layer; ties in distance go to the smaller number (= id order)."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, m: int, ef_construction: int, keep_pruned: bool = True, extend: bool = False):
        self.x, self.levels, self.m, self.efc = np.asarray(x, np.float64), levels, m, ef_construction
        self.keep_pruned, self.extend = keep_pruned, extend
        self.links: list[list[list[int]]] = [[[] for _ in range(int(v) + 1)] for v in levels]
        self.entry, self.top, self.calls = -1, -1, 0

    def dist(self, q: np.ndarray, ids: list[int]) -> np.ndarray:
        self.calls += len(ids)
        diff = self.x[ids] - q
        return np.einsum("ij,ij->i", diff, diff)

    def beam(self, q: np.ndarray, starts: list[int], ef: int, layer: int) -> list[tuple[float, int]]:
        """The ef nearest reached from ``starts``, nearest first."""
        seen = set(starts)
        first = list(zip(self.dist(q, starts).tolist(), starts))
        open_ = list(first)
        heapq.heapify(open_)
        kept = [(-d, -i) for d, i in first]
        heapq.heapify(kept)
        while len(kept) > ef:
            heapq.heappop(kept)
        while open_:
            d, i = heapq.heappop(open_)
            if len(kept) >= ef and d > -kept[0][0]:
                break
            fresh = [j for j in self.links[i][layer] if j not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for dj, j in zip(self.dist(q, fresh).tolist(), fresh):
                if len(kept) < ef or (dj, j) < (-kept[0][0], -kept[0][1]):
                    heapq.heappush(open_, (dj, j))
                    heapq.heappush(kept, (-dj, -j))
                    if len(kept) > ef:
                        heapq.heappop(kept)
        return sorted((-d, -i) for d, i in kept)

    def select(self, base: int, cands: list[tuple[float, int]], most: int, layer: int) -> list[int]:
        """Diverse neighbours: one is kept if it is no nearer to a kept one than to the base."""
        if self.extend:
            have = {i for _, i in cands} | {base}
            more = sorted({j for _, i in cands for j in self.links[i][layer]} - have)
            if more:
                cands = sorted(cands + list(zip(self.dist(self.x[base], more).tolist(), more)))
        kept: list[int] = []
        pruned: list[int] = []
        for d, i in cands:
            if len(kept) >= most:
                break
            if i == base:
                continue
            if kept and (self.dist(self.x[i], kept) < d).any():
                pruned.append(i)
            else:
                kept.append(i)
        return kept + pruned[: most - len(kept)] if self.keep_pruned else kept

    def insert(self, i: int) -> None:
        level = int(self.levels[i])
        if self.entry < 0:
            self.entry, self.top = i, level
            return
        at = [self.entry]
        for layer in range(self.top, level, -1):
            at = [self.beam(self.x[i], at, 1, layer)[0][1]]
        for layer in range(min(level, self.top), -1, -1):
            found = self.beam(self.x[i], at, self.efc, layer)
            chosen = self.select(i, found, self.m, layer)
            self.links[i][layer] = list(chosen)
            cap = 2 * self.m if layer == 0 else self.m
            for j in chosen:
                back = self.links[j][layer]
                back.append(i)
                if len(back) > cap:
                    ranked = sorted(zip(self.dist(self.x[j], back).tolist(), back))
                    self.links[j][layer] = self.select(j, ranked, cap, layer)
            at = [k for _, k in found]
        if level > self.top:
            self.entry, self.top = i, level

    def build(self) -> ShardGraph:
        for i in range(len(self.x)):
            self.insert(i)
        return self

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        at = [self.entry]
        for layer in range(self.top, 0, -1):
            at = [self.beam(q, at, 1, layer)[0][1]]
        return self.beam(q, at, max(ef, k), 0)[:k]


def _floats(column: pa.ChunkedArray) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(a), -1)


def build_graph(vectors: DataFrame, m: int = 16, ef_construction: int = 200, seed: int = 42, shard_rows: int = 50_000, shards: int | None = None, keep_pruned: bool = True, extend: bool = False) -> DataFrame:
    """SHARD_ROWS: every vector with its shard, level and links by layer (ids). The number of shards follows the
    number of vectors, ``shard_rows`` each, unless given. m below 2 is an error; null vectors are left out."""
    if m < 2:
        raise ValueError("m must be at least 2")
    rows = vectors.filter("id is not null and embedding is not null")
    shards = shards or max(1, -(-rows.count() // shard_rows))
    rows = rows.select(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(shards)).cast("int").alias("shard"), "id", graph_level(F.col("id"), m, seed).alias("level"), "embedding")

    def of(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids, levels = t.column("id").to_numpy(), t.column("level").to_numpy()
        g = ShardGraph(_floats(t.column("embedding")), levels, m, ef_construction, keep_pruned, extend).build()
        links = [[[int(ids[j]) for j in layer] for layer in node] for node in g.links]
        return pa.table([t.column("shard"), t.column("id"), t.column("level"), t.column("embedding"), pa.array(links, pa.list_(pa.list_(pa.int64())))], ["shard", "id", "level", "embedding", "links"])

    return rows.groupBy("shard").applyInArrow(of, SHARD_ROWS)


def search_graph(graph: DataFrame, queries: DataFrame, k: int = 10, ef: int = 64, query_chunk: int = 5_000, digits: int = 9) -> DataFrame:
    """(query_id, id, dist, rank, distance_calls). Each chunk of queries meets each shard in one task; ``distance_calls`` are
    those of the query over all shards."""
    chunks = max(1, -(-queries.count() // query_chunk))
    shards = graph.select(F.col("shard").alias("at")).distinct()
    asked = queries.filter("embedding is not null").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int"))
    asked = asked.join(F.broadcast(shards)).select("at", "part", "query_id", F.col("embedding").alias("asked"))  # one row a shard
    held = graph.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def of(g: pa.Table, q: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        if g.num_rows and q.num_rows:
            g = g.sort_by("id")
            ids, levels = g.column("id").to_numpy(), g.column("level").to_numpy()
            s = ShardGraph(_floats(g.column("embedding")), levels, 2, 1)
            number = {int(i): n for n, i in enumerate(ids)}
            s.links = [[[number[j] for j in layer] for layer in node] for node in g.column("links").to_pylist()]
            s.top = int(levels.max())
            s.entry = int(np.flatnonzero(levels == s.top)[0])
            for qid, v in zip(q.column("query_id").to_pylist(), _floats(q.column("asked"))):
                s.calls = 0
                got = s.search(v, k, ef)
                for nth, (d, i) in enumerate(got):
                    for a, x in zip(out, (qid, int(ids[i]), round(d, digits), 0 if nth else s.calls)):  # once a shard
                        a.append(x)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.int64())], ["query_id", "id", "dist", "distance_calls"])

    got = held.groupBy("shard", "chunk").cogroup(asked.groupBy("at", "part")).applyInArrow(of, "query_id long, id long, dist double, distance_calls long")
    total = F.sum("distance_calls").over(Window.partitionBy("query_id"))  # at most k rows a shard
    return topk_per(got.withColumn("distance_calls", total), k)


def edges(graph: DataFrame) -> DataFrame:
    """(shard, layer, src, dst): one row a link."""
    layers = graph.select("shard", F.col("id").alias("src"), F.posexplode("links").alias("layer", "to"))
    return layers.select("shard", "layer", "src", F.explode("to").alias("dst"))


def level_histogram(graph: DataFrame) -> DataFrame:
    """(level, nodes): nodes that reach each level."""
    return graph.select(F.explode(F.sequence(F.lit(0), F.col("level"))).alias("level")).groupBy("level").agg(F.count("*").alias("nodes"))


def graph_stats(graph: DataFrame) -> DataFrame:
    """One row (nodes, max_level, mean_degree, links, graph_bytes)."""
    total = F.aggregate("links", F.lit(0), lambda s, layer: s + F.size(layer))
    return graph.agg(F.count("*").alias("nodes"), F.coalesce(F.max("level"), F.lit(-1)).alias("max_level"), F.round(F.coalesce(F.avg(F.size(F.get("links", F.lit(0)))), F.lit(0.0)), 6).alias("mean_degree"), F.coalesce(F.sum(total), F.lit(0)).alias("links"), F.coalesce(F.sum(4 * total + 4 * F.size("links")), F.lit(0)).alias("graph_bytes"))


def check_invariants(graph: DataFrame, m: int) -> DataFrame:
    """(violation, n) of each kind that occurs; no rows for a sound graph."""
    e = edges(graph)
    by = ["shard", "layer", "src"]
    degree = e.groupBy(*by).count().filter(F.col("count") > F.when(F.col("layer") == 0, 2 * m).otherwise(m)).select(F.lit("degree above its cap").alias("violation"))
    loops = e.filter("src = dst").select(F.lit("link to itself").alias("violation"))
    twice = e.groupBy(*by, "dst").count().filter("count > 1").select(F.lit("link held twice").alias("violation"))
    nodes = graph.select("shard", F.col("id").alias("dst"), "level")
    low = e.join(nodes, ["shard", "dst"], "left").filter("level is null or level < layer").select(F.lit("neighbour below the layer").alias("violation"))
    return degree.unionByName(loops).unionByName(twice).unionByName(low).groupBy("violation").agg(F.count("*").alias("n"))


def neighbor_heuristic(vectors: DataFrame, base_id: int, m: int, keep_pruned: bool = True) -> DataFrame:
    """(id, place): the diverse neighbours that a node would link to, of all other vectors as candidates: in order of
    (distance, id) one is kept if no kept one is nearer to it than the node is; with ``keep_pruned`` the nearest of the others
    fill up to ``m``. For the candidates of one node, some thousand vectors."""
    t = vectors.filter("id is not null and embedding is not null").select("id", "embedding").toArrow().sort_by("id")
    ids = t.column("id").to_numpy()
    g = ShardGraph(_floats(t.column("embedding")), np.zeros(len(ids), np.int64), m, 1, keep_pruned)
    at = int(np.flatnonzero(ids == base_id)[0])
    cands = sorted((d, i) for i, d in enumerate(g.dist(g.x[at], list(range(len(ids)))).tolist()) if i != at)
    rows = [(int(ids[i]), n + 1) for n, i in enumerate(g.select(at, cands, m, 0))]
    return vectors.sparkSession.createDataFrame(rows, "id long, place int")
