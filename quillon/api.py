"""Index objects over DataFrames: the operators with their state, saved and loaded as snapshots.

Vectors are (id, embedding), queries (query_id, embedding) or (query_id, text); every search returns
(query_id, id, dist, rank), smaller distances first.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import exact, graph, lexical, pq
from .operators.fusion import reciprocal_rank_fusion
from .operators.retriever import HybridRetriever
from .plans import snapshot
from .plans.schema import DimensionError, dimension

__all__ = ["Bm25Index", "FlatIndex", "GraphIndex", "HybridRetriever", "PqIndex", "reciprocal_rank_fusion"]


class FlatIndex:
    """Exact search."""

    def __init__(self, vectors: DataFrame, metric: str = "l2"):
        self.vectors, self.metric, self.dim = vectors, metric, dimension(vectors)

    def size(self) -> int:
        return self.vectors.filter("embedding is not null").count()

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return exact.exact_knn(queries, self.vectors, k, self.metric, self.dim)

    search_batch = search


class GraphIndex:
    """Approximate search over sharded graphs. ``add`` builds further shards; nothing that exists is changed."""

    def __init__(self, vectors: DataFrame | None, m: int = 16, ef_construction: int = 200, seed: int = 42, shard_rows: int = 50_000, keep_pruned: bool = True, extend: bool = False, *, tables: DataFrame | None = None, dim: int | None = None):
        self.m, self.ef_construction, self.seed, self.shard_rows = m, ef_construction, seed, shard_rows
        self.keep_pruned, self.extend = keep_pruned, extend
        self.graph = tables if tables is not None else graph.build_graph(vectors, m, ef_construction, seed, shard_rows, keep_pruned=keep_pruned, extend=extend)
        self.dim = dim if dim is not None else dimension(vectors)

    def search(self, queries: DataFrame, k: int = 10, ef: int = 64) -> DataFrame:
        return graph.search_graph(self.graph, queries, k, ef)

    search_batch = search

    def add(self, vectors: DataFrame) -> GraphIndex:
        """A new index that also holds ``vectors``; ids that are there already are an error."""
        d = dimension(vectors)
        if self.dim and d and d != self.dim:
            raise DimensionError(f"the index has {self.dim} components, the vectors {d}")
        if vectors.join(self.graph.select("id"), "id", "left_semi").head(1):
            raise ValueError("some ids are in the index already")
        first = (self.graph.agg(F.max("shard")).first()[0] or 0) + 1
        more = graph.build_graph(vectors, self.m, self.ef_construction, self.seed, self.shard_rows, keep_pruned=self.keep_pruned, extend=self.extend).withColumn("shard", F.col("shard") + first)
        return GraphIndex(None, self.m, self.ef_construction, self.seed, self.shard_rows, self.keep_pruned, self.extend, tables=self.graph.unionByName(more), dim=self.dim or d)

    def stats(self) -> DataFrame:
        return graph.graph_stats(self.graph)

    def check_invariants(self) -> DataFrame:
        return graph.check_invariants(self.graph, self.m)

    def save(self, root: str) -> int:
        return snapshot.save({"graph": self.graph}, root, "graph", self.dim, {"m": self.m, "ef_construction": self.ef_construction, "seed": self.seed, "shard_rows": self.shard_rows, "keep_pruned": self.keep_pruned, "extend": self.extend})

    @classmethod
    def load(cls, spark: SparkSession, root: str, version: int | None = None) -> GraphIndex:
        """The saved index with its vectors; a graph that breaks an invariant is refused."""
        tables, manifest = snapshot.load(spark, root, "graph", version)
        index = cls(None, **manifest["params"], tables=tables["graph"], dim=manifest["dim"])
        if index.check_invariants().head(1):
            raise snapshot.SnapshotError(f"the graph of {root} breaks its invariants")
        return index


class PqIndex:
    """Quantized search. Saved without vectors; reranking then needs them handed over."""

    def __init__(self, vectors: DataFrame | None, m: int = 8, train_size: int = 100_000, iters: int = 25, seed: int = 42, n_init: int = 3, *, book: pq.Codebook | None = None, codes: DataFrame | None = None):
        self.vectors = vectors
        self.book = book or pq.train(vectors, dimension(vectors), m, train_size, iters, seed, n_init)
        self.codes = codes if codes is not None else pq.encode(vectors, self.book)

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return pq.adc_topk(queries, self.codes, self.book, k)

    def _need(self) -> DataFrame:
        if self.vectors is None:
            raise ValueError("the index was loaded without vectors")
        return self.vectors

    def search_rerank(self, queries: DataFrame, k: int = 10, candidates: int = 100) -> DataFrame:
        return pq.search_rerank(queries, self.codes, self._need(), self.book, k, candidates)

    def reconstruction_error(self) -> DataFrame:
        return pq.reconstruction_error(self._need(), self.codes, self.book)

    def footprint(self) -> DataFrame:
        return pq.footprint(self.codes, self.book)

    def save(self, root: str) -> int:
        spark = self.codes.sparkSession
        rows = [(s, c, [float(x) for x in v]) for s, part in enumerate(self.book.parts) for c, v in enumerate(part)]
        book = spark.createDataFrame(rows, "sub int, code int, centroid array<double>")
        return snapshot.save({"codes": self.codes, "codebook": book}, root, "pq", self.book.dim, {"reseeds": self.book.reseeds})

    @classmethod
    def load(cls, spark: SparkSession, root: str, vectors: DataFrame | None = None, version: int | None = None) -> PqIndex:
        tables, manifest = snapshot.load(spark, root, "pq", version)
        rows = tables["codebook"].orderBy("sub", "code").collect()  # at most 256 rows a subspace
        parts: dict[int, list] = {}
        for r in rows:
            parts.setdefault(r["sub"], []).append(r["centroid"])
        book = pq.Codebook([np.array(parts[s]) for s in sorted(parts)], manifest["params"].get("reseeds", 0)) if parts else None
        if book is None or book.dim != manifest["dim"]:
            raise snapshot.SnapshotError(f"the codebook of {root} has not {manifest['dim']} components")
        if tables["codes"].filter(F.size("code") != book.m).head(1):
            raise snapshot.SnapshotError(f"{root} has codes of another length than {book.m}")
        return cls(vectors, book=book, codes=tables["codes"])


class Bm25Index:
    """Ranked text search over (doc_id, text)."""

    def __init__(self, documents: DataFrame, k1: float = 1.2, b: float = 0.75):
        self.index, self.k1, self.b = lexical.written_index(documents), k1, b

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return lexical.bm25_topk(self.index, queries, k, self.k1, self.b)

    def score(self, queries: DataFrame) -> DataFrame:
        return lexical.bm25_scores(self.index, queries, self.k1, self.b)

    def idf(self) -> DataFrame:
        return lexical.bm25_idf(self.index)

    def stats(self) -> DataFrame:
        """One row (bytes, vocab_size, doc_count)."""
        return lexical.index_bytes(self.index)
