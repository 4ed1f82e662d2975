"""Hybrid retriever: BM25 over texts, dense search over image vectors, merged by reciprocal rank."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exact, graph, lexical
from .fusion import reciprocal_rank_fusion


@dataclass
class HybridRetriever:
    """``documents`` (doc_id, doc_key, text) and ``vectors`` (id, embedding), both numbered alike: id = doc_id.

    ``use_dense`` gates the dense list (it is no weight). Each retriever fetches k before the merge."""

    documents: DataFrame
    vectors: DataFrame | None = None
    use_dense: bool = False
    use_graph: bool = False
    k1: float = 1.2
    b: float = 0.75
    ef: int = 64
    rrf_k: float = 60.0
    _index: lexical.TextIndex | None = field(default=None, repr=False)
    _graph: DataFrame | None = field(default=None, repr=False)

    def check(self) -> HybridRetriever:
        """Itself; an error unless there are as many vectors as documents and every vector's id is a document's, since an
        unmatched one could never be named."""
        docs = self.documents.filter("doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
        if self.vectors is not None:
            n, m = docs.count(), self.vectors.select("id").distinct().count()
            if n != m or self.vectors.join(docs, "id", "left_anti").head(1):
                raise ValueError(f"{m} vectors do not match {n} documents")
        elif self.use_dense or self.use_graph:
            raise ValueError("the retriever has no vectors")
        return self

    def index(self) -> lexical.TextIndex:
        self._index = self._index or lexical.written_index(self.documents)
        return self._index

    def search_text_only(self, queries: DataFrame, k: int = 10) -> DataFrame:
        return self._keyed(lexical.bm25_topk(self.index(), queries, k, self.k1, self.b))

    def _dense(self, queries: DataFrame, k: int) -> DataFrame:
        q = queries.select("query_id", "embedding").filter("embedding is not null")
        if self.use_graph:
            self._graph = self._graph if self._graph is not None else graph.build_graph(self.vectors)
            return graph.search_graph(self._graph, q, k, self.ef)
        return exact.exact_knn(q, self.vectors, k)

    def search_image_only(self, queries: DataFrame, k: int = 10) -> DataFrame:
        if self.vectors is None:
            raise ValueError("the retriever has no vectors")
        return self._keyed(self._dense(queries, k))

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, rank, id, doc_key) for queries (query_id, text[, embedding])."""
        text = lexical.bm25_topk(self.index(), queries, k, self.k1, self.b)
        if not self.use_dense or self.vectors is None or "embedding" not in queries.columns:
            return self._keyed(text)
        return self._keyed(reciprocal_rank_fusion([text, self._dense(queries, k)], k, self.rrf_k))

    def _keyed(self, ranked: DataFrame) -> DataFrame:
        keys = self.documents.filter("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min("doc_key").alias("doc_key"))
        return ranked.join(keys, "id").select("query_id", "rank", "id", "doc_key")

    def stats(self) -> DataFrame:
        """One row (bytes, vocab_size, doc_count)."""
        return lexical.index_bytes(self.index())
