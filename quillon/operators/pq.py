"""Product quantization: codebooks of subspaces, codes, table-driven scans and exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import l2_sq
from .kmeans import bounded_sample, np_distances, train_local
from .topk import topk_per

CENTROIDS = 256


@dataclass
class Codebook:
    """m arrays of at most 256 centroids, each of dim / m components; only trained centroids are held."""

    parts: list[np.ndarray]
    reseeds: int = 0

    @property
    def m(self) -> int:
        return len(self.parts)

    @property
    def dim(self) -> int:
        return self.m * self.parts[0].shape[1]

    def split(self, x: np.ndarray) -> np.ndarray:
        return x.reshape(len(x), self.m, -1)


def _check(dim: int, m: int) -> None:
    if m <= 0 or dim % m:
        raise ValueError(f"{dim} components can't be cut into {m} equal subspaces")


def first_vectors_codebook(vectors: DataFrame, dim: int, m: int, k: int = CENTROIDS) -> Codebook:
    """The subvectors of the k smallest ids as centroids: a codebook that any engine repeats."""
    _check(dim, m)
    rows = vectors.filter("embedding is not null").orderBy("id").limit(k).select("embedding").toArrow()  # k rows
    x = np.array(rows.column(0).to_pylist(), np.float64).reshape(-1, m, dim // m)
    return Codebook([x[:, s] for s in range(m)])


def train(vectors: DataFrame, dim: int, m: int = 8, train_size: int = 100_000, iters: int = 25, seed: int = 42, n_init: int = 3) -> Codebook:
    """One k-means a subspace on a sample of about ``train_size`` vectors, subspaces in parallel tasks."""
    _check(dim, m)
    spark = vectors.sparkSession
    x = bounded_sample(vectors, train_size, seed)
    if not len(x):
        raise ValueError("no vectors to train on")
    held = spark.sparkContext.broadcast(x.astype(np.float32))  # at most about train_size rows

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in b.column(0).to_pylist():
                got = train_local(held.value.reshape(len(held.value), m, -1)[:, s], CENTROIDS, iters, 1e-4, seed + s, n_init)
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([got["centroids"].ravel().tolist()], pa.list_(pa.float64())), pa.array([got["reseeds"]], pa.int64())], ["sub", "c", "reseeds"])

    got = spark.range(0, m, 1, m).mapInArrow(of, "sub long, c array<double>, reseeds long").orderBy("sub").collect()  # m rows
    return Codebook([np.array(r["c"]).reshape(-1, dim // m) for r in got], sum(r["reseeds"] for r in got))


def encode(vectors: DataFrame, book: Codebook, digits: int = 9) -> DataFrame:
    """(id, code): the nearest centroid of each subspace, ties to the lowest code; a null vector has no row."""
    held = vectors.sparkSession.sparkContext.broadcast(book)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bk = held.value
        for b in batches:
            if b.num_rows:
                x = bk.split(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1))
                codes = np.stack([np.round(np_distances(x[:, s], bk.parts[s]), digits).argmin(1) for s in range(bk.m)], axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array((np.arange(len(codes) + 1) * bk.m).astype(np.int32)), pa.array(codes.ravel().astype(np.int32)))], ["id", "code"])

    return vectors.filter("embedding is not null").select("id", "embedding").mapInArrow(of, "id long, code array<int>")


def _scan(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, code: np.ndarray, book: Codebook, k: int, digits: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The k best (query, id, distance) of each query over some codes."""
    split = book.split(q)
    order = np.argsort(ids, kind="stable")
    ids, code = ids[order], code[order]
    keep = min(k, len(ids))
    for s in range(0, len(q), 64):
        d = np.zeros((len(q[s : s + 64]), len(ids)))
        for j in range(book.m):
            d += np_distances(split[s : s + 64, j], book.parts[j])[:, code[:, j]]
        d = np.round(d, digits)
        r, c = np.nonzero(d <= np.partition(d, keep - 1, axis=1)[:, keep - 1 : keep])
        best = np.lexsort((c, d[r, c], r))
        r, c = r[best], c[best]
        good = np.arange(len(r)) - np.searchsorted(r, r) < keep
        yield q_ids[s + r[good]], ids[c[good]], d[r[good], c[good]]


def adc_topk(queries: DataFrame, codes: DataFrame, book: Codebook, k: int = 10, digits: int = 9, most_queries: int = 20_000, query_block: int = 2_048, code_block: int = 65_536) -> DataFrame:
    """(query_id, id, dist, rank) by summed table distances over all codes. Up to ``most_queries`` go to the codes, where
    each batch keeps k a query; more are met in blocks, a task for each pair of a query block and a code block."""
    spark = codes.sparkSession
    queries = queries.filter("embedding is not null").select("query_id", "embedding")
    out = "query_id long, id long, dist double"
    if k <= 0:
        return topk_per(spark.createDataFrame([], out), k)
    n = queries.count()
    names = ["query_id", "id", "dist"]
    if n <= most_queries:
        part = queries.toArrow()  # at most most_queries rows
        held = spark.sparkContext.broadcast((part.column("query_id").to_numpy(), np.array(part.column("embedding").to_pylist(), np.float64).reshape(n, book.dim), book))

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q_ids, q, bk = held.value
            for b in batches:
                if b.num_rows and len(q):
                    code = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                    for cols in _scan(q_ids, q, b.column(0).to_numpy(), code, bk, k, digits):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

        return topk_per(codes.select("id", "code").mapInArrow(of, out), k)
    shared = spark.sparkContext.broadcast(book)
    nq, nb = -(-n // query_block), max(1, -(-codes.count() // code_block))
    part_of = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(part_of("query_id", nq).alias("qb"), every(nb).alias("bb"), "query_id", "embedding")
    held_codes = codes.select(every(nq).alias("qb"), part_of("id", nb).alias("bb"), "id", "code")

    def pair(q: pa.Table, c: pa.Table) -> pa.Table:
        parts = []
        if q.num_rows and c.num_rows:
            x = q.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(q.num_rows, -1)
            code = c.column("code").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(c.num_rows, -1)
            parts = list(_scan(q.column("query_id").to_numpy(), x, c.column("id").to_numpy(), code, shared.value, k, digits))
        cols = [np.concatenate(x) for x in zip(*parts)] if parts else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table([pa.array(x) for x in cols], names)

    return topk_per(asked.groupBy("qb", "bb").cogroup(held_codes.groupBy("qb", "bb")).applyInArrow(pair, out), k)


def rerank_topk(queries: DataFrame, shortlist: DataFrame, vectors: DataFrame, k: int = 10, dim: int | None = None, digits: int = 9) -> DataFrame:
    """The shortlist (query_id, id) ranked again by exact distance."""
    q = queries.select("query_id", F.col("embedding").alias("q"))
    rows = shortlist.select("query_id", "id").join(vectors.select("id", "embedding"), "id").join(q, "query_id")
    return topk_per(rows.select("query_id", "id", F.round(l2_sq(F.col("q"), F.col("embedding"), dim), digits).alias("dist")), k)


def search_rerank(queries: DataFrame, codes: DataFrame, vectors: DataFrame, book: Codebook, k: int = 10, candidates: int = 100) -> DataFrame:
    return rerank_topk(queries, adc_topk(queries, codes, book, max(candidates, k)), vectors, k, book.dim)


def decode(codes: DataFrame, book: Codebook) -> DataFrame:
    """(id, decoded)."""
    table = F.array(*[F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in p]) for p in book.parts]) if book.m * len(book.parts[0]) <= 64 else None
    if table is not None:
        return codes.select("id", F.flatten(F.transform("code", lambda c, s: table[s][c])).alias("decoded"))
    held = codes.sparkSession.sparkContext.broadcast(book)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bk = held.value
        for b in batches:
            if b.num_rows:
                code = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
                x = np.concatenate([bk.parts[s][code[:, s]] for s in range(bk.m)], axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array((np.arange(len(x) + 1) * bk.dim).astype(np.int32)), pa.array(x.ravel()))], ["id", "decoded"])

    return codes.select("id", "code").mapInArrow(of, "id long, decoded array<double>")


def reconstruction_error(vectors: DataFrame, codes: DataFrame, book: Codebook) -> DataFrame:
    """One row (n, reconstruction_error): the squared error summed over components, averaged over vectors."""
    rows = vectors.select("id", "embedding").join(decode(codes, book), "id")
    err = F.aggregate(F.zip_with("embedding", "decoded", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return rows.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(err), F.lit(0.0)), 6).alias("reconstruction_error"))


def footprint(codes: DataFrame, book: Codebook) -> DataFrame:
    """One row (n_codes, code_bytes, codebook_bytes, bytes_per_vector, compression_ratio); the two byte counts are
    never added, the ratio comes from the quantizer's own dimension."""
    size = sum(p.size for p in book.parts) * 4
    n = codes.agg(F.count("*").alias("n_codes"))
    return n.select("n_codes", (F.col("n_codes") * book.m).alias("code_bytes"), F.lit(size).cast("long").alias("codebook_bytes"), F.lit(float(book.m)).alias("bytes_per_vector"), F.lit(4.0 * book.dim / book.m).alias("compression_ratio"))
