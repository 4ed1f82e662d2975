"""Most similar vectors for every vector, by balanced posting lists.

Centroids come from a bounded sample by balanced splits, which leave a tight ball whole. Every vector is stored in
its nearest list and, near a boundary, in a second one; as a query it scans all lists whose centroid is within a
distance ratio of its nearest centroid, two at least, found in the centroids' in-memory graph. A list that grew
beyond its bound is split by a tree of its own. Lists are scanned in blocks of bounded size, so neither a long list
nor a popular one ends up in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import written
from .balanced import CentroidGraph, balanced_centroids
from .packed import unpack, usable


def _copies(ids: DataFrame, keep: int) -> DataFrame:
    """(rep, v, n, near): each different vector with its ``keep`` smallest ids in order."""
    at = Window.partitionBy("v").orderBy("id")
    first = ids.withColumn("at", F.row_number().over(at)).filter(F.col("at") <= keep)
    return first.groupBy("v").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("near"))


ROWS = "list long, query boolean, rep long, v binary"


def _listed(graph: CentroidGraph, base: np.ndarray | int, query: np.ndarray | None, rep: pa.Array, v: pa.Array, dim: int, member_ratio: float, replicas: int, query_ratio: float, floor: int) -> pa.RecordBatch:
    """Rows of ROWS for vectors that take part as members and as queries (``query`` null), or as either."""
    r, c, d, least = graph.within(unpack(v, dim), max(query_ratio, member_ratio), max(floor, 2 if replicas > 1 else 1))
    nth = np.arange(len(r)) - np.searchsorted(r, r)
    stored = (nth < replicas) & (d <= least[r] * member_ratio**2)
    scans = (d <= least[r] * query_ratio**2) | (nth < floor)
    if query is not None:
        stored, scans = stored & ~query[r], scans & query[r]
    at = pa.array(np.r_[r[stored], r[scans]])
    asks = pa.array(np.r_[np.zeros(stored.sum(), bool), np.ones(scans.sum(), bool)])
    return pa.RecordBatch.from_arrays([pa.array(np.r_[c[stored], c[scans]] + base), asks, rep.take(at), v.take(at)], ["list", "query", "rep", "v"])


def list_rows(reps: DataFrame, graph: CentroidGraph, dim: int, member_ratio: float, replicas: int, query_ratio: float, floor: int) -> DataFrame:
    """ROWS: a row for each list a vector is stored in and for each list it scans."""
    held = reps.sparkSession.sparkContext.broadcast(graph)  # centroids: bounded by the sample

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 16_384):
                part = b.slice(s, 16_384)
                yield _listed(held.value, 0, None, part.column(0), part.column(1), dim, member_ratio, replicas, query_ratio, floor)

    return reps.select("rep", "v").mapInArrow(of, ROWS)


def split_lists(rows: DataFrame, dim: int, most: int, fit: int, target: int, member_ratio: float, replicas: int, query_ratio: float, floor: int, block: int = 32_768) -> DataFrame:
    """``rows`` with every list of more than ``most`` members split by a tree of its own, and again until none is
    longer: each is fitted on about ``fit`` of its members in one task, its members and queries then walk its graph."""
    done = None
    for _ in range(12):
        sizes = rows.groupBy("list").agg(F.count_if(~F.col("query")).alias("m"), F.count("*").alias("n"))
        over = written(sizes.filter(F.col("m") > most), "knn-over")  # at most members / most rows
        if not over.head(1):
            break
        stay = rows.join(over, "list", "left_anti")
        done = stay if done is None else done.unionByName(stay)
        rows = rows.join(over, "list")
        mark = F.pmod(F.xxhash64("rep", "list"), F.lit(1 << 30))

        def fitted(t: pa.Table) -> pa.Table:
            x = unpack(t.column("v"), dim)
            leaf = max(16, int(target * len(x) / t.column("m")[0].as_py()))
            c = balanced_centroids(x, leaf, ball=int(most * len(x) / t.column("m")[0].as_py() / 2))
            return pa.table([pa.array([t.column("list")[0].as_py()]), pa.array([c.tobytes()], pa.binary())], ["list", "c"])

        sample = rows.filter(~F.col("query") & (mark <= (F.lit(float(fit)) / F.col("m") * (1 << 30)).cast("long")))
        trees = sample.select("list", "v", "m").groupBy("list").applyInArrow(fitted, "list long, c binary")
        blocks = F.ceil(F.col("n") / block).cast("int")
        trees = trees.join(over, "list").select("list", "c", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
        parts = rows.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(5)), blocks).cast("int")).select("list", "block", "query", "rep", "v")

        def again(r: pa.Table, c: pa.Table) -> pa.Table:
            names = ["list", "query", "rep", "v"]
            if not r.num_rows or not c.num_rows:
                return r.select(names)
            graph = CentroidGraph(np.frombuffer(c.column("c")[0].as_py(), np.float32).reshape(-1, dim))
            base = (c.column("list")[0].as_py() + 1) * 1_048_576 & (1 << 62) - 1
            r = r.combine_chunks()
            return pa.Table.from_batches([_listed(graph, base, r.column("query").combine_chunks().to_numpy(zero_copy_only=False), r.column("rep").combine_chunks(), r.column("v").combine_chunks(), dim, member_ratio, replicas, query_ratio, floor)])

        rows = written(parts.groupBy("list", "block").cogroup(trees.groupBy("list", "block")).applyInArrow(again, ROWS).dropDuplicates(["list", "query", "rep"]), "knn-split")
    return rows if done is None else done.unionByName(rows)


def nearest(q_ids: np.ndarray, q: np.ndarray, m_ids: np.ndarray, m: np.ndarray, k: int, limit: float, lanes: int = 64, cells: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest members of each query by (distance, id), not itself, at most ``limit`` away, as rows.

    One product gives distances less the query's own square. The k-th least of the minima of column groups
    bounds the k-th least of all, so only few groups are looked at further; their distances are taken anew.
    """
    order = np.argsort(m_ids, kind="stable")
    m_ids, m = m_ids[order], m[order]
    n, groups = len(m), -(-len(m) // lanes)
    width = groups * lanes
    side = np.zeros((m.shape[1] + 1, width), np.float32)
    side[:-1, :n], side[-1, :n], side[-1, n:] = m.T, (m * m).sum(1), np.inf
    own = (q * q).sum(1)
    asked = np.c_[-2 * q, np.ones(len(q), np.float32)].astype(np.float32)
    self_at = np.minimum(np.searchsorted(m_ids, q_ids), n - 1)
    is_self = m_ids[self_at] == q_ids
    rows = max(1, cells // width)
    held = np.empty((min(rows, len(q)), width), np.float32)
    found_r, found_c = [], []
    for s in range(0, len(q), rows):
        part = slice(s, min(s + rows, len(q)))
        d = held[: part.stop - s]
        np.matmul(asked[part], side, out=d)
        at = np.flatnonzero(is_self[part])
        d[at, self_at[part][at]] = np.inf
        least = d.reshape(len(d), lanes, groups).min(axis=1)
        bound = np.full(len(d), limit, np.float64) - own[part]
        if k <= groups:
            bound = np.minimum(bound, np.partition(least, k - 1, axis=1)[:, k - 1])
        slack = 1e-6 * (own[part] + 1)  # rounding of the product; exact distances decide
        bound = np.minimum(bound + slack, np.finfo(np.float32).max).astype(np.float32)
        r, g = np.nonzero(least <= bound[:, None])
        i, lane = np.nonzero(d.reshape(len(d), lanes, groups)[r, :, g] <= bound[r][:, None])
        found_r.append(s + r[i])
        found_c.append(lane * groups + g[i])
    r, c = np.concatenate(found_r), np.concatenate(found_c)
    diff = q[r] - m[c]
    dist = np.einsum("ij,ij->i", diff, diff).astype(np.float64)
    best = np.lexsort((c, dist, r))
    best = best[dist[best] <= limit]
    r, c, dist = r[best], c[best], dist[best]
    keep = np.arange(len(r)) - np.searchsorted(r, r) < k
    return q_ids[r[keep]], m_ids[c[keep]], dist[keep]


def nearest_reps(reps: DataFrame, n: int, k: int, dim: int, limit: float, queries=None, sample: int = 65_536, target: int = 300, most_list: int = 262_144, member_ratio: float = 1.03, replicas: int = 2, query_ratio: float = 1.03, floor: int = 2, query_block: int = 8_192, member_block: int = 16_384) -> DataFrame:
    """(rep, other, dist): the k nearest other vectors of each different vector (those in ``queries``)."""
    spark = reps.sparkSession
    share = min(1.0, sample / max(n, 1))
    mark = F.pmod(F.xxhash64("rep", F.lit(11)), F.lit(1 << 30))
    fitted = reps.filter(mark <= int(share * (1 << 30))).select("v").toArrow()  # about ``sample`` vectors, whatever n is
    x = unpack(fitted.column(0), dim)
    part = len(x) / max(n, 1)
    centroids = balanced_centroids(x, max(16, int(target * part)), ball=int(most_list * part / 2)) if len(x) else np.zeros((1, dim), np.float32)
    rows = list_rows(reps, CentroidGraph(centroids), dim, member_ratio, replicas, query_ratio, floor)
    if queries is not None:
        rows = rows.filter("not query").unionByName(rows.filter("query").join(queries, "rep", "left_semi"))
    rows = split_lists(written(rows, "knn-lists"), dim, most_list, sample // 4, target, member_ratio, replicas, query_ratio, floor)
    sizes = rows.groupBy("list").agg(F.count_if("query").alias("q"), F.count_if(~F.col("query")).alias("m"))
    sizes = sizes.select("list", F.ceil(F.col("q") / query_block).cast("int").alias("qb"), F.ceil(F.col("m") / member_block).cast("int").alias("mb")).filter("qb > 0 and mb > 0")
    blocks = rows.join(sizes, "list")
    other = F.when(F.col("query"), F.col("mb")).otherwise(F.col("qb"))
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("query"), F.col("qb")).otherwise(F.col("mb"))).cast("int")
    blocks = blocks.select("list", "query", "rep", "v", own.alias("own"), F.explode(F.sequence(F.lit(0), other - 1)).alias("other"))
    blocks = blocks.select("list", F.when(F.col("query"), F.col("own")).otherwise(F.col("other")).alias("i"), F.when(F.col("query"), F.col("other")).otherwise(F.col("own")).alias("j"), "query", "rep", "v")

    def of(t: pa.Table) -> pa.Table:
        query = t.column("query").to_numpy()
        rep, v = t.column("rep").to_numpy(), unpack(t.column("v"), dim)
        a, b, d = nearest(rep[query], v[query], rep[~query], v[~query], k, limit) if query.any() and not query.all() else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table([pa.array(a), pa.array(b), pa.array(d.astype(np.float64))], ["rep", "other", "dist"])

    found = blocks.groupBy("list", "i", "j").applyInArrow(of, "rep long, other long, dist double")
    best = found.groupBy("rep").agg(F.slice(F.array_sort(F.collect_set(F.struct("dist", "other"))), 1, k).alias("near"))
    return best.select("rep", F.explode("near").alias("n")).select("rep", F.col("n.other").alias("other"), F.col("n.dist").alias("dist"))


def similar_vectors(vectors: DataFrame, k: int = 5, dim: int = 64, limit: float = float("inf"), every: int = 1, id_col: str = "id", vector_col: str = "embedding", **index) -> DataFrame:
    """(id, near): the k most similar other ids of each usable vector whose id ``every`` divides, as an array
    of (dist, id) by squared L2, ties to the smaller id, at most ``limit`` away.

    Equal vectors are searched once and their ids expanded afterwards, at most k + 1 of a group, which is
    all that can be among the k nearest of any vector. Unusable vectors (see ``packed.usable``) have no row;
    empty tables give none. The search is approximate: about 0.99 of the true neighbours with the defaults.
    """
    ids = written(usable(vectors, id_col, vector_col, dim), "knn-ids")
    reps = written(_copies(ids, k + 1), "knn-reps")
    n = reps.count()
    asked = None
    if every > 1:
        wanted = ids.filter(F.pmod("id", F.lit(every)) == 0)
        asked = written(wanted.join(reps.select("v", "rep"), "v").select("rep").distinct(), "knn-asked")
    found = nearest_reps(reps, n, k, dim, limit, queries=asked, **index)
    copies = written(reps.filter(F.size("near") > 1), "knn-copies")  # the others stand for themselves
    others = found.join(copies.select(F.col("rep").alias("other"), F.col("near").alias("ids")), "other", "left")
    others = others.select("rep", "dist", F.coalesce("ids", F.array("other")).alias("ids"))
    spread = others.select("rep", F.transform("ids", lambda i: F.struct(F.col("dist").alias("dist"), i.alias("id"))).alias("c"))
    spread = spread.groupBy("rep").agg(F.flatten(F.collect_list("c")).alias("c"))
    own = reps.select("rep", "near")
    own = own.join(asked, "rep", "left_semi") if every > 1 else own
    same = F.transform("near", lambda i: F.struct(F.lit(0.0).alias("dist"), i.alias("id")))
    near = own.join(spread, "rep", "left")
    near = near.select("rep", F.size("near").alias("n"), F.slice(F.array_sort(F.concat(same, F.coalesce("c", F.array().cast("array<struct<dist:double,id:bigint>>")))), 1, 2 * k + 2).alias("c"))
    near = written(near, "knn-near")
    lone = near.filter("n = 1").select(F.col("rep").alias("id"), "c")
    copied = ids.join(copies.select("v", "rep"), "v").select("id", "rep").join(near.filter("n > 1").select("rep", "c"), "rep").select("id", "c")
    rows = lone.unionByName(copied)
    if every > 1:
        rows = rows.filter(F.pmod("id", F.lit(every)) == 0)
    return rows.select("id", F.slice(F.filter("c", lambda x: x["id"] != F.col("id")), 1, k).alias("near"))


def close_pairs(near: DataFrame) -> DataFrame:
    """(id_a, id_b) with id_a < id_b: pairs of which one is in the other's list."""
    pairs = near.select("id", F.explode("near").alias("n")).select("id", F.col("n.id").alias("other"))
    return pairs.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
