"""Clusters of mutually similar vectors by density grids.

Features are random directions within the span of the principal axes. A grid quantises them and its cells are counted;
within a cell a vector belongs to the smallest id within the cluster radius. What stands for a dense cell is
joined to what stands for the adjacent cells, and minimum labels spread over the joins until none changes. Then
differently turned grids, many at once, bring together what the first one parted, until a whole round joins nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import written
from .packed import unpack, usable

STANDING = "id long, parent long, n long, crowd long, v binary"


def moments(vectors: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and covariance of all vectors, from one small sum of each partition."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + dim + dim * dim)
        for b in batches:
            x = unpack(b.column(0), dim).astype(np.float64)
            total += np.r_[len(x), x.sum(0), (x.T @ x).ravel()]
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], ["m"])

    parts = vectors.select("v").mapInArrow(of, "m array<double>")
    sums = parts.select(F.posexplode("m")).groupBy("pos").agg(F.sum("col").alias("s")).toPandas()  # 1 + dim + dim² rows
    m = np.zeros(1 + dim + dim * dim)
    m[sums["pos"].to_numpy()] = sums["s"].to_numpy()
    n = max(m[0], 1.0)
    mean = m[1 : 1 + dim] / n
    return int(m[0]), mean, m[1 + dim :].reshape(dim, dim) / n - np.outer(mean, mean)


class Grid:
    """Cells of ``width`` over ``axes`` random orthonormal directions within the principal axes whose deviation is at
    least ``spread`` of the largest, six more than needed at least; shifted at random. A cell's name is 64 bits of its
    place: two cells of one name cost time only, since joins are checked on whole vectors."""

    def __init__(self, mean: np.ndarray, cov: np.ndarray, axes: int, width: float, seed: int, spread: float = 0.35):
        rng = np.random.default_rng(seed)
        values, vectors = np.linalg.eigh(cov)
        wide = max(int((values >= max(values.max(), 1e-9) * spread**2).sum()), axes + 6)
        strong = vectors[:, -wide:]
        axes = min(axes, strong.shape[1])
        turn, _ = np.linalg.qr(rng.normal(size=(strong.shape[1], axes)))
        self.to = (strong @ turn / width).astype(np.float32)
        self.shift = (rng.random(axes) - mean @ self.to).astype(np.float32)
        self.width = width
        self.odd = rng.integers(1, 1 << 62, axes) * 2 + 1
        self.own = int(rng.integers(0, 1 << 62))

    def cells(self, x: np.ndarray) -> np.ndarray:
        return (np.floor(x @ self.to + self.shift).astype(np.int64) * self.odd).sum(1) + self.own

    def touched(self, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of all cells that come within ``reach`` of each row: its own and adjacent ones."""
        at = x @ self.to + self.shift
        base = np.floor(at)
        low = at - base
        gap, step = (np.minimum(low, 1 - low) * self.width) ** 2, np.where(low < 0.5, -1, 1) * self.odd
        rows, names, left = np.arange(len(x)), (base.astype(np.int64) * self.odd).sum(1) + self.own, np.asarray(reach, np.float64) ** 2
        for j in range(at.shape[1]):  # ways over each wall, alone and together, as far as the reach goes
            over = gap[rows, j] < left
            r = rows[over]
            rows, names, left = np.r_[rows, r], np.r_[names, names[over] + step[r, j]], np.r_[left, left[over] - gap[r, j]]
        return rows, names


def leaders(run: np.ndarray, x: np.ndarray, radius2: float) -> np.ndarray:
    """For rows in order, ``run`` numbering their groups: the first row of the group, not itself led, within the radius."""
    lead = np.empty(len(run), np.int64)
    open_ = np.arange(len(run))
    while len(open_):
        first = np.flatnonzero(np.r_[True, run[open_][1:] != run[open_][:-1]])
        head = open_[np.repeat(first, np.diff(np.r_[first, len(open_)]))]
        near = np.empty(len(open_), bool)
        for s in range(0, len(open_), 16_384):
            diff = x[open_[s : s + 16_384]] - x[head[s : s + 16_384]]
            near[s : s + 16_384] = np.einsum("ij,ij->i", diff, diff) <= radius2
        lead[open_[near]] = head[near]
        open_ = open_[~near]
    return lead


def _chunks(batches: Iterator[pa.RecordBatch], rows: int, key: str | None = None) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows; with ``key``, rows of one key (they come sorted) are in one table."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(h.num_rows for h in held) >= rows:
            t, cut = pa.Table.from_batches(held), None
            if key is not None:
                k = t.column(key).to_numpy()
                ends = np.flatnonzero(np.diff(k)) + 1
                cut = int(ends[-1]) if len(ends) else 0
            if cut is None or cut:
                yield t.slice(0, cut) if cut else t
                held = t.slice(cut).to_batches() if cut else []
    if held:
        yield pa.Table.from_batches(held)


def _take_vectors(v: pa.ChunkedArray, keep: np.ndarray) -> pa.Array:
    """``v`` with null where not ``keep``."""
    at = np.arange(len(keep))
    return v.combine_chunks().take(pa.array(at, mask=~keep))


def settle(vectors: DataFrame, grid: Grid, dim: int, radius2: float) -> DataFrame:
    """(cell, id, leader, n, v): each vector's cell and the smallest id within the radius in the same cell and batch; ``n``
    led vectors and ``v`` at leaders only. A combine step: of a hot cell only its leaders are shuffled."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches, 65_536):
            x, ids = unpack(t.column("v"), dim), t.column("id").to_numpy()
            cell = grid.cells(x)
            order = np.lexsort((ids, cell))
            run = np.cumsum(np.r_[0, np.diff(cell[order]) != 0])
            lead = leaders(run, x[order], radius2)
            n = np.bincount(lead, minlength=len(lead))
            v = t.column("v").combine_chunks().take(pa.array(order, mask=n == 0))
            yield pa.RecordBatch.from_arrays([pa.array(cell[order]), pa.array(ids[order]), pa.array(ids[order][lead]), pa.array(n), v], ["cell", "id", "leader", "n", "v"])

    return vectors.select("id", "v").mapInArrow(of, "cell long, id long, leader long, n long, v binary")


def by_cell(rows: DataFrame, dim: int, radius2: float) -> DataFrame:
    """STANDING for (cell, id, n, v): ``parent`` is the smallest id within the radius in the same cell, ``crowd`` the
    vectors counted in the cell; ``v`` and the summed ``n`` at parents only."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _chunks(batches, 32_768, "cell"):
            cell, ids, n = (t.column(c).to_numpy() for c in ("cell", "id", "n"))
            run = np.cumsum(np.r_[0, np.diff(cell) != 0])
            lead = leaders(run, unpack(t.column("v"), dim), radius2)
            own = lead == np.arange(len(lead))
            total = np.bincount(lead, n, len(lead)).astype(np.int64)
            crowd = np.bincount(run, n).astype(np.int64)[run]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[lead]), pa.array(total), pa.array(crowd), _take_vectors(t.column("v"), own)], ["id", "parent", "n", "crowd", "v"])

    return rows.select("cell", "id", "n", "v").repartition("cell").sortWithinPartitions("cell", "id").mapInArrow(of, STANDING)


def adjacent(standing: DataFrame, grid: Grid, dim: int, dense: int, reach: float) -> DataFrame:
    """(cell, id, n, v): a row for each cell that a stand-in is seen from: its own and, if it stands for a dense cell (of
    ``dense`` vectors at least), the adjacent ones within ``reach``."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 8_192):
                part = b.slice(s, 8_192)
                r, cell = grid.touched(unpack(part.column(3), dim), np.where(part.column(2).to_numpy() >= dense, reach, 0.0))
                at = pa.array(r)
                yield pa.RecordBatch.from_arrays([pa.array(cell), part.column(0).take(at), part.column(1).take(at), part.column(3).take(at)], ["cell", "id", "n", "v"])

    return standing.select("id", "n", "crowd", "v").mapInArrow(of, "cell long, id long, n long, v binary")


def turned(standing: DataFrame, grids: list[Grid], dim: int) -> DataFrame:
    """(cell, id, n, v): each stand-in in its cell of every grid."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unpack(b.column(2), dim)
                for g in grids:
                    yield pa.RecordBatch.from_arrays([pa.array(g.cells(x)), *b.columns], ["cell", "id", "n", "v"])

    return standing.select("id", "n", "v").mapInArrow(of, "cell long, id long, n long, v binary")


def min_labels(links: DataFrame) -> DataFrame:
    """(id, label) for the ends of (id, parent) links: the smallest id that links lead to, by spreading minimum labels to
    linked ids and along the labels' own labels until none changes."""
    links = links.distinct()
    both = written(links.unionByName(links.select(F.col("parent").alias("id"), F.col("id").alias("parent"))), "grid-links")
    labels = written(both.groupBy("id").agg(F.least(F.min("parent"), F.first("id")).alias("label")), "grid-labels")
    while True:
        seen = both.join(labels.select(F.col("id").alias("parent"), "label"), "parent").groupBy("id").agg(F.min("label").alias("low"))
        near = labels.join(seen, "id").select("id", F.col("label").alias("old"), F.least("label", "low").alias("label"))
        ahead = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        now = written(near.join(ahead, "label", "left").select("id", "old", F.least("label", F.coalesce("far", "label")).alias("label")), "grid-labels")
        labels = now.select("id", "label")
        if not now.filter("old <> label").head(1):
            return labels


def _followed(labels: DataFrame, later: DataFrame, key: str = "head_id") -> DataFrame:
    """``labels`` with heads that ``later`` (id, label) names replaced by its labels."""
    named = later.select(F.col("id").alias(key), F.col("label").alias("_to"))
    return labels.join(named, key, "left").withColumn(key, F.coalesce("_to", key)).drop("_to")


def grid_clusters(vectors: DataFrame, radius2: float = 8_000.0, dim: int = 64, width: float | None = None, axes: int | None = None, grids: int = 16, dense: int = 2, reach: float | None = None, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(id, head_id, cell): every usable vector's id with the smallest id of its cluster, alone or not, and its cell of
    the first grid.

    A vector is joined only to one at a squared distance of at most ``radius2``, checked on whole vectors. Where any two
    of a cluster are within the radius and all others are not, clusters come out whole; of a longer chain what joins
    connect is one cluster, and its parts may come out apart. Cells of ``dense`` vectors are joined to adjacent cells within ``reach`` of their
    stand-in (by default half the radius as it looks on the grid's axes). Then rounds of ``grids`` turned grids follow until one
    joins nothing: there two stand-ins at the radius share a cell with a chance of about 0.4 a grid, nearer ones more
    often, and all pairs of a cell are looked at through its leaders. Unusable vectors (see ``packed.usable``) have
    no row; empty tables give none.
    """
    ids = written(usable(vectors, id_col, vector_col, dim), "grid-ids")
    n, mean, cov = moments(ids, dim)
    axes = axes or max(6, ceil(log2(max(n, 2))) - 2)
    width = width or 1.7 * radius2**0.5
    reach = 0.5 * (radius2 * min(axes, dim) / dim) ** 0.5 if reach is None else reach
    grid = Grid(mean, cov, axes, width, seed=1000)
    first = written(settle(ids, grid, dim, radius2), "grid-cells")
    second = written(by_cell(first.filter("v is not null"), dim, radius2), "grid-standing")
    standing = second.filter("v is not null").select("id", "n", "crowd", "v")
    links = by_cell(adjacent(standing, grid, dim, dense, reach), dim, radius2).filter("id <> parent").select("id", "parent")
    steps, used = [], 0
    while True:
        links = written(links, "grid-links")
        if links.head(1):
            steps.append(min_labels(links))
            standing = standing.join(steps[-1].filter("id <> label"), "id", "left_anti")
        elif used:
            break
        more = [Grid(mean, cov, axes, width, seed=1001 + used + g) for g in range(grids)]
        used += grids
        links = by_cell(turned(standing, more, dim), dim, radius2).filter("id <> parent").select("id", "parent")
    labels = second.select("id", F.col("parent").alias("head_id"))
    for s in steps:
        labels = _followed(labels, s)
    labels = labels.filter("id <> head_id").select("id", F.col("head_id").alias("label"))
    return _followed(first.select("id", F.col("leader").alias("head_id"), "cell"), labels).select("id", "head_id", "cell")


def large_clusters(labels: DataFrame, least: int = 5) -> DataFrame:
    """The rows of clusters with at least ``least`` ids."""
    heads = labels.groupBy("head_id").count().filter(F.col("count") >= least).select("head_id")
    return labels.join(heads, "head_id", "left_semi")


def _members(vectors: DataFrame, labels: DataFrame, dim: int, id_col: str, vector_col: str) -> DataFrame:
    return written(usable(vectors, id_col, vector_col, dim).join(labels, "id"), "grid-members")


def _means(rows: DataFrame, dim: int) -> DataFrame:
    """(head_id, size, mean, inertia) of (head_id, v), by sums within tasks first."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = unpack(b.column(1), dim).astype(np.float64)
                heads, at, n = np.unique(b.column(0).to_numpy(), return_inverse=True, return_counts=True)
                order = np.argsort(at, kind="stable")
                s = np.add.reduceat(x[order], np.r_[0, np.cumsum(n)[:-1]], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(heads), pa.array(n), pa.array(s.tolist(), pa.list_(pa.float64())), pa.array(np.bincount(at, (x * x).sum(1)))], ["head_id", "n", "s", "ss"])

    sums = rows.select("head_id", "v").mapInArrow(partial, "head_id long, n long, s array<double>, ss double")
    total = sums.groupBy("head_id").agg(F.sum("n").alias("size"), F.sum("ss").alias("ss"), F.array(*[F.sum(F.col("s")[i]) for i in range(dim)]).alias("s"))
    inertia = F.greatest(F.lit(0.0), F.col("ss") - F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x) / F.col("size"))
    return total.select("head_id", "size", F.transform("s", lambda x: x / F.col("size")).alias("mean"), inertia.alias("inertia"))


def cluster_sizes(vectors: DataFrame, labels: DataFrame, dim: int = 64, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(head_id, size, inertia): each cluster's ids and their summed squared distance to their mean."""
    return _means(_members(vectors, labels, dim, id_col, vector_col), dim).drop("mean")


def describe_clusters(vectors: DataFrame, labels: DataFrame, dim: int = 64, typical: int = 5, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """(head_id, size, inertia, typical): each cluster's ids, summed squared distance to its mean, and its most typical
    ids: those of its densest cell (of cells with as many, the one of the smaller name), nearest to the mean first,
    ties to the smaller id, then those of its other cells."""
    rows = _members(vectors, labels, dim, id_col, vector_col)
    total = written(_means(rows, dim), "grid-means")
    densest = rows.groupBy("head_id", "cell").count().groupBy("head_id").agg(F.max_by("cell", F.struct("count", -F.col("cell"))).alias("most"))

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                mean = np.asarray(b.column(4).flatten()).reshape(-1, dim)
                d = ((unpack(b.column(3), dim) - mean) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(d)], ["head_id", "id", "outside", "d"])

    marked = rows.join(total.select("head_id", "mean"), "head_id").join(densest, "head_id").select("head_id", "id", (F.col("cell") != F.col("most")).alias("outside"), "v", "mean")
    d = marked.mapInArrow(far, "head_id long, id long, outside boolean, d double")
    nearest = d.withColumn("r", F.row_number().over(Window.partitionBy("head_id").orderBy("outside", "d", "id"))).filter(F.col("r") <= typical)
    heads = nearest.groupBy("head_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("typical"))
    return total.join(heads, "head_id").select("head_id", "size", "inertia", "typical")


def inertia_of(vectors: DataFrame, centroids: np.ndarray, dim: int = 64, id_col: str = "id", vector_col: str = "embedding") -> float:
    """Summed squared distance of all usable vectors to the nearest of some centroids (a stored run's, some hundred)."""
    held = vectors.sparkSession.sparkContext.broadcast(np.asarray(centroids, np.float64))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        total = 0.0
        for b in batches:
            x = unpack(b.column(0), dim).astype(np.float64)
            if len(x):
                total += float(np.maximum(((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T).min(1), 0).sum())
        yield pa.RecordBatch.from_arrays([pa.array([total])], ["s"])

    return usable(vectors, id_col, vector_col, dim).select("v").mapInArrow(of, "s double").agg(F.sum("s")).first()[0] or 0.0


def compared(vectors: DataFrame, labels: DataFrame, runs: DataFrame, dim: int = 64) -> DataFrame:
    """(run_id, clusters, inertia, grid_clusters, grid_inertia, better) for each stored run with usable centroids:
    its inertia over all usable vectors beside that of these clusters. A centroid that is null, of another length
    or not finite is left out; a run without any has no row."""
    own = cluster_sizes(vectors, labels, dim).agg(F.count("*").alias("k"), F.coalesce(F.sum("inertia"), F.lit(0.0)).alias("i")).first()
    found = []
    for r in runs.filter("run_id is not null and centroids is not null").select("run_id", "centroids").collect():  # a few stored runs
        c = [x for x in r["centroids"] if x is not None and len(x) == dim and all(v is not None and np.isfinite(v) for v in x)]
        if c and r["run_id"] not in {f[0] for f in found}:
            i = inertia_of(vectors, np.array(c), dim)
            found.append((r["run_id"], len(c), i, own["k"], own["i"], own["i"] < i))
    return vectors.sparkSession.createDataFrame(found, "run_id long, clusters int, inertia double, grid_clusters long, grid_inertia double, better boolean")
