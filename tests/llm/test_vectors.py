from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import balanced, grid_clusters, packed, posting_knn

V = "id long, embedding array<float>"


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(2)
    centres = rng.uniform(20, 235, (25, 64))
    x = np.concatenate([np.round(c + rng.normal(0, 3, (n, 64))) for c, n in zip(centres, [200] * 2 + [20] * 10 + [6] * 5 + [4] * 8)])
    return np.clip(x, 0, 255).astype(np.float32)


@pytest.fixture(scope="module")
def table(spark, cloud):
    ids = np.random.default_rng(0).permutation(len(cloud))
    rows = [(int(i), r.tolist()) for i, r in zip(ids, cloud)]
    rows += [(1000 + k, rows[3][1]) for k in range(12)]  # one vector under many ids
    bad = [(5000, None), (5001, [1.0] * 63), (5002, [None] + [1.0] * 63), (5003, [float("nan")] + [1.0] * 63), (5004, [0.0] * 64), (None, [1.0] * 64), (5005, [])]
    df = spark.createDataFrame(rows + rows[:40] + bad, V).withColumn("v", F.lit("clash")).withColumn("rep", F.lit(1)).withColumn("n", F.lit(2))
    return df, {i: np.array(v) for i, v in rows}


def exact(points):
    ids = np.array(sorted(points))
    x = np.stack([points[i] for i in ids])
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    return ids, d


def test_packing():
    x = np.array([[0, 255, 3], [1, 2, 254]], np.float32)
    assert (packed.unpack(packed.pack(x), 3) == x).all()
    y = np.array([[0.5, -1, 3], [1, 2, 3]], np.float32)
    assert (packed.unpack(packed.pack(y), 3) == y).all() and len(packed.unpack(pa.array([], pa.binary()), 3)) == 0


def test_usable(table):
    df, points = table
    assert {r.id for r in packed.usable(df, "id", "embedding", 64).collect()} == set(points)


def test_graph_walk_finds_all_within_ratio(cloud):
    c = balanced.balanced_centroids(cloud, 12)
    g = balanced.CentroidGraph(c, degree=12, entries=8)
    r, k, d, least = g.within(cloud[:100], 1.3)
    full = ((cloud[:100, None].astype(np.float64) - c[None].astype(np.float64)) ** 2).sum(-1)
    assert np.allclose(least, full.min(1), rtol=1e-4)
    assert np.allclose(d, full[r, k], rtol=1e-9)
    want = set(zip(*np.nonzero(full <= full.min(1)[:, None] * 1.69 * 0.999)))
    assert len(want & set(zip(r.tolist(), k.tolist()))) >= 0.97 * len(want)


def test_graph_walk_visits_a_part():
    rng = np.random.default_rng(3)
    c = rng.uniform(0, 255, (4_000, 16)).astype(np.float32)
    x = (c[rng.integers(0, len(c), 500)] + rng.normal(0, 4, (500, 16))).astype(np.float32)
    g = balanced.CentroidGraph(c)
    r, k, d, least = g.within(x, 1.05, floor=2)
    assert g.visited < 0.6 * len(x) * len(c)
    assert np.mean(np.isclose(least, balanced.squared(x, c).min(1), rtol=1e-4)) >= 0.97 and (np.bincount(r) >= 2).all()


def test_tight_balls_stay_whole(cloud):
    many = balanced.balanced_centroids(cloud, 20)
    assert len(balanced.balanced_centroids(cloud, 20, ball=1_000)) < len(many)
    assert len(balanced.balanced_centroids(np.ones((50, 4), np.float32), 5)) == 1


@pytest.mark.parametrize("sizes", [{}, {"target": 30, "query_block": 16, "member_block": 24}, {"most_list": 60, "target": 200}])
def test_pairs_against_brute_force(table, sizes):
    df, points = table
    ids, d = exact(points)
    want = set()
    for i in range(len(ids)):
        for j in np.lexsort((ids, d[i]))[:5]:
            if d[i, j] <= 8000:
                want.add((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    got = {tuple(r) for r in posting_knn.close_pairs(posting_knn.similar_vectors(df, k=5, limit=8000.0, **sizes)).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    if not sizes:
        assert got == want


def test_every_hundredth(table):
    df, points = table
    ids, d = exact(points)
    got = {r.id: [n.id for n in r.near] for r in posting_knn.similar_vectors(df, k=10, every=100).collect()}
    assert set(got) == {i for i in points if i % 100 == 0}
    hits = sum(len(set(got[int(ids[i])]) & set(ids[np.lexsort((ids, d[i]))[:10]].tolist())) for i in range(len(ids)) if ids[i] % 100 == 0)
    assert hits >= 0.95 * 10 * len(got)


def test_nearest_block():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, (300, 5)).astype(np.float32)  # many ties
    ids = rng.permutation(300)
    for members, k in ((300, 5), (70, 3), (4, 6)):
        a, b, dist = posting_knn.nearest(ids, x, ids[:members], x[:members], k, 12.0)
        for i in range(300):
            d = ((x[i] - x[:members]) ** 2).sum(1)
            rank = [j for j in np.lexsort((ids[:members], d)) if ids[j] != ids[i] and d[j] <= 12][:k]
            assert b[a == ids[i]].tolist() == ids[rank].tolist()


@pytest.mark.parametrize("how", [{}, {"width": 40.0, "grids": 6}, {"dense": 10**6}])
def test_clusters(table, how):
    """Also with cells that part most clusters, and with no cell dense enough to be joined to its neighbours."""
    df, points = table
    ids, d = exact(points)
    head = {int(i): int(min([i, *ids[d[k] <= 8000]])) for k, i in enumerate(ids)}
    labels = grid_clusters.grid_clusters(df, **how).cache()
    assert {r.id: r.head_id for r in labels.collect()} == head
    if how:
        return
    size = Counter(head.values())
    large = grid_clusters.large_clusters(labels)
    assert {r.id for r in large.collect()} == {i for i, h in head.items() if size[h] >= 5}
    cell = {r.id: r.cell for r in labels.collect()}
    for r in grid_clusters.describe_clusters(df, labels).collect():
        mine = [i for i in head if head[i] == r.head_id]
        x = np.stack([points[i] for i in mine])
        assert r.size == len(x) and r.inertia == pytest.approx(((x - x.mean(0)) ** 2).sum(), rel=1e-6, abs=1e-3)
        most = Counter(cell[i] for i in mine)
        assert len(r.typical) == min(5, len(x)) and set(r.typical) <= set(mine) and most[cell[r.typical[0]]] == max(most.values())
    runs = df.sparkSession.createDataFrame([(1, [[1.0] * 64, None, [2.0] * 3]), (1, [[1.0] * 64]), (2, None), (None, [[1.0] * 64])], "run_id long, centroids array<array<float>>")
    got = grid_clusters.compared(df, labels, runs).collect()
    assert [(r.run_id, r.clusters, r.better) for r in got] == [(1, 1, True)]
    assert got[0].inertia == pytest.approx(sum(((v - 1) ** 2).sum() for v in points.values()), rel=1e-9)


def test_chains(spark):
    """A chain of vectors each within the radius of the next only: what is joined is connected, the rest may be apart."""
    rows = [(i, [float(80 * i)] + [1.0] * 63) for i in (4, 0, 3, 1, 2, 9)]
    got = {r.id: r.head_id for r in grid_clusters.grid_clusters(spark.createDataFrame(rows, V)).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 9} and got[9] == 9 and got[0] == got[1] == 0
    for head in set(got.values()):
        mine = sorted(i for i in got if got[i] == head)
        assert mine[0] == head and mine == list(range(mine[0], mine[-1] + 1))


def test_empty(spark):
    none = spark.createDataFrame([], V)
    assert grid_clusters.grid_clusters(none).count() == 0
    assert posting_knn.similar_vectors(none).count() == 0
    one = spark.createDataFrame([(1, [1.0] * 64)], V)
    assert [tuple(r)[:2] for r in grid_clusters.grid_clusters(one).collect()] == [(1, 1)]
    assert [r.near for r in posting_knn.similar_vectors(one).collect()] == [[]]
