"""k-means: assignment and Lloyd steps over all rows, k-means++ starts from a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def np_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (x @ c.T), 0)


def assign(vectors: DataFrame, centroids: np.ndarray, digits: int = 6) -> DataFrame:
    """(id, cid, dist, embedding) with the nearest centroid, ties (at ``digits``) to the smaller cid. The centroids,
    a k x dim matrix, go to every task."""
    held = vectors.sparkSession.sparkContext.broadcast(np.asarray(centroids, np.float64))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = held.value
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                d = np.round(np_distances(x, c), digits)
                at = d.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at.astype(np.int32)), pa.array(d[np.arange(len(at)), at]), b.column(1)], ["id", "cid", "dist", "embedding"])

    return vectors.filter("embedding is not null").select("id", "embedding").mapInArrow(of, "id long, cid int, dist double, embedding array<float>")


def update(assigned: DataFrame, dim: int, digits: int = 9) -> DataFrame:
    """(cid, n, center): the mean of each cluster that has members."""
    means = assigned.groupBy("cid").agg(F.count("*").alias("n"), *[F.avg(F.col("embedding")[i].cast("double")).alias(f"m{i}") for i in range(dim)])
    return means.select("cid", "n", F.array(*[F.round(f"m{i}", digits) for i in range(dim)]).alias("center"))


def check_finite(centroids: np.ndarray) -> np.ndarray:
    """The centroids; an error if any component is NaN or infinite, as one bad vector would make them."""
    if not np.isfinite(centroids).all():
        raise ValueError("a centroid is not finite: the vectors hold NaN or infinite values")
    return centroids


def lloyd(vectors: DataFrame, start: np.ndarray, iters: int = 25, tol: float = 1e-4) -> tuple[np.ndarray, float, int, int]:
    """(centroids, inertia, steps, reseeds). Stops when the inertia falls by less than ``tol`` of itself; the inertia
    is that of the last assignment. An empty cluster moves to the worst-served vector not yet taken."""
    c, last, reseeds, steps = np.array(start, np.float64), None, 0, 0
    dim = c.shape[1]
    for _ in range(iters):
        got = assign(vectors, c, digits=12)
        sums = got.groupBy("cid").agg(F.count("*").alias("n"), F.sum("dist").alias("inertia"), *[F.avg(F.col("embedding")[i].cast("double")).alias(f"m{i}") for i in range(dim)]).toArrow()  # k rows
        steps += 1
        cids = sums.column("cid").to_numpy()
        inertia = float(np.sum(sums.column("inertia").to_numpy()))
        c[cids] = np.stack([sums.column(f"m{i}").to_numpy() for i in range(dim)], axis=1) if len(cids) else c[cids]
        check_finite(c)
        empty = sorted(set(range(len(c))) - set(cids.tolist()))
        if empty:
            worst = got.filter("dist > 0").orderBy(F.desc("dist"), "id").limit(len(empty)).select("embedding").collect()  # at most k rows
            for e, w in zip(empty, worst):
                c[e] = w[0]
                reseeds += 1
        if last is not None and 0 <= last - inertia < tol * last:
            last = inertia
            break
        last = inertia
    return c, float(last or 0.0), steps, reseeds


def plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ starts: each next one drawn by its squared distance to those taken."""
    k = min(k, len(x))
    taken = [int(rng.integers(len(x)))]
    best = np_distances(x, x[taken])[:, 0]
    while len(taken) < k:
        run = np.cumsum(best)
        taken.append(int(min(np.searchsorted(run, rng.random() * run[-1], side="right"), len(x) - 1)) if run[-1] > 0 else int(rng.integers(len(x))))
        best = np.minimum(best, np_distances(x, x[taken[-1:]])[:, 0])
    return x[taken].copy()


def train_local(x: np.ndarray, k: int, iters: int, tol: float, seed: int, n_init: int) -> dict:
    """Best of ``n_init`` runs on rows that fit one task (a bounded sample)."""
    x = check_finite(np.asarray(x, np.float64))
    runs = []
    for attempt in range(n_init):
        rng = np.random.default_rng([seed, attempt])
        c, last, reseeds, steps = plus_plus(x, k, rng), None, 0, 0
        for _ in range(iters):
            d = np_distances(x, c)
            at = d.argmin(1)
            near = d[np.arange(len(x)), at]
            inertia = float(near.sum())
            steps += 1
            n = np.bincount(at, minlength=len(c))
            sums = np.zeros_like(c)
            np.add.at(sums, at, x)
            c[n > 0] = sums[n > 0] / n[n > 0, None]
            for e in np.flatnonzero(n == 0):
                w = int(near.argmax())
                c[e], near[w] = x[w], 0.0
                reseeds += 1
            if last is not None and 0 <= last - inertia < tol * last:
                last = inertia
                break
            last = inertia
        runs.append({"centroids": c, "inertia": float(last), "iters": steps, "reseeds": reseeds})
    best = min(runs, key=lambda r: r["inertia"])
    return best | {"inertia_per_init": sorted(r["inertia"] for r in runs)}


def bounded_sample(vectors: DataFrame, most: int, seed: int = 42) -> np.ndarray:
    """About ``most`` vectors chosen by hash of the id, all where there are fewer."""
    n = vectors.count()
    share = min(1.0, most / max(n, 1))
    rows = vectors if share >= 1 else vectors.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    t = rows.filter("embedding is not null").select("id", "embedding").toArrow()
    x = t.column("embedding").combine_chunks()
    m = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1) if len(x) else np.empty((0, 1))
    return m[np.argsort(t.column("id").to_numpy(), kind="stable")]


def kmeans(vectors: DataFrame, k: int = 256, iters: int = 25, tol: float = 1e-4, seed: int = 42, n_init: int = 3, sample: int = 50_000) -> dict:
    """Centroids of all ``vectors``: starts are the best of ``n_init`` runs on a sample of about ``sample`` rows, Lloyd
    steps then run over every row. k is at most the number of vectors; none give no centroids."""
    x = bounded_sample(vectors, sample, seed)
    if not len(x):
        return {"centroids": np.empty((0, 0)), "inertia": 0.0, "iters": 0, "reseeds": 0, "inertia_per_init": []}
    first = train_local(x, k, iters, tol, seed, n_init)
    c, inertia, steps, reseeds = lloyd(vectors, first["centroids"], iters, tol)
    return {"centroids": c, "inertia": inertia, "iters": steps, "reseeds": reseeds + first["reseeds"], "inertia_per_init": first["inertia_per_init"]}
