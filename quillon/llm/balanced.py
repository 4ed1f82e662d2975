"""Balanced centroids of a bounded sample and the neighbour graph that searches them (numpy only)."""

from __future__ import annotations

import numpy as np


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared L2 distances of all rows of ``a`` to all rows of ``b``, in double precision."""
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * (a @ b.T), 0)


def balanced_centroids(sample: np.ndarray, leaf: int, ball: int = 0, tight: float = 0.02, seed: int = 7, rounds: int = 6) -> np.ndarray:
    """Centroids of a tree of two-means splits whose leaves hold at most ``leaf`` sample rows.

    A node of at most ``ball`` rows whose mean squared radius is at most ``tight`` of the whole sample's is left whole:
    in such a ball any cut parts true neighbours. A split more uneven than one to eight whose means lie near each
    other is made at the median of the line between them, so that leaves stay balanced.
    """
    rng = np.random.default_rng(seed)
    sample = np.asarray(sample, np.float32)
    radius = lambda x: float(((x - x.mean(0)) ** 2).sum(1).mean())
    small = tight * radius(sample)
    todo, done = [np.arange(len(sample))], []
    while todo:
        rows = todo.pop()
        x = sample[rows]
        if len(rows) <= max(2, leaf) or (x == x[0]).all() or (len(rows) <= ball and radius(x) <= small):
            done.append(x.mean(0, dtype=np.float64))
            continue
        two = x[rng.choice(len(x), 2, replace=False)]
        for _ in range(rounds):
            left = squared(x, two)
            left = left[:, 0] < left[:, 1]
            if left.all() or not left.any():
                break
            two = np.stack([x[left].mean(0), x[~left].mean(0)])
        uneven = min(left.sum(), (~left).sum()) * 9 < len(x)
        if uneven and ((two[0] - two[1]) ** 2).sum() < 4 * radius(x):
            along = x @ (two[1] - two[0]) if (two[0] != two[1]).any() else x @ rng.normal(size=x.shape[1]).astype(np.float32)
            order = np.argsort(along, kind="stable")
            left = np.zeros(len(x), bool)
            left[order[: len(x) // 2]] = True
        todo += [rows[left], rows[~left]]
    return np.stack(done).astype(np.float32)


class CentroidGraph:
    """Graph over centroids, searched for whole batches at once: entry points link to the centroids that have them among
    their nearest, every centroid to its own nearest.

    Links from an entry are drawn from the centroids' side, so each centroid is reached from ``back`` entries; with
    links to the entry's nearest only, most would be reached from none (a few are near to everything)."""

    def __init__(self, centroids: np.ndarray, degree: int = 12, entries: int = 0, back: int = 4, seed: int = 17):
        self.c = np.asarray(centroids, np.float64)
        n = len(self.c)
        entries = min(n, entries or int(4 * n**0.5))
        self.entries = np.sort(np.random.default_rng(seed).choice(n, entries, replace=False)).astype(np.int32)
        self.middle = self.c.mean(0).astype(np.float32)
        held = self.c - self.middle  # products about the middle lose less in single precision; kept distances are taken anew
        self.turned, self.square = np.ascontiguousarray(-2 * held.T, np.float32), (held * held).sum(1).astype(np.float32)
        self.visited = 0
        degree, back = min(degree, n), min(back, entries)
        near = np.empty((n, degree), np.int64)
        home = np.empty((n, back), np.int64)
        for s in range(0, n, 1024):
            d = squared(self.c[s : s + 1024], self.c)
            near[s : s + 1024] = np.argsort(d, axis=1, kind="stable")[:, :degree]
            home[s : s + 1024] = np.argsort(d[:, self.entries], axis=1, kind="stable")[:, :back]
        order = np.argsort(home.ravel(), kind="stable")
        ends = np.searchsorted(home.ravel()[order], np.arange(entries + 1))
        # each link list also has what is nearest to its members, so that lists overlap where entries lie side by side
        self.links = [np.unique(near[order[a:b] // back].ravel()).astype(np.int32) for a, b in zip(ends[:-1], ends[1:])]

    def within(self, x: np.ndarray, ratio: float, floor: int = 1, starts: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, centroid, squared distance) sorted by (row, distance, centroid), and the least distance of each row:
        the visited centroids within ``ratio`` times the row's least distance, the ``floor`` (1 or 2) nearest in any case.

        A row visits what its ``starts`` nearest entries link to, a product for all rows of an entry; only those
        distances are held."""
        n = len(x)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)
        y = np.asarray(x, np.float32) - self.middle
        d = y @ self.turned[:, self.entries] + self.square[self.entries]
        self.visited += d.size
        starts = min(starts, d.shape[1])
        first = np.argpartition(d, starts - 1, axis=1)[:, :starts]
        order = np.argsort(first.ravel(), kind="stable")
        cuts = np.searchsorted(first.ravel()[order], np.arange(len(self.entries) + 1))
        low = np.full((n, starts * 2), np.inf, np.float32)
        blocks = []
        for e in range(len(self.entries)):
            at = order[cuts[e] : cuts[e + 1]]
            to = self.links[e]
            if len(at) and len(to):
                rows, s = at // starts, at % starts
                d = y[rows] @ self.turned[:, to] + self.square[to]
                self.visited += d.size
                j = d.argmin(1)
                low[rows, 2 * s] = d[np.arange(len(j)), j]
                blocks.append((rows, to, d))
                if floor > 1 and len(to) > 1:
                    low[rows, 2 * s + 1] = np.partition(d, 1, axis=1)[:, 1]
        own = (y * y).sum(1)
        least = low[:, ::2].min(1) + own
        bound = np.maximum(least, 0) * ratio**2 * (1 + 1e-4) + 1e-3 * (1 + own * 1e-3) - own
        if floor > 1:  # the second of any start is at most this far
            bound = np.maximum(bound, low[:, 1::2].min(1))
        keys = []
        for rows, to, d in blocks:
            r, c = np.nonzero(d <= bound[rows][:, None])
            keys.append(rows[r] * len(self.c) + to[c])
        key = np.unique(np.concatenate(keys))
        r, c = key // len(self.c), key % len(self.c)
        diff = np.asarray(x, np.float64)[r] - self.c[c]
        exact = np.einsum("ij,ij->i", diff, diff)
        order = np.lexsort((c, exact, r))
        r, c, exact = r[order], c[order], exact[order]
        least = exact[np.searchsorted(r, np.arange(n))]
        keep = (exact <= least[r] * ratio**2) | (np.arange(len(r)) - np.searchsorted(r, r) < floor)
        return r[keep], c[keep], exact[keep], least
