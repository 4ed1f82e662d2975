"""Distances as column expressions. Smaller is better everywhere; L2 is squared, inner product negated."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Above this the unrolled form would outgrow the JVM's method size, and the higher-order form is used.
UNROLL_LIMIT = 128


def _sum_of(a: Column, b: Column, dim: int | None, one: Callable[[Column, Column], Column]) -> Column:
    if dim is not None and dim <= UNROLL_LIMIT:
        return reduce(lambda s, x: s + x, (one(a[i].cast("double"), b[i].cast("double")) for i in range(dim)))
    return F.aggregate(F.zip_with(a, b, lambda x, y: one(x.cast("double"), y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def l2_sq(a: Column, b: Column, dim: int | None = None) -> Column:
    """Squared L2 distance, summed in component order; with ``dim`` as one generated expression."""
    return _sum_of(a, b, dim, lambda x, y: (x - y) * (x - y))


def neg_ip(a: Column, b: Column, dim: int | None = None) -> Column:
    """Negated inner product."""
    return -_sum_of(a, b, dim, lambda x, y: x * y)


def norm_sq(v: Column, dim: int | None = None) -> Column:
    return _sum_of(v, v, dim, lambda x, y: x * y)


def l2_normalize(v: Column) -> Column:
    """The vector at length 1; null for the zero vector."""
    n = F.sqrt(norm_sq(v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def neg_cosine(a: Column, b: Column, dim: int | None = None) -> Column:
    """Negated cosine; null where either vector is zero."""
    scale = F.sqrt(norm_sq(a, dim)) * F.sqrt(norm_sq(b, dim))
    return F.when(scale > 0, neg_ip(a, b, dim) / scale)


METRICS: dict[str, Callable[..., Column]] = {"l2": l2_sq, "ip": neg_ip, "cosine": neg_cosine}


def distance(metric: str | Callable[..., Column], a: Column, b: Column, dim: int | None = None) -> Column:
    """By name, or by a function of (a, b, dim)."""
    if callable(metric):
        return metric(a, b, dim)
    if metric not in METRICS:
        raise ValueError(f"metric {metric!r} is none of {sorted(METRICS)}")
    return METRICS[metric](a, b, dim)
