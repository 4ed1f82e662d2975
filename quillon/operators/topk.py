"""Bounded ranking by (dist, id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def topk_per(df: DataFrame, k: int, partition: str | list[str] = "query_id", order: tuple[str, ...] = ("dist", "id")) -> DataFrame:
    """The k first rows of each group with their 1-based ``rank``; none for k <= 0. NaN distances come last.

    The rank filter is pushed below the shuffle (WindowGroupLimit), so each task sends at most k rows a group."""
    if k <= 0:
        return df.limit(0).withColumn("rank", F.lit(0))
    keys = [partition] if isinstance(partition, str) else partition
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def topk_global(df: DataFrame, k: int, order: tuple[str, ...] = ("dist", "id")) -> DataFrame:
    """The k first rows of all, without a full sort."""
    return df.orderBy(*order).limit(max(k, 0))
