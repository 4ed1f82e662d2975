"""Reciprocal rank fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexical import ranked_by_score


def reciprocal_rank_fusion(lists: list[DataFrame], k: int = 10, rrf_k: float = 60.0) -> DataFrame:
    """Merges ranked lists (query_id, id, rank): only ranks enter. An id twice in one list counts twice; ids tied
    at single precision go by id."""
    rows = reduce(DataFrame.unionByName, [x.select("query_id", "id", "rank") for x in lists])
    return ranked_by_score(rows.groupBy("query_id", "id").agg(F.sum(1.0 / (rrf_k + F.col("rank"))).alias("score")), k)
