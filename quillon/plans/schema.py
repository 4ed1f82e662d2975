"""Schemas of the data model and checks on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class DimensionError(ValueError):
    pass


def vectors_of(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, embedding) without rows whose id or vector is null."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("embedding")).filter("id is not null and embedding is not null")


def dimension(vectors: DataFrame) -> int:
    """The one dimension of all vectors; 0 for none. Raises DimensionError for more than one or for 0 components."""
    lo, hi = vectors.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if lo is None:
        return 0
    if lo != hi or lo == 0:
        raise DimensionError(f"vectors have {lo} to {hi} components")
    return lo
