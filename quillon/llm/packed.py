"""Vectors packed into binary: one byte a component where all are whole numbers 0..255, else float32.

Packing quarters what is shuffled and makes equal vectors equal keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that are usable vectors of ``dim`` components, as (row numbers, matrix)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.empty(0, np.int64), np.empty((0, dim), np.float32)
    offsets = np.asarray(column.offsets)
    rows = np.nonzero((np.diff(offsets) == dim) & np.asarray(column.is_valid()))[0]
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    if not len(rows):
        return rows, np.empty((0, dim), np.float32)
    x = values[offsets[rows][:, None] + np.arange(dim)] + np.float32(0)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return rows[good], x[good]


def pack(x: np.ndarray) -> pa.Array:
    """A binary array of the rows of ``x``."""
    small = ((x >= 0) & (x <= 255) & (x == np.floor(x))).all(1)
    if small.all():
        n, d = x.shape
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * d).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x.astype(np.uint8)))])
    return pa.array([r.astype(np.uint8).tobytes() if s else r.astype("<f4").tobytes() for r, s in zip(x, small)], pa.binary())


def unpack(column: pa.Array, dim: int) -> np.ndarray:
    """The float32 matrix of a packed column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_large_binary(column.type):
        column = column.cast(pa.binary())
    n = len(column)
    if not n:
        return np.empty((0, dim), np.float32)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int32, n + 1, column.offset * 4)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.empty(0, np.uint8)
    if (np.diff(offsets) == dim).all():
        return data[offsets[0] : offsets[-1]].reshape(n, dim).astype(np.float32)
    return np.stack([np.frombuffer(b, np.uint8 if len(b) == dim else "<f4").astype(np.float32) for b in column.to_pylist()])


def usable(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, v): one packed vector of each id that has a usable one.

    Usable: not null, ``dim`` components, none null, NaN or infinite, not all zero. A null id is dropped;
    an id stored with several different vectors keeps the smallest packed one.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, x = list_matrix(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pack(x)], ["id", "v"])

    plain = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("e")).filter("id is not null and e is not null")
    return plain.mapInArrow(of, "id long, v binary").groupBy("id").agg(F.min("v").alias("v"))


def distinct_vectors(ids: DataFrame) -> DataFrame:
    """(v, rep, n): each different vector once, with its smallest id and the number of its ids."""
    return ids.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
