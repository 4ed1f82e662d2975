"""The .fvecs and .ivecs formats as Spark data sources: ``spark.read.format("fvecs")``, ``df.write.format("fvecs")``.

A record is a little-endian int32 dimension and as many float32 (fvecs) or int32 (ivecs) values. Files are cut into
record ranges, so a large file is read by many tasks.
"""

from __future__ import annotations

import glob
import os
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

MOST_DIM = 100_000


def header(path: str) -> tuple[int, int]:
    """(dim, records) of a file; an error unless the size is whole records of a sensible dimension."""
    size = os.path.getsize(path)
    if size < 4:
        raise ValueError(f"{path}: {size} bytes hold no record")
    with open(path, "rb") as f:
        dim = int(np.frombuffer(f.read(4), "<i4")[0])
    if not 0 < dim <= MOST_DIM:
        raise ValueError(f"{path}: dimension {dim}")
    if size % (4 + 4 * dim):
        raise ValueError(f"{path}: {size} bytes are no whole records of {dim} values")
    return dim, size // (4 + 4 * dim)


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://").removeprefix("file:")
    return sorted(glob.glob(f"{path}/part-*")) if os.path.isdir(path) else [path]


@dataclass
class Range(InputPartition):
    path: str
    first: int
    count: int
    id0: int


class _Reader(DataSourceReader):
    def __init__(self, options, kind: str):
        self.files = _files(options["path"])
        self.most = int(options.get("max_count", 0))
        self.chunk = int(options.get("records_per_partition", 200_000))
        self.kind = kind

    def partitions(self):
        out, id0, dims = [], 0, set()
        for path in self.files:
            dim, n = header(path)
            dims.add(dim)
            for first in range(0, n, self.chunk):
                count = min(self.chunk, n - first)
                if self.most:
                    count = min(count, self.most - id0)
                if count > 0:
                    out.append(Range(path, first, count, id0))
                    id0 += count
        if len(dims) > 1:
            raise ValueError(f"files of several dimensions: {sorted(dims)}")
        return out or [Range("", 0, 0, 0)]

    def read(self, part):
        if not part.count:
            return
        dim, _ = header(part.path)
        width = 4 + 4 * dim
        with open(part.path, "rb") as f:
            f.seek(part.first * width)
            left, id0 = part.count, part.id0
            while left:
                n = min(left, 20_000)
                raw = np.frombuffer(f.read(n * width), "<i4").reshape(n, dim + 1)
                if (raw[:, 0] != dim).any():
                    raise ValueError(f"{part.path}: a record near {id0} has another dimension than {dim}")
                values = np.ascontiguousarray(raw[:, 1:])
                flat = pa.array((values.view("<f4") if self.kind == "f" else values).ravel())
                lists = pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * dim).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(id0, id0 + n)), lists], names=["id" if self.kind == "f" else "query_id", "embedding" if self.kind == "f" else "neighbors"])
                left, id0 = left - n, id0 + n


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class _Writer(DataSourceWriter):
    """Rows of each task in their order, one part file; read back in the order of the file names."""

    def __init__(self, options, kind: str, overwrite: bool):
        self.path = options["path"].removeprefix("file://").removeprefix("file:")
        self.kind = kind
        os.makedirs(self.path, exist_ok=True)
        self.old = glob.glob(f"{self.path}/part-*") if overwrite else []

    def write(self, rows):
        from pyspark import TaskContext

        n, dim = 0, None
        name = f"{self.path}/.part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}"
        with open(name, "wb") as f:
            for row in rows:
                values = np.asarray(row[1], "<f4" if self.kind == "f" else "<i4")
                dim = dim or len(values)
                if len(values) != dim or not dim:
                    raise ValueError(f"a row has {len(values)} values, not {dim}")
                f.write(np.array([dim], "<i4").tobytes() + values.tobytes())
                n += 1
        if not n:
            os.remove(name)
            return Written(None)
        return Written(name)

    def commit(self, messages):
        for f in self.old:  # only when the new files are whole
            os.remove(f)
        for m in messages:
            if m is not None and m.path:
                os.rename(m.path, os.path.join(os.path.dirname(m.path), os.path.basename(m.path)[1:]))

    def abort(self, messages):
        for m in messages:
            if m is not None and m.path and os.path.exists(m.path):
                os.remove(m.path)


class FvecsSource(DataSource):
    kind = "f"

    @classmethod
    def name(cls):
        return "fvecs"

    def schema(self):
        return "id bigint, embedding array<float>"

    def reader(self, schema):
        return _Reader(self.options, self.kind)

    def writer(self, schema, overwrite):
        return _Writer(self.options, self.kind, overwrite)


class IvecsSource(FvecsSource):
    kind = "i"

    @classmethod
    def name(cls):
        return "ivecs"

    def schema(self):
        return "query_id bigint, neighbors array<int>"


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FvecsSource)
    spark.dataSource.register(IvecsSource)
