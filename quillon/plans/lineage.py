"""Cutting lineage through tables in the folder that all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``; only in local mode (tests, a laptop) a folder
of our own is made where that is unset and set for the session, on a cluster it is an error.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder, as a URI or path that every executor can reach."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quillon-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    _MADE.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}")
    return _MADE[-1]


def clear(spark: SparkSession) -> None:
    """Removes all that was written here by this process; for when no result that reads it is needed any more."""
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    while _MADE:
        path = jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: no lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
