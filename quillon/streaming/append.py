"""Incremental insert: each micro-batch gets the next ids and becomes a new published version.

Searches read one manifest and so one version; a batch that fails publishes nothing. A batch that Spark hands over
again after a failure is recognised by its number and not added twice.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import snapshot
from ..plans.lineage import written
from ..sources.textfiles import numbered


def append_batch(root: str, kind: str = "vectors", dim: int = 0, compact: int = 16) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: adds a batch to the snapshot at ``root``.

    Rows without an ``id`` column get the ids that follow the largest one, in the order of their vectors. With one,
    ids that are there already, null ids and null vectors are left out; of rows of one id in a batch the smallest
    vector stands. When ``compact`` batches lie side by side they are written together, so that reads and the check of ids
    meet a bounded number of tables."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        carry, known, start = None, None, 0
        if snapshot.versions(spark, root):
            tables, manifest = snapshot.load(spark, root, kind, verify=False)
            if number <= manifest["params"].get("last_batch", -1):
                return
            carry = manifest["tables"]
            known = reduce(DataFrame.unionByName, (t.select("id", "embedding") for t in tables.values()))
            start = manifest["params"].get("next_id", 0)
        if "id" in batch.columns:
            fresh = batch.filter("id is not null and embedding is not null").groupBy("id").agg(F.min("embedding").alias("embedding"))
            fresh = fresh if known is None else fresh.join(known.select("id"), "id", "left_anti")
        else:
            fresh = numbered(batch.filter("embedding is not null").select("embedding"), "embedding", start)
        fresh = written(fresh.select("id", "embedding"), "append")
        last = fresh.agg(F.max("id")).first()[0]
        params = {"last_batch": number, "next_id": max(start, start if last is None else last + 1)}
        if carry is not None and len(carry) >= compact:
            fresh, carry = known.unionByName(fresh), None
        snapshot.save({f"batch_{number}": fresh}, root, kind, dim, params, carry)

    return add


def run_available(stream: DataFrame, root: str, checkpoint: str, kind: str = "vectors", dim: int = 0) -> None:
    """Takes in all that a stream of (id, embedding) has, then stops."""
    query = stream.writeStream.foreachBatch(append_batch(root, kind, dim)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def current(spark: SparkSession, root: str, kind: str = "vectors") -> DataFrame:
    """(id, embedding) of the newest version."""
    return reduce(DataFrame.unionByName, (t.select("id", "embedding") for t in snapshot.load(spark, root, kind)[0].values()))
