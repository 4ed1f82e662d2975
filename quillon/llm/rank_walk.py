"""One ranking from several differently scaled score lists, by a random walk over ranks.

From an item the walk picks one of the query's counting lists and jumps uniformly to an item that the list
ranks at least as high; from an item the list does not hold it jumps uniformly into the list. With
probability ``1 - damping`` it jumps to any item of the query. Items are ordered by their stationary
probability. Only ranks enter, so no list weighs more for the range of its scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import written

SCHEMA = "query_no long, id long, position int, stationarity double, lists_in int, worst_rank long, n_lists int, head_bound double"
#: Decimals of stationarity times the query's items that decide the order: the same part of the mean at any number of items.
DIGITS = 10


def counting_scores(ranked: DataFrame, queries: DataFrame, lists: DataFrame) -> DataFrame:
    """(query_no, list_id, id, dist): the best usable score of each item in each list that counts."""
    rows = (
        ranked.select("query_no", "list_id", "id", F.col("dist").cast("double").alias("dist"))
        .filter("query_no is not null and list_id is not null and id is not null and dist is not null and not isnan(dist)")
        .groupBy("query_no", "list_id", "id")
        .agg(F.min("dist").alias("dist"))
    )
    images = lists.filter("is_image").select("list_id").distinct()
    gated = queries.filter("query_no is not null and alpha > 0 and not isnan(alpha)").select("query_no").distinct()
    plain = rows.join(images, "list_id", "left_anti")
    return plain.unionByName(rows.join(images, "list_id", "left_semi").join(gated, "query_no", "left_semi"))


def walk(q: np.ndarray, lists: np.ndarray, item: np.ndarray, damping: float, tol: float, max_iter: int, head: int = 5) -> tuple[np.ndarray, ...]:
    """Ranks whole queries at once. Rows come sorted by (query, list, dist, id); returns SCHEMA's columns. A query stops
    when it moves by less than ``tol``, whatever queries are ranked beside it."""
    n = len(q)
    start = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (lists[1:] != lists[:-1])])
    length = np.diff(np.r_[start, n])
    seg = np.repeat(np.arange(len(start)), length)
    rank = np.arange(n) - start[seg] + 1
    order = np.lexsort((item, q))
    new = np.r_[True, (q[order][1:] != q[order][:-1]) | (item[order][1:] != item[order][:-1])]
    at = np.empty(n, np.int64)
    at[order] = np.cumsum(new) - 1
    iq, ii = q[order][new], item[order][new]
    _, qi, per = np.unique(iq, return_inverse=True, return_counts=True)
    seg_q = qi[at[start]]
    n_lists = np.bincount(seg_q, minlength=len(per))
    weight = 1.0 / n_lists[seg_q]
    last = start + length - 1
    x = 1.0 / per[qi]
    heads = start + np.minimum(length, head) - 1

    def step(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next probabilities, and the least that an item among the first ``head`` of every list has of them."""
        held = x[at]
        ahead = np.cumsum((held / rank)[::-1])[::-1]
        ahead = ahead - (ahead[last] - (held / rank)[last])[seg]  # sums from each rank to its list's end
        missing = np.maximum(1.0 - np.add.reduceat(held, start), 0.0)
        pushed = (ahead + (missing / length)[seg]) * weight[seg]
        y = damping * np.bincount(at, pushed, len(x)) + (1 - damping) / per[qi]
        whole = np.bincount(qi, y)
        return y / whole[qi], (damping * np.bincount(seg_q, pushed[heads]) + (1 - damping) / per) / whole

    live = np.ones(len(per), bool)
    for _ in range(max_iter):
        y, _ = step(x)
        moved = np.bincount(qi, np.abs(y - x))
        x = np.where(live[qi], y, x)
        live &= moved >= tol
        if not live.any():
            break
    x, bound = step(x)
    x = np.round(x * per[qi], DIGITS) / per[qi]
    bound = (bound * per * (1 - 1e-12) - 10.0**-DIGITS) / per
    best = np.lexsort((ii, -x, qi))
    position = np.empty(len(x), np.int32)
    position[best] = np.arange(len(x)) - np.r_[0, np.cumsum(per)][qi[best]] + 1
    worst = np.zeros(len(x), np.int64)
    np.maximum.at(worst, at, rank)
    return iq, ii, position, x, np.bincount(at, minlength=len(x)).astype(np.int32), worst, n_lists[qi].astype(np.int32), bound[qi]


def rank_walk(ranked: DataFrame, queries: DataFrame, lists: DataFrame, damping: float = 0.85, tol: float = 1e-9, max_iter: int = 200, hot_rows: int = 500_000, head: int = 5) -> DataFrame:
    """Every scored item of every query in one order: SCHEMA's columns.

    A list counts for a query if it holds a usable ``dist`` (not null, not NaN) and is no image list, or
    the query's ``alpha`` is above 0; an unknown list is no image list. Within a list an item has its least
    ``dist``, ties go to the smaller id; infinite values are ordinary extremes. Rows with a null key are
    ignored; equal stationarity is ordered by id; empty inputs give no rows. ``worst_rank`` is the item's
    lowest place in the lists that hold it. ``head_bound`` is the least stationarity of an item that is among the first
    ``head`` of every list: what flows to an item from a list falls with its rank there, so it has at least what the
    ``head``-th of each list gets.

    A query with more than ``hot_rows`` rows is walked by distributed block sums, any other whole within
    a task that holds at most about two such queries.
    """
    scores = counting_scores(ranked, queries, lists)
    rows = scores.columns
    sizes = ranked.groupBy("query_no").count().filter(F.col("count") > hot_rows).select("query_no")
    has_hot = bool(sizes.head(1))
    cool = scores.join(sizes, "query_no", "left_anti") if has_hot else scores

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(table: pa.Table) -> pa.RecordBatch:
            cols = walk(*(table.column(c).to_numpy() for c in ("query_no", "list_id", "id")), damping, tol, max_iter, head)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [x.split()[0] for x in SCHEMA.split(", ")])

        kept: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            kept.append(b)
            if sum(x.num_rows for x in kept) >= 200_000:
                t = pa.Table.from_batches(kept)
                q = t.column("query_no").to_numpy()
                cut = int(np.searchsorted(q, q[-1]))
                if cut:
                    yield out(t.slice(0, cut))
                    t = t.slice(cut)
                kept = t.to_batches()
        if kept:
            yield out(pa.Table.from_batches(kept))

    sorted_ = cool.repartition("query_no").sortWithinPartitions("query_no", "list_id", "dist", "id").select(*rows)
    ranked_ = sorted_.select("query_no", F.col("list_id").cast("long").alias("list_id"), "id").mapInArrow(of, SCHEMA)
    return ranked_.unionByName(walk_distributed(scores.join(sizes, "query_no", "left_semi"), damping, tol, max_iter, head=head)) if has_hot else ranked_


def walk_distributed(scores: DataFrame, damping: float = 0.85, tol: float = 1e-9, max_iter: int = 200, block: int = 50_000, head: int = 5) -> DataFrame:
    """The same walk for queries too large for a task: ranks from a range sort, sums ahead from block sums."""
    key = ["query_no", "list_id"]
    part = scores.repartitionByRange("query_no", "list_id", "dist", "id").withColumn("part", F.spark_partition_id())
    part = written(part, "walk-sorted")
    within = Window.partitionBy(*key, "part").orderBy("dist", "id")
    counts = part.groupBy(*key, "part").count()
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy(*key).orderBy("part")) - F.col("count")).drop("count")
    rows = part.withColumn("nth", F.row_number().over(within)).join(before, [*key, "part"])
    rows = rows.select(*key, "id", (F.col("nth") + F.col("before")).alias("r")).withColumn("block", F.floor((F.col("r") - 1) / block))
    rows = written(rows, "walk-ranks")
    lists = rows.groupBy(*key).agg(F.count("*").alias("len"))
    queries = lists.groupBy("query_no").agg(F.count("*").cast("int").alias("n_lists"))
    items = written(rows.groupBy("query_no", "id").agg(F.count("*").cast("int").alias("lists_in"), F.max("r").alias("worst_rank")), "walk-items")
    n_items = items.groupBy("query_no").agg(F.count("*").alias("n_items"))
    x = written(items.join(n_items, "query_no").select("query_no", "id", (1 / F.col("n_items")).alias("x")), "walk-x")

    def step(x: DataFrame) -> tuple[DataFrame, DataFrame]:
        held = rows.join(x, ["query_no", "id"]).withColumn("y", F.col("x") / F.col("r"))
        sums = held.groupBy(*key, "block").agg(F.sum("y").alias("s"), F.sum("x").alias("m"))
        later = Window.partitionBy(*key).orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select(*key, "block", F.coalesce(F.sum("s").over(later), F.lit(0.0)).alias("later"), F.sum("m").over(Window.partitionBy(*key)).alias("held"))
        ahead = Window.partitionBy(*key, "block").orderBy(F.desc("r"))
        pushed = held.withColumn("ahead", F.sum("y").over(ahead)).join(sums, [*key, "block"]).join(lists, key)
        pushed = pushed.withColumn("p", F.col("ahead") + F.col("later") + F.greatest(1 - F.col("held"), F.lit(0.0)) / F.col("len"))
        grown = lambda p: (damping * p / F.col("n_lists") + (1 - damping) / F.col("n_items"))
        sized = queries.join(n_items, "query_no")
        y = pushed.groupBy("query_no", "id").agg(F.sum("p").alias("p")).join(sized, "query_no").select("query_no", "id", grown(F.col("p")).alias("y"))
        heads = pushed.filter(F.col("r") == F.least(F.col("len"), F.lit(head))).groupBy("query_no").agg(F.sum("p").alias("p")).join(sized, "query_no")
        return y, heads.select("query_no", (grown(F.col("p")) * (1 - 1e-9) - 10.0**-DIGITS / F.col("n_items")).alias("head_bound"))

    ended: list = []  # queries that stand still: no more than rows / hot_rows
    for _ in range(max_iter):
        both = written(step(x)[0].join(x, ["query_no", "id"]), "walk-x")
        moved = both.groupBy("query_no").agg(F.sum(F.abs(F.col("y") - F.col("x"))).alias("d")).collect()
        x = both.select("query_no", "id", F.when(F.col("query_no").isin(ended), F.col("x")).otherwise(F.col("y")).alias("x"))
        ended = sorted({*ended, *(r["query_no"] for r in moved if r["d"] < tol)})
        if len(ended) == len(moved):
            break
    x, bounds = step(written(x, "walk-x"))
    x = x.withColumnRenamed("y", "x")
    x = x.join(n_items, "query_no").select("query_no", "id", (F.round(F.col("x") * F.col("n_items"), DIGITS) / F.col("n_items")).alias("x"))
    part = written(x.repartitionByRange("query_no", F.desc("x"), "id").withColumn("part", F.spark_partition_id()), "walk-order")
    counts = part.groupBy("query_no", "part").count()
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("query_no").orderBy("part")) - F.col("count")).drop("count")
    placed = part.withColumn("nth", F.row_number().over(Window.partitionBy("query_no", "part").orderBy(F.desc("x"), "id"))).join(before, ["query_no", "part"])
    return placed.join(items, ["query_no", "id"]).join(queries, "query_no").join(bounds, "query_no").select("query_no", "id", (F.col("nth") + F.col("before")).cast("int").alias("position"), F.col("x").alias("stationarity"), "lists_in", "worst_rank", "n_lists", "head_bound")


def agreed_heads(walked: DataFrame, top: int = 5) -> DataFrame:
    """(query_no, id): of queries with two or more counting lists, the items among the first ``top`` of each. Candidates
    are the items whose stationarity reaches ``head_bound`` (``top`` as the walk's ``head``), below which none can be."""
    found = walked.filter(F.col("stationarity") >= F.col("head_bound"))
    return found.filter((F.col("n_lists") >= 2) & (F.col("lists_in") == F.col("n_lists")) & (F.col("worst_rank") <= top)).select("query_no", "id")
