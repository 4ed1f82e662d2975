"""Mixing sources to target shares of the tokens.

Every source is cut into hash-ordered blocks. Which blocks are used how often follows from exact token sums; a
splitting tree divides each source's block uses among output shards by multivariate hypergeometric draws, so
every shard holds a fair share of every source and the totals are exact; the blocks of a shard are disjoint
and its records are put in a random order locally.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import written
from .merge_replay import DEFAULT_RANKS, with_token_counts


def source_key(column):
    return F.lower(F.trim(column))


def measured(documents: DataFrame, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(doc_id, source, tokens, digest): each row of documents; ``source`` without case and outer blanks, ``digest`` of the
    text."""
    rows = documents.select("doc_id", source_key(F.col("source")).alias("source"), F.xxhash64("text").alias("digest"), "text")
    return with_token_counts(rows, ranks=ranks)


def targets(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    """One row for each source of the plan: (source, weight, max_repeats, tokens, target, used, share, short).

    ``target`` is ``weight`` times the tokens of all documents, of whatever source; ``used`` is what
    ``max_repeats`` allows of it, ``share`` its part of all that is used, ``short`` whether it is less. A
    source without documents has 0 tokens. A source named twice in the plan has its weights added and the
    larger number of repeats; null weights and repeats count as 0.
    """
    plan = plan.groupBy(source_key(F.col("source")).alias("source")).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))
    per = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    total = per.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all"))
    rows = plan.filter("source is not null").join(per, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).crossJoin(F.broadcast(total))  # one row
    most = F.col("tokens") * F.col("max_repeats")
    rows = rows.withColumn("target", F.col("weight") * F.col("all")).withColumn("used", F.least("target", most.cast("double"))).withColumn("short", most < F.col("target"))
    share = rows.agg(F.sum("used").alias("mixed"))
    return rows.crossJoin(F.broadcast(share)).select("source", "weight", "max_repeats", "tokens", "target", "used", F.when(F.col("mixed") > 0, F.col("used") / F.col("mixed")).otherwise(F.lit(0.0)).alias("share"), "short")  # one row


def split_quotas(blocks: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Block uses of each (shard, source) by halving: at each node of the tree the left half's uses are one
    multivariate hypergeometric draw from the node's, of half of them."""
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(blocks)), np.int64)

    def divide(held: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = held
            return
        mid = (lo + hi) // 2
        take = int(round(held.sum() * (mid - lo) / (hi - lo)))
        left = rng.multivariate_hypergeometric(held, take, method="marginals") if take else np.zeros_like(held)
        divide(left, lo, mid)
        divide(held - left, mid, hi)

    divide(blocks.astype(np.int64), 0, shards)
    return out


@dataclass
class Blocks:
    """What ``mix`` draws from: goals (a row for each source of the plan), marked documents, used blocks, and the tree's
    leaves: (names, quota of block uses by shard and source, most uses by source)."""

    goals: DataFrame
    docs: DataFrame
    use: DataFrame
    names: list[str]
    quota: np.ndarray
    most: np.ndarray


def plan_blocks(documents: DataFrame, plan: DataFrame, ranks: str, shards: int, block_docs: int, most_blocks: int, seed: int, sizes: DataFrame | None) -> Blocks:
    """Cuts sources into blocks, settles how often each is used, and divides the uses among shards by the splitting tree."""
    sizes = sizes if sizes is not None else written(measured(documents, ranks), "mix-sizes")
    goals = written(targets(sizes, plan), "mix-goals")
    want = goals.select("source", "tokens", "max_repeats", "used")
    counts = sizes.groupBy("source").agg(F.count("*").alias("docs"))
    per = want.join(counts, "source").filter("tokens > 0 and used > 0")
    per = per.withColumn("blocks", F.least(F.ceil(F.col("docs") / block_docs), F.lit(most_blocks)).cast("int"))
    per = per.withColumn("passes", F.floor(F.col("used") / F.col("tokens")).cast("int")).withColumn("rest", F.col("used") - F.col("passes") * F.col("tokens"))
    per = written(per.drop("docs"), "mix-plan")  # one row for each source of the plan
    # equal rows are numbered by their count, so that marks depend on content only, not on files or partitions
    same = sizes.filter("tokens > 0").groupBy("doc_id", "source", "tokens", "digest").agg(F.count("*").alias("copies"))
    rows = same.select("doc_id", "source", "tokens", "digest", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    mark = F.xxhash64(F.lit(seed), "doc_id", "digest", "copy")
    docs = rows.join(F.broadcast(per.select("source", "blocks")), "source").withColumn("mark", mark).withColumn("block", F.pmod("mark", F.col("blocks")).cast("int")).drop("blocks", "digest", "copy")
    docs = written(docs, "mix-docs")
    sums = docs.groupBy("source", "block").agg(F.sum("tokens").alias("t"))
    before = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("t").over(before), F.lit(0))).join(F.broadcast(per), "source")  # at most most_blocks rows a source
    use = sums.select("source", "block", "before", "t", "passes", "rest", "max_repeats", F.when(F.col("before") < F.col("rest"), F.col("passes") + 1).otherwise(F.col("passes")).alias("uses"))
    use = written(use, "mix-blocks")
    total = {r["source"]: (r["n"], r["most"]) for r in use.groupBy("source").agg(F.sum("uses").alias("n"), F.sum("max_repeats").alias("most")).collect()}
    names = sorted(total)
    quota = split_quotas(np.array([total[s][0] for s in names], np.int64), shards, seed) if names else np.zeros((shards, 0), np.int64)
    return Blocks(goals, docs, use.filter("uses > 0"), names, quota, np.array([total[s][1] for s in names], np.int64))


def short_sources(documents: DataFrame, plan: DataFrame, ranks: str = DEFAULT_RANKS, shards: int = 16, block_docs: int = 64, most_blocks: int = 65_536, seed: int = 42) -> DataFrame:
    """(source): sources of the plan that cannot reach their weight. Candidates are those of whose blocks the tree's leaves
    hold every allowed use (a source that falls short is used up); exact token sums then decide."""
    b = plan_blocks(documents, plan, ranks, shards, block_docs, most_blocks, seed, None)
    drawn = b.quota.sum(axis=0)
    left = [n for n, d, m in zip(b.names, drawn, b.most) if d < m]  # sources of the plan only
    return b.goals.filter(~F.col("source").isin(left) & F.col("short")).select("source")


def mix(documents: DataFrame, plan: DataFrame, ranks: str = DEFAULT_RANKS, shards: int = 16, block_docs: int = 64, most_blocks: int = 65_536, seed: int = 42, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, report). The selection has (doc_id, source, repeat, shard, place): each use of a document.

    A source of which f whole passes and a rest are wanted gives each document f times and, in hash order
    of its blocks, further documents up to the target, the last included if at least half of it is within:
    the share is met to half a document. No document is used more than ``max_repeats`` times. Documents
    without a source of the plan, and those of no tokens, are not selected. The report has, besides
    ``targets``' columns, ``reached`` (tokens of the selection), ``documents`` (uses) and ``actual`` share.
    Null ids are kept as documents of their own; empty tables give an empty selection.

    A source has ``block_docs`` documents a block or, above ``most_blocks`` blocks, so many more: the driver
    holds block counts by source and quotas by shard only.
    """
    cut_up = plan_blocks(documents, plan, ranks, shards, block_docs, most_blocks, seed, sizes)
    goals, docs, use, names, quota = cut_up.goals, cut_up.docs, cut_up.use, cut_up.names, cut_up.quota
    spark = documents.sparkSession
    ends = np.cumsum(quota, axis=0)
    bounds = [(s, k, int(ends[k, i] - quota[k, i]), int(ends[k, i])) for i, s in enumerate(names) for k in range(shards) if quota[k, i]]
    bounds_df = F.broadcast(spark.createDataFrame(bounds, "source string, shard int, lo long, hi long"))  # shards x sources rows
    uses = use.select("source", "block", F.explode(F.sequence(F.lit(0), F.col("uses") - 1)).alias("repeat"))
    drawn = uses.withColumn("nth", F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "source", "block", "repeat"), "block", "repeat")) - 1)
    drawn = drawn.join(bounds_df, "source").filter("nth >= lo and nth < hi").select("source", "block", "repeat", "shard")
    inside = Window.partitionBy("source", "block").orderBy("mark", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    cut = use.filter("before < rest and before + t > rest").select("source", "block", "before", "rest", "passes")  # one block of each source
    placed = docs.join(drawn, ["source", "block"]).join(F.broadcast(cut), ["source", "block"], "left")
    whole = placed.filter("rest is null or repeat < passes").select("doc_id", "source", "repeat", "shard", "tokens", "mark")
    edge = docs.join(F.broadcast(cut), ["source", "block"]).withColumn("at", F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    edge = edge.filter(F.col("at") + F.col("tokens") / 2 <= F.col("rest")).join(drawn, ["source", "block"]).filter("repeat = passes").select("doc_id", "source", "repeat", "shard", "tokens", "mark")
    picked = written(whole.unionByName(edge), "mix-picked")
    salt = F.pmod(F.xxhash64("mark", "repeat", F.lit(seed + 2)), F.lit(64)).cast("int")
    shuffled = Window.partitionBy("shard", "part").orderBy(F.xxhash64("mark", "repeat", F.lit(seed + 3)), "doc_id")
    rows = picked.withColumn("part", salt).withColumn("nth", F.row_number().over(shuffled))
    counts = picked.withColumn("part", salt).groupBy("shard", "part").count()
    offset = counts.select("shard", "part", (F.sum("count").over(Window.partitionBy("shard").orderBy("part")) - F.col("count")).alias("offset"))
    selection = rows.join(F.broadcast(offset), ["shard", "part"]).select("doc_id", "source", "repeat", "shard", (F.col("offset") + F.col("nth")).alias("place"))  # 64 rows a shard
    got = picked.groupBy("source").agg(F.sum("tokens").alias("reached"), F.count("*").alias("documents"))
    report = goals.join(got, "source", "left").withColumn("reached", F.coalesce("reached", F.lit(0))).withColumn("documents", F.coalesce("documents", F.lit(0)))
    all_ = report.agg(F.sum("reached").alias("sum"))
    report = report.crossJoin(F.broadcast(all_)).withColumn("actual", F.when(F.col("sum") > 0, F.col("reached") / F.col("sum")).otherwise(F.lit(0.0))).drop("sum")  # one row
    return selection, report
