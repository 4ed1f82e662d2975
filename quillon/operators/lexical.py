"""Ranked text retrieval over an inverted index: BM25 and a TF-IDF baseline."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokenize
from ..plans.lineage import written
from .topk import topk_per


@dataclass
class TextIndex:
    """postings (term, doc_id, tf), docs (doc_id, len), terms (term, df), stats (n, avgdl: one row)."""

    postings: DataFrame
    docs: DataFrame
    terms: DataFrame
    stats: DataFrame


def text_index(documents: DataFrame) -> TextIndex:
    """Index of (doc_id, text). Documents without tokens (null, empty) count in n and avgdl; a null doc_id and
    repeated rows of a doc_id are left out, the largest text stands."""
    pages = documents.select("doc_id", "text").filter("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
    tokens = pages.select("doc_id", tokenize(F.col("text")).alias("tokens"))
    docs = tokens.select("doc_id", F.size("tokens").cast("long").alias("len"))
    postings = tokens.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf")).select("term", "doc_id", "tf")
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    stats = docs.agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avgdl"))
    return TextIndex(postings, docs, terms, stats)


def written_index(documents: DataFrame) -> TextIndex:
    """The same index kept in the shared folder: texts are read and cut once, however many searches follow."""
    index = text_index(documents)
    postings, docs = written(index.postings, "text-postings"), written(index.docs, "text-docs")
    stats = docs.agg(F.count("*").alias("n"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("avgdl"))
    return TextIndex(postings, docs, postings.groupBy("term").agg(F.count("*").alias("df")), stats)


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, times): a repeated term of a query counts each time."""
    terms = queries.filter("query_id is not null").select("query_id", F.explode(tokenize(F.col("text"))).alias("term"))
    return terms.groupBy("query_id", "term").agg(F.count("*").alias("times"))


def bm25_idf(index: TextIndex) -> DataFrame:
    """(term, df, idf): always above 0."""
    return index.terms.join(F.broadcast(index.stats)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def bm25_weights(index: TextIndex, k1: float = 1.2, b: float = 0.75, kept: tuple[str, ...] = ()) -> DataFrame:
    """(term, doc_id, weight): what a term of a query adds to a document's score, once for every posting; ``kept`` are
    further columns of the postings."""
    rows = index.postings.join(index.docs, "doc_id").join(bm25_idf(index).select("term", "idf"), "term").join(F.broadcast(index.stats.select("avgdl")))  # one row
    ratio = F.when(F.col("avgdl") > 0, F.col("len") / F.col("avgdl")).otherwise(F.lit(0.0))
    return rows.select(*kept, "term", "doc_id", (F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * ratio))).alias("weight"))


def bm25_scores(index: TextIndex, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score) of all documents that share a term with the query. Unknown terms add nothing."""
    hits = query_terms(queries).join(bm25_weights(index, k1, b), "term")
    return hits.groupBy("query_id", F.col("doc_id").alias("id")).agg(F.sum(F.col("times") * F.col("weight")).alias("score"))


def bm25_pair_scores(documents: DataFrame, queries: DataFrame, pairs: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score): ``bm25_scores`` of the given ``pairs`` (query_id, id) alone, where they share a term.

    Terms and lengths are counted over all documents, but only the pairs' documents meet queries, each its own."""
    pairs = pairs.select("query_id", "id").distinct()
    every = text_index(documents)
    named = text_index(documents.select("doc_id", "text").join(pairs.select(F.col("id").alias("doc_id")).distinct(), "doc_id", "left_semi"))
    asked = pairs.withColumnRenamed("id", "doc_id").join(query_terms(queries), "query_id")
    postings = named.postings.join(asked, ["doc_id", "term"])
    hits = bm25_weights(TextIndex(postings, named.docs, every.terms, every.stats), k1, b, ("query_id", "times"))
    return hits.groupBy("query_id", F.col("doc_id").alias("id")).agg(F.sum(F.col("times") * F.col("weight")).alias("score"))


def ranked_by_score(scores: DataFrame, k: int) -> DataFrame:
    """(query_id, id, dist, score, rank): dist is the negated score at single precision, which decides the rank;
    scores are first rounded to nine digits so that summation order decides nothing."""
    scored = scores.withColumn("score", F.round("score", 9)).withColumn("dist", -F.col("score").cast("float"))
    return topk_per(scored, k).select("query_id", "id", "dist", "score", "rank")


def best_in_shard(code: np.ndarray, doc: np.ndarray, weight: np.ndarray, ids: np.ndarray, terms: int, qcode: np.ndarray, qtimes: np.ndarray, starts: np.ndarray, scale: np.ndarray, k: int, rows: int = 1_000, batch: int = 50_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's k best documents by ``scale * sum(times * weight)``, ties by id.

    Postings are (code, doc, weight), weights above 0; the terms of query i are ``qcode[starts[i]:starts[i + 1]]``. Weights are first
    added up as whole 16-bit steps, rounded up, a frequent term as one row over all documents. The sum is at most one step a term above
    the score, so what lies further than that below the k-th best of the columns' peaks can't be among the k best; the others' scores are
    added up from the weights. Queries whose sums would not fit 16 bits are added up from the weights at once."""
    order = np.lexsort((doc, code))
    code, doc, weight = code[order], doc[order], weight[order]
    first = np.searchsorted(code, np.arange(terms + 1))
    docs, deep = len(ids), 32
    width = -(-docs // deep)
    keys = code.astype(np.int64) * docs + doc
    peak = np.zeros(terms)
    np.maximum.at(peak, code, weight)
    most, count = np.add.reduceat(qtimes * peak[qcode], starts[:-1]), np.add.reduceat(qtimes, starts[:-1])
    unit = 4 * np.median(most[most > 0]) / 60_000 if (most > 0).any() else 1.0
    fits = most / unit + count <= 65_000
    slack = count + 2 + 2e-9 / (scale * unit)  # rounding to nine digits and to single precision included
    level = np.minimum(np.ceil(weight / unit), 65_535).astype(np.uint16)
    held = np.diff(first)
    wide = np.flatnonzero(held > max(docs // 64, 1))
    wide = wide[np.argsort(-held[wide], kind="stable")[:rows]]
    row = np.full(terms, -1)
    row[wide] = np.arange(len(wide))
    table = np.zeros((len(wide), deep * width), np.uint16)
    inside = row[code] >= 0
    table[row[code[inside]], doc[inside]] = level[inside]
    total, steps, some = np.zeros(docs), np.zeros(deep * width, np.uint16), np.empty(deep * width, np.uint16)
    out: tuple[list, list, list] = ([], [], [])
    near: list[tuple[int, np.ndarray]] = []
    waiting = 0

    def keep(asked: np.ndarray, hit: np.ndarray, sums: np.ndarray) -> None:
        score = np.round(sums * scale[asked], 9)
        best = np.lexsort((ids[hit], -score.astype(np.float32), asked))
        asked = asked[best]
        best = best[np.arange(len(best)) - np.searchsorted(asked, asked) < k]
        for x, y in zip(out, (np.sort(asked, kind="stable")[np.arange(len(asked)) - np.searchsorted(asked, asked) < k], ids[hit[best]], score[best])):
            x.append(y)

    def flush() -> None:
        asked, hit = np.repeat([i for i, _ in near], [len(x) for _, x in near]), np.concatenate([x for _, x in near])
        n = starts[asked + 1] - starts[asked]
        cell = np.repeat(np.arange(len(hit)), n)
        slot = np.arange(len(cell)) + np.repeat(starts[asked] - (np.cumsum(n) - n), n)
        want = qcode[slot] * docs + hit[cell]
        by = np.argsort(want)
        at = np.empty(len(want), np.int64)
        at[by] = np.minimum(np.searchsorted(keys, want[by]), len(keys) - 1)
        keep(asked, hit, np.bincount(cell, np.where(keys[at] == want, qtimes[slot] * weight[at], 0.0), len(hit)))
        near.clear()

    bounds, froms, tos, rowed = starts.tolist(), first[:-1].tolist(), first[1:].tolist(), row.tolist()
    codes, times = qcode.tolist(), qtimes.tolist()
    for i in np.flatnonzero(most > 0).tolist():
        mine = range(bounds[i], bounds[i + 1])
        if not fits[i]:
            total[:] = 0
            for j in mine:
                part = slice(froms[codes[j]], tos[codes[j]])
                total[doc[part]] += times[j] * weight[part]
            hit = np.flatnonzero(total > 0)
            keep(np.full(len(hit), i), hit, total[hit])
            continue
        begun = False
        for j in mine:
            if (r := rowed[codes[j]]) >= 0:
                if times[j] > 1:
                    np.multiply(table[r], np.uint16(times[j]), out=steps if not begun else some)
                    if begun:
                        np.add(steps, some, out=steps)
                elif begun:
                    np.add(steps, table[r], out=steps)
                else:
                    steps[:] = table[r]
                begun = True
        if not begun:
            steps[:] = 0
        for j in mine:
            if rowed[codes[j]] < 0 and froms[codes[j]] < tos[codes[j]]:
                part = slice(froms[codes[j]], tos[codes[j]])
                steps[doc[part]] += np.uint16(times[j]) * level[part]
        least = 0
        if width > k:
            least = int(np.partition(steps.reshape(deep, width).max(0), width - k)[width - k]) - slack[i]
        hit = np.flatnonzero(steps >= np.uint16(max(1, int(least))))
        near.append((i, hit))
        waiting += len(hit)
        if waiting >= batch:
            flush()
            waiting = 0
    if near:
        flush()
    return tuple(np.concatenate(x) if x else np.empty(0, kind) for x, kind in zip(out, (np.int64, np.int64, np.float64)))


def even_labels(spark: SparkSession, n: int) -> list[int]:
    """n whole numbers; a shuffle by an int column of them gives every partition as many, but for one."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most, taken, out = -(-n // parts), [0] * parts, []
    for label, part in spark.range(30 * max(n, parts)).selectExpr("cast(id AS int)", f"pmod(hash(cast(id AS int)), {parts})").collect():
        if taken[part] < most and len(out) < n:
            taken[part] += 1
            out.append(label)
    return out + list(range(-1, len(out) - n - 1, -1))  # were there too few after all, any others do


def topk_in_blocks(index: TextIndex, queries: DataFrame, k: int, ways: list[tuple], shard_docs: int = 50_000, query_block: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(way, query_id, id, score): at least the k best documents of each query in each of the ``ways``, which are ("bm25", k1, b) or
    ("tfidf",), numbered from 0. Queries of the same terms are searched once, for the least of them: the second table
    is (query_id, searched).

    Postings never meet queries in a join, which would make a row of every posting of every term of every query. A
    task holds the postings of a shard of documents and a block of queries, weighs them in all ways and adds up one query after the
    other over the shard's documents; k a query leave it. Shards are by hash of the document, so a term in a third of all
    documents is spread over all of them; a document's length and norm are those of its postings, which lie in one shard."""
    df = written(index.terms, "text-terms") if len(ways) > 1 else index.terms
    asked = query_terms(queries).join(df, "term").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "times", "df"))).alias("asks"))
    asked = written(asked.withColumn("searched", F.min("query_id").over(Window.partitionBy("asks"))), "text-asked")
    same, asked = asked.select("query_id", "searched"), asked.filter("query_id = searched")
    docs, avgdl = index.stats.first()
    n = asked.count()
    spread = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs // 500))  # a few small shards also keep all cores at work
    shards, blocks = max(1, spread, -(-docs // shard_docs)), max(1, -(-n // query_block))
    labels = F.array(*map(F.lit, even_labels(df.sparkSession, shards * blocks)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    held = index.postings.join(df, "term").select(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"), "term", "doc_id", F.col("tf").cast("int").alias("tf"), "df")
    asks = asked.select(every(shards).alias("shard"), F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block"), "query_id", "asks")
    held, asks = (x.withColumn("task", F.get(labels, F.col("shard") * blocks + F.col("block"))).drop("shard", "block") for x in (held, asks))

    def of(p: pa.Table, q: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if p.num_rows and q.num_rows:
            lists = pa.concat_arrays(q.column("asks").chunks)
            starts = np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy())].astype(np.int64)
            flat = lists.flatten()
            names = pc.unique(pc.struct_field(flat, "term"))
            qcode = pc.index_in(pc.struct_field(flat, "term"), names).to_numpy().astype(np.int64)
            times, qdf = pc.struct_field(flat, "times").to_numpy(), pc.struct_field(flat, "df").to_numpy()
            code = pc.fill_null(pc.index_in(p.column("term"), names), -1).to_numpy()
            ids, doc = np.unique(p.column("doc_id").to_numpy(), return_inverse=True)
            tf, pdf = p.column("tf").to_numpy().astype(np.float64), p.column("df").to_numpy()
            met = code >= 0
            for way, (name, *by) in enumerate(ways):
                if name == "bm25":
                    k1, b = by
                    ratio = np.bincount(doc, tf) / avgdl
                    idf = np.log(1 + (docs - pdf[met] + 0.5) / (pdf[met] + 0.5))
                    weight = idf * tf[met] * (k1 + 1) / (tf[met] + k1 * (1 - b + b * ratio[doc[met]]))
                    scale = np.ones(q.num_rows)
                else:
                    idf = np.log((1 + docs) / (1 + pdf)) + 1
                    weight = (tf * idf)[met] / np.sqrt(np.bincount(doc, (tf * idf) ** 2))[doc[met]] * idf[met]
                    scale = 1 / np.sqrt(np.add.reduceat((times * (np.log((1 + docs) / (1 + qdf)) + 1)) ** 2, starts[:-1]))
                asked_, id_, score = best_in_shard(code[met], doc[met], weight, ids, len(names), qcode, times, starts, scale, k)
                out.append((np.full(len(id_), way, np.int32), q.column("query_id").to_numpy()[asked_], id_, score))
        cols = [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, kind) for kind in (np.int32, np.int64, np.int64, np.float64)]
        return pa.table([pa.array(c) for c in cols], ["way", "query_id", "id", "score"])

    return held.groupBy("task").cogroup(asks.groupBy("task")).applyInArrow(of, "way int, query_id long, id long, score double"), same


def _listed(got: DataFrame, same: DataFrame, k: int, way: int = 0) -> DataFrame:
    """The lists of all queries from those of the searched ones."""
    ranked = ranked_by_score(got.filter(F.col("way") == way).drop("way"), k).withColumnRenamed("query_id", "searched")
    return same.join(ranked, "searched").select("query_id", "id", "dist", "score", "rank")


def _ranked(index: TextIndex, queries: DataFrame, k: int, way: tuple) -> DataFrame:
    if k <= 0:
        return ranked_by_score(index.docs.selectExpr("0L AS query_id", "doc_id AS id", "0D AS score"), 0)
    return _listed(*topk_in_blocks(index, queries, k, [way]), k)


def bm25_topk(index: TextIndex, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """The k best documents of each query (see ``bm25_scores``)."""
    return _ranked(index, queries, k, ("bm25", k1, b))


def tfidf_idf(index: TextIndex) -> DataFrame:
    return index.terms.join(F.broadcast(index.stats)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf_topk(index: TextIndex, queries: DataFrame, k: int = 10) -> DataFrame:
    """Cosine of length-normalised tf-idf vectors; terms out of the vocabulary are dropped before the query's norm."""
    return _ranked(index, queries, k, ("tfidf",))


def bm25_and_tfidf(index: TextIndex, queries: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """Both of these from one pass over the postings, written since both lists are read."""
    got, same = topk_in_blocks(index, queries, k, [("bm25", 1.2, 0.75), ("tfidf",)])
    got = written(got, "text-lists")
    return _listed(got, same, k, 0), _listed(got, same, k, 1)


def index_bytes(index: TextIndex) -> DataFrame:
    """(bytes, vocab_size, doc_count): four bytes a document, eight a posting, and the terms' own."""
    per = index.terms.agg(F.coalesce(F.sum(8 * F.col("df") + F.octet_length("term")), F.lit(0)).alias("t"), F.count("*").alias("vocab_size"))
    return per.join(F.broadcast(index.stats)).select((4 * F.col("n") + F.col("t")).alias("bytes"), "vocab_size", F.col("n").alias("doc_count"))
