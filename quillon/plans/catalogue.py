"""The engine's queries over the project's tables, and the SQL that DuckDB checks them with."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..api import GraphIndex, PqIndex
from ..functions import sqlfuncs
from ..functions.distance import norm_sq
from ..functions.draws import graph_level
from ..functions.text import clean, tokenize
from ..operators import evaluate, exact, fusion, graph, kmeans, lexical, pq, records, topk
from ..operators.retriever import HybridRetriever
from ..sources import textfiles, xvecs
from ..streaming import append
from . import snapshot
from .lineage import scratch, written
from .schema import dimension, vectors_of
from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
K, M = 10, 8


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


def _vectors(spark, d) -> DataFrame:
    return vectors_of(table(spark, d, "embeddings"), "vec_id", "embedding")


def _asked(vectors: DataFrame) -> DataFrame:
    """The project's search queries: every row whose id 100 divides."""
    return vectors.filter("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")


def _out(ranked: DataFrame) -> DataFrame:
    return ranked.select("query_id", "id", F.round("dist", 6).alias("dist"), "rank")


_V = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL), q AS (SELECT id AS query_id, e AS qe FROM v WHERE id % 100 = 0)"
_L2 = "list_sum(list_transform(list_zip(qe, e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"


def _knn_sql(dist: str, vectors: str = "", k: int = K) -> str:
    return f"""WITH {vectors or _V}, d AS (SELECT query_id, id, round({dist}, 9) AS dist FROM q, v),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM d WHERE dist IS NOT NULL)
SELECT query_id, id, round(dist, 6) AS dist, rank FROM r WHERE rank <= {k}"""


# ---- exact search


@query(_knn_sql(_L2))
def exact_knn_l2(spark, d):
    v = _vectors(spark, d)
    return _out(exact.exact_knn(_asked(v), v, K, "l2", dimension(v)))


_SCALED = "v AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(CAST(x * (1 + vec_id % 7) AS FLOAT) AS DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL), q AS (SELECT id AS query_id, e AS qe FROM v WHERE id % 100 = 0)"


@query(_knn_sql("-list_inner_product(qe, e)", _SCALED))
def exact_knn_ip(spark, d):
    v = _vectors(spark, d).withColumn("embedding", F.expr("transform(embedding, x -> cast(double(x) * (1 + id % 7) as float))"))
    return _out(exact.exact_knn(_asked(v), v, K, "ip", dimension(v)))


@query(_knn_sql("-list_cosine_similarity(qe, e)", _SCALED))
def exact_knn_cosine(spark, d):
    v = _vectors(spark, d).withColumn("embedding", F.expr("transform(embedding, x -> cast(double(x) * (1 + id % 7) as float))"))
    return _out(exact.exact_knn(_asked(v), v, K, "cosine", dimension(v)))


@query(_knn_sql(_L2))
def exact_knn_block(spark, d):
    v = _vectors(spark, d)
    return _out(exact.exact_knn_block(_asked(v), v, K))


@query(f"WITH {_V}, d AS (SELECT query_id, id, round({_L2}, 9) AS dist FROM q, v WHERE id > query_id) SELECT query_id, id, round(dist, 6) AS dist FROM d ORDER BY d.dist, id, query_id LIMIT 20")
def topk_global(spark, d):
    v = _vectors(spark, d)
    q = _asked(v).select("query_id", F.col("embedding").alias("q"))
    pairs = v.join(q, F.col("id") > F.col("query_id")) if q.count() > exact.BROADCAST_QUERIES else v.join(F.broadcast(q), F.col("id") > F.col("query_id"))
    from ..functions.distance import l2_sq

    got = topk.topk_global(pairs.select("query_id", "id", F.round(l2_sq(F.col("q"), F.col("embedding"), dimension(v)), 9).alias("dist")), 20, ("dist", "id", "query_id"))
    return got.select("query_id", "id", F.round("dist", 6).alias("dist"))


@query("SELECT vec_id AS id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS norm FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL")
def vector_norms(spark, d):
    v = _vectors(spark, d)
    return v.select("id", F.round(F.sqrt(norm_sq(F.col("embedding"), dimension(v))), 6).alias("norm"))


_IMG = """v AS (SELECT id, min(CAST(embedding AS FLOAT[64])) AS e FROM image_vectors WHERE id IS NOT NULL AND len(embedding) = 64
  AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR isnan(x)), true) GROUP BY id)"""


def _image_vectors(spark, d) -> DataFrame:
    """Vectors of the usual length without nulls or NaN inside, each id once."""
    v = vectors_of(table(spark, d, "image_vectors"), "id", "embedding")
    return v.filter("size(embedding) = 64 and not exists(embedding, x -> x is null or isnan(x))").groupBy("id").agg(F.min("embedding").alias("embedding"))


@query(f"""WITH {_IMG}, t AS (SELECT query_id, max(neighbors) AS neighbors FROM ivecs_data WHERE query_id IS NOT NULL AND neighbors IS NOT NULL GROUP BY query_id),
d AS (SELECT query_id, v.id, round(array_distance(a.e, v.e) * array_distance(a.e, v.e)) AS dist FROM t JOIN v a ON a.id = query_id JOIN v ON v.id <> query_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM d),
h AS (SELECT DISTINCT query_id, unnest(neighbors) AS id FROM t)
SELECT r.query_id, round(count(h.id) / 10, 6) AS recall FROM r LEFT JOIN h ON r.query_id = h.query_id AND r.id = h.id WHERE rank <= 10 GROUP BY r.query_id""")
def published_lists_recall(spark, d):
    """How much of the exact ten nearest the published lists hold."""
    v = _image_vectors(spark, d)
    lists = table(spark, d, "ivecs_data").filter("query_id is not null and neighbors is not null").groupBy("query_id").agg(F.max("neighbors").alias("neighbors"))
    asked = lists.select("query_id").join(v.withColumnRenamed("id", "query_id"), "query_id")
    exact_ = topk.topk_per(exact.exact_knn_block(asked, v, K + 1).filter("id <> query_id").drop("rank"), K)
    found = lists.select("query_id", F.explode("neighbors").alias("id")).select("query_id", F.col("id").cast("long").alias("id"), F.lit(1).alias("rank"))
    return evaluate.recall_at_k(found, exact_, K).select("query_id", F.round("recall", 6).alias("recall"))


# ---- text


def _documents(spark, d) -> DataFrame:
    return table(spark, d, "corpus", "doc_id", "text")


def _questions(spark, d) -> DataFrame:
    q = table(spark, d, "text_queries").filter("query_no is not null")
    return q.groupBy(F.col("query_no").alias("query_id")).agg(F.max("question").alias("text"), F.max("gold_key").alias("gold_key"))


def _gold(spark, d) -> DataFrame:
    keys = table(spark, d, "corpus", "doc_id", "doc_key").filter("doc_id is not null and doc_key is not null").groupBy(F.col("doc_key").alias("gold_key")).agg(F.min("doc_id").alias("gold_id"))
    return _questions(spark, d).join(keys, "gold_key").select("query_id", "gold_id")


_DOCS = """docs AS (SELECT doc_id, max(text) AS text FROM corpus WHERE doc_id IS NOT NULL GROUP BY doc_id),
tok AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'), lambda x: lower(x)) AS t FROM docs),
len AS (SELECT doc_id, CAST(len(t) AS BIGINT) AS len FROM tok),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM tok) GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
st AS (SELECT count(*) AS n, coalesce(avg(len), 0) AS avgdl FROM len)"""
_QT = """qs AS (SELECT query_no AS query_id, max(question) AS text, max(gold_key) AS gold_key FROM text_queries WHERE query_no IS NOT NULL GROUP BY 1),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'), lambda x: lower(x))) AS term FROM qs) GROUP BY ALL),
gold AS (SELECT query_id, g.gold_id FROM qs JOIN (SELECT doc_key, min(doc_id) AS gold_id FROM corpus WHERE doc_id IS NOT NULL GROUP BY 1) g ON qs.gold_key = g.doc_key)"""


def _bm25_sql(name: str, k1: float = 1.2, b: float = 0.75, k: int | None = K) -> str:
    return f"""{name}_s AS (SELECT query_id, doc_id AS id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * CASE WHEN avgdl > 0 THEN len / avgdl ELSE 0 END))), 9) AS score
 FROM qt JOIN post USING (term) JOIN dfs USING (term) JOIN len USING (doc_id), st GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CAST(score AS FLOAT) DESC, id) AS rank FROM {name}_s){f" WHERE rank <= {k}" if k else ""})"""


_TFIDF = f"""idf AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM dfs, st),
dw AS (SELECT doc_id, term, tf * idf AS w FROM post JOIN idf USING (term)), dn AS (SELECT doc_id, sqrt(sum(w * w)) AS nrm FROM dw GROUP BY 1),
qw AS (SELECT query_id, term, times * idf AS w FROM qt JOIN idf USING (term)), qn AS (SELECT query_id, sqrt(sum(w * w)) AS nrm FROM qw GROUP BY 1),
tfidf_s AS (SELECT query_id, doc_id AS id, round(sum(qw.w / qn.nrm * dw.w / dn.nrm), 9) AS score FROM qw JOIN qn USING (query_id) JOIN dw USING (term) JOIN dn USING (doc_id) GROUP BY ALL),
tfidf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CAST(score AS FLOAT) DESC, id) AS rank FROM tfidf_s WHERE score > 0) WHERE rank <= {K})"""
_RANKS = "SELECT query_id, id, rank, round(score, 6) AS score FROM "


def _ranks(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def _index(spark, d) -> lexical.TextIndex:
    return lexical.written_index(_documents(spark, d))


def _bm25(spark, d, index=None, **kw) -> DataFrame:
    return lexical.bm25_topk(index or _index(spark, d), _questions(spark, d), K, **kw)


def _tfidf(spark, d, index=None) -> DataFrame:
    return lexical.tfidf_topk(index or _index(spark, d), _questions(spark, d), K)


def _both(spark, d) -> tuple[DataFrame, DataFrame]:
    """Both systems' lists over one index."""
    return lexical.bm25_and_tfidf(_index(spark, d), _questions(spark, d), K)


@query("SELECT doc_id, CAST(len(t) AS BIGINT) AS tokens, CAST(len(list_distinct(t)) AS BIGINT) AS terms FROM (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'), lambda x: lower(x)) AS t FROM documents)")
def tokenize_counts(spark, d):
    t = table(spark, d, "documents").select("doc_id", tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("terms"))


@query(f"WITH {_DOCS} SELECT doc_id, len FROM len")
def doc_stats(spark, d):
    return lexical.text_index(_documents(spark, d)).docs


@query(f"WITH {_DOCS} SELECT n, round(avgdl, 6) AS avgdl FROM st")
def corpus_stats(spark, d):
    return lexical.text_index(_documents(spark, d)).stats.select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {_DOCS} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs, st")
def bm25_idf(spark, d):
    return lexical.bm25_idf(lexical.text_index(_documents(spark, d))).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_DOCS} SELECT CAST(4 * n + (SELECT coalesce(sum(8 * df + strlen(term)), 0) FROM dfs) AS BIGINT) AS bytes, (SELECT count(*) FROM dfs) AS vocab_size, n AS doc_count FROM st")
def bm25_index_bytes(spark, d):
    return lexical.index_bytes(lexical.text_index(_documents(spark, d)))


@query(f"WITH {_DOCS}, {_QT}, {_bm25_sql('b')} {_RANKS} b")
def bm25_topk(spark, d):
    return _ranks(_bm25(spark, d))


@query(f"WITH {_DOCS}, {_QT}, {_bm25_sql('b', k1=0.0)} {_RANKS} b")
def bm25_k1_zero(spark, d):
    return _ranks(_bm25(spark, d, k1=0.0))


@query(f"WITH {_DOCS}, {_QT}, {_bm25_sql('b', b=0.0)} {_RANKS} b")
def bm25_b_zero(spark, d):
    return _ranks(_bm25(spark, d, b=0.0))


@query(f"WITH {_DOCS}, {_QT}, {_bm25_sql('b', k=None)} SELECT query_id, id, round(score, 6) AS score FROM b_s JOIN gold USING (query_id) WHERE id = gold_id")
def bm25_score_pairs(spark, d):
    """The score of each query's gold page, where they share a term."""
    s = lexical.bm25_pair_scores(_documents(spark, d), _questions(spark, d), _gold(spark, d).withColumnRenamed("gold_id", "id"))
    return s.select("query_id", "id", F.round(F.round("score", 9), 6).alias("score"))


@query(f"WITH {_DOCS}, {_QT}, {_TFIDF} {_RANKS} tfidf")
def tfidf_topk(spark, d):
    return _ranks(_tfidf(spark, d))


def _rrf_sql(lists: list[str], k: int = K) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, id, rank FROM {x}" for x in lists)
    return f"""f_s AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score FROM ({union}) GROUP BY ALL),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CAST(score AS FLOAT) DESC, id) AS rank FROM f_s) WHERE rank <= {k})"""


@query(f"""WITH {_V} SELECT a.id, b.id AS other, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS dist FROM v a JOIN v b ON b.id = a.id + 1""")
def successive_distances(spark, d):
    """The distance of each vector to the one of the next id."""
    from ..functions.distance import l2_sq

    v = _vectors(spark, d)
    after = v.select((F.col("id") - 1).alias("id"), F.col("id").alias("other"), F.col("embedding").alias("b"))
    return v.join(after, "id").select("id", "other", F.round(l2_sq(F.col("embedding"), F.col("b"), dimension(v)), 6).alias("dist"))


@query(f"WITH {_DOCS}, {_QT}, {_bm25_sql('b')}, {_TFIDF}, {_rrf_sql(['b', 'tfidf'])} {_RANKS} f")
def rrf_bm25_tfidf(spark, d):
    return _ranks(fusion.reciprocal_rank_fusion(list(_both(spark, d)), K))


@query(f"""WITH best AS (SELECT query_no AS query_id, list_id, id, min(dist) AS dist FROM ranked WHERE query_no IS NOT NULL AND list_id IS NOT NULL AND id IS NOT NULL AND dist IS NOT NULL AND NOT isnan(dist) GROUP BY ALL),
l AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id, list_id ORDER BY dist, id) AS rank FROM best), {_rrf_sql(['l'])} {_RANKS} f""")
def rrf_stored_lists(spark, d):
    """The stored lists of each query merged by their places."""
    rows = table(spark, d, "ranked").filter("query_no is not null and list_id is not null and id is not null and dist is not null and not isnan(dist)")
    best = rows.groupBy(F.col("query_no").alias("query_id"), "list_id", "id").agg(F.min("dist").alias("dist"))
    lists = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "list_id").orderBy("dist", "id")))
    return _ranks(fusion.reciprocal_rank_fusion([lists], K))


_HY = f"WITH {_DOCS}, {_QT}, {_bm25_sql('b')}, {_TFIDF}, gb AS (SELECT gold.query_id, rank FROM gold LEFT JOIN b ON gold.query_id = b.query_id AND gold_id = id), gt AS (SELECT gold.query_id, rank FROM gold LEFT JOIN tfidf t ON gold.query_id = t.query_id AND gold_id = id)"
_HIT = "count(*) AS queries, " + ", ".join(f"round(coalesce(avg(CASE WHEN rank <= {n} THEN 1 ELSE 0 END), 0), 6) AS hit_at_{n}" for n in (1, 5, 10))


@query(f"{_HY} SELECT 'bm25' AS method, {_HIT} FROM gb UNION ALL SELECT 'tfidf' AS method, {_HIT} FROM gt")
def text_hit_rates(spark, d):
    gold = _gold(spark, d)
    one = lambda ranked, name: evaluate.hits_at(evaluate.gold_ranks(ranked, gold)).withColumn("method", F.lit(name))
    bm25, tfidf = _both(spark, d)
    return one(bm25, "bm25").unionByName(one(tfidf, "tfidf"))


@query(f"{_HY}, n AS (SELECT count(*) AS queries FROM qs) SELECT queries, round((SELECT count(*) FROM b JOIN tfidf t ON b.query_id = t.query_id AND b.id = t.id) / (10 * queries), 6) AS overlap FROM n")
def text_overlap(spark, d):
    return evaluate.overlap(*_both(spark, d), _questions(spark, d))


@query(f"""{_HY} SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither, round(coalesce(avg(CASE WHEN a OR b THEN 1 ELSE 0 END), 0), 6) AS oracle
FROM (SELECT coalesce(gb.rank <= 5, false) AS a, coalesce(gt.rank <= 5, false) AS b FROM gb JOIN gt USING (query_id))""")
def text_contingency(spark, d):
    gold = _gold(spark, d)
    bm25, tfidf = _both(spark, d)
    return evaluate.contingency(evaluate.gold_ranks(bm25, gold), evaluate.gold_ranks(tfidf, gold))


@query(f"""{_HY}, h AS (SELECT (SELECT avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) FROM gb) AS a, (SELECT avg(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) FROM gt) AS b)
SELECT round(a, 6) AS bm25, round(b, 6) AS tfidf, round(CASE WHEN round(b, 6) > 0 THEN (round(a, 6) - round(b, 6)) / round(b, 6) ELSE 0 END, 6) AS lift FROM h""")
def text_lift(spark, d):
    """BM25 against TF-IDF at five: the relative lift."""
    gold = _gold(spark, d)
    a, b = (evaluate.hits_at(evaluate.gold_ranks(x, gold)).select(F.col("hit_at_5").alias(n)) for x, n in zip(_both(spark, d), ("bm25", "tfidf")))
    return a.join(F.broadcast(b)).select("bm25", "tfidf", F.round(evaluate.relative_lift(F.col("bm25"), F.col("tfidf")), 6).alias("lift"))  # one row each


@query(f"WITH {_DOCS}, {_QT} SELECT (SELECT count(*) FROM qs) AS queries, count(*) AS with_gold, round(count(*) FILTER (len > 0) / (SELECT count(*) FROM qs), 6) AS ceiling FROM gold JOIN len ON gold_id = doc_id")
def text_ceiling(spark, d):
    """The share of queries whose gold page has any token."""
    gold = _gold(spark, d).join(lexical.text_index(_documents(spark, d)).docs.withColumnRenamed("doc_id", "gold_id"), "gold_id")
    n = _questions(spark, d).agg(F.count("*").alias("queries"))
    return gold.agg(F.count("*").alias("with_gold"), F.count_if(F.col("len") > 0).alias("ok")).join(F.broadcast(n)).select("queries", "with_gold", F.round(F.col("ok") / F.col("queries"), 6).alias("ceiling"))


@query("SELECT query_no, gold_key FROM text_queries WHERE gold_key IS NULL OR gold_key NOT IN (SELECT doc_key FROM corpus WHERE doc_key IS NOT NULL)")
def orphan_queries(spark, d):
    return textfiles.split_orphans(table(spark, d, "text_queries", "query_no", "gold_key"), table(spark, d, "corpus", "doc_key"))[1].select("query_no", "gold_key")


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS digest FROM corpus WHERE text IS NOT NULL")
def clean_texts(spark, d):
    return table(spark, d, "corpus").filter("text is not null").select("doc_id", F.md5(clean(F.col("text")).cast("binary")).alias("digest"))


# ---- k-means


def _starts(vectors: DataFrame, k: int) -> np.ndarray:
    return np.array([r[0] for r in vectors.orderBy("id").limit(k).select("embedding").collect()], np.float64)  # k rows


def _km_sql(steps: int, k: int = 16) -> str:
    out = f"v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL), c0 AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS cid, e AS c FROM v ORDER BY id LIMIT {k})"
    for s in range(steps):
        out += f""", a{s} AS (SELECT id, e, cid, dist FROM (SELECT id, e, cid, dist, row_number() OVER (PARTITION BY id ORDER BY dist, cid) AS r FROM (SELECT v.id, v.e, cid, round(list_sum(list_transform(list_zip(e, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS dist FROM v, c{s})) WHERE r = 1),
x{s} AS (SELECT cid, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM a{s}),
c{s + 1} AS (SELECT cid, list(m ORDER BY i) AS c FROM (SELECT cid, i, round(avg(x), 9) AS m FROM x{s} GROUP BY ALL) GROUP BY cid)"""
    return "WITH " + out


@query(f"{_km_sql(1)} SELECT id, cid, dist FROM a0")
def kmeans_assign(spark, d):
    v = _vectors(spark, d)
    return kmeans.assign(v, _starts(v, 16)).drop("embedding")


@query(f"{_km_sql(1)} SELECT cid, (SELECT count(*) FROM a0 WHERE a0.cid = c1.cid) AS n, list_transform(c, lambda x: round(x, 6)) AS center FROM c1")
def kmeans_update(spark, d):
    v = _vectors(spark, d)
    got = kmeans.update(kmeans.assign(v, _starts(v, 16)), dimension(v))
    return got.select("cid", "n", F.transform("center", lambda x: F.round(x, 6)).alias("center"))


def _lloyd(v: DataFrame, steps: int) -> DataFrame:
    c = _starts(v, 16)
    dim = c.shape[1]
    for _ in range(steps - 1):
        got = kmeans.update(kmeans.assign(v, c), dim).collect()  # 16 rows
        for r in got:
            c[r["cid"]] = r["center"]
    return kmeans.assign(v, c)


@query(f"{_km_sql(3)} SELECT id, cid, round(dist, 4) AS dist FROM a2")
def kmeans_lloyd3(spark, d):
    return _lloyd(_vectors(spark, d), 3).select("id", "cid", F.round("dist", 4).alias("dist"))


@query(f"{_km_sql(3)} SELECT cid, count(*) AS n, round(sum(dist), 4) AS inertia FROM a2 GROUP BY cid")
def kmeans_inertia(spark, d):
    return _lloyd(_vectors(spark, d), 3).groupBy("cid").agg(F.count("*").alias("n"), F.round(F.sum("dist"), 4).alias("inertia"))


@query("SELECT run_id, inertia FROM (SELECT DISTINCT run_id, inertia FROM kmeans_result WHERE inertia IS NOT NULL AND NOT isnan(inertia)) ORDER BY inertia, run_id LIMIT 1")
def kmeans_best_run(spark, d):
    """The stored run of least inertia."""
    return table(spark, d, "kmeans_result").filter("inertia is not null and not isnan(inertia)").select("run_id", "inertia").distinct().orderBy("inertia", "run_id").limit(1)


@query()
def kmeans_trained(spark, d):
    got = kmeans.kmeans(_vectors(spark, d), k=16, n_init=2)
    return spark.createDataFrame([(len(got["centroids"]), got["iters"], got["reseeds"], got["inertia"])], "k int, iters int, reseeds int, inertia double")


# ---- product quantization


def _book(v: DataFrame) -> pq.Codebook:
    return pq.first_vectors_codebook(v, dimension(v), M)


_PQ = f"""WITH {_V}, subs AS (SELECT id, s, list_slice(e, s * (len(e) // {M}) + 1, (s + 1) * (len(e) // {M})) AS x FROM v, range({M}) r(s)),
book AS (SELECT s, rank AS code, x AS c FROM subs JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS rank FROM v ORDER BY id LIMIT 256) USING (id)),
enc AS (SELECT id, s, code FROM (SELECT subs.id, subs.s, code, row_number() OVER (PARTITION BY subs.id, subs.s ORDER BY round(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9), code) AS r FROM subs JOIN book USING (s)) WHERE r = 1),
tab AS (SELECT q.query_id, book.s, code, list_sum(list_transform(list_zip(list_slice(qe, book.s * (len(qe) // {M}) + 1, (book.s + 1) * (len(qe) // {M})), c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS t FROM q, book),
adc AS (SELECT query_id, id, round(sum(t), 9) AS dist FROM enc JOIN tab USING (s, code) GROUP BY ALL),
adcr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM adc)"""
_RERANK = f""", rr AS (SELECT query_id, id, dist, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM (SELECT query_id, id, round({_L2}, 9) AS dist FROM adcr JOIN q USING (query_id) JOIN v USING (id) WHERE rank <= 20)),
ex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM (SELECT query_id, id, round({_L2}, 9) AS dist FROM q, v)) WHERE rank <= {K})"""


@query(f"{_PQ} SELECT id, list(CAST(code AS INTEGER) ORDER BY s) AS code FROM enc GROUP BY id")
def pq_encode(spark, d):
    v = _vectors(spark, d)
    return pq.encode(v, _book(v))


@query(f"{_PQ} SELECT query_id, id, round(dist, 6) AS dist, rank FROM adcr WHERE rank <= {K}")
def pq_adc_topk(spark, d):
    v = _vectors(spark, d)
    book = _book(v)
    return _out(pq.adc_topk(_asked(v), pq.encode(v, book), book, K))


@query(f"{_PQ} {_RERANK} SELECT query_id, id, round(dist, 6) AS dist, rank FROM rr WHERE rank <= {K}")
def pq_rerank_topk(spark, d):
    v = _vectors(spark, d)
    book = _book(v)
    return _out(pq.search_rerank(_asked(v), pq.encode(v, book), v, book, K, 20))


@query(f"""{_PQ}, sq AS (SELECT enc.id, sum(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS err FROM enc JOIN subs USING (id, s) JOIN book ON book.s = enc.s AND book.code = enc.code GROUP BY enc.id)
SELECT count(*) AS n, round(avg(err), 6) AS reconstruction_error FROM sq""")
def pq_reconstruction_error(spark, d):
    v = _vectors(spark, d)
    book = _book(v)
    return pq.reconstruction_error(v, pq.encode(v, book), book)


@query(f"""WITH {_V}, n AS (SELECT count(*) AS n, least(count(*), 256) AS k, max(len(e)) AS dim FROM v)
SELECT n AS n_codes, n * {M} AS code_bytes, CAST(4 * k * dim AS BIGINT) AS codebook_bytes, CAST({M} AS DOUBLE) AS bytes_per_vector, 4.0 * dim / {M} AS compression_ratio FROM n""")
def pq_footprint(spark, d):
    v = _vectors(spark, d)
    book = _book(v)
    return pq.footprint(pq.encode(v, book), book)


@query(f"{_PQ} {_RERANK} SELECT ex.query_id, round(count(a.id) / {K}, 6) AS recall FROM ex LEFT JOIN (SELECT * FROM adcr WHERE rank <= {K}) a ON a.query_id = ex.query_id AND a.id = ex.id GROUP BY ex.query_id")
def recall_at_k(spark, d):
    v = _vectors(spark, d)
    book = _book(v)
    q = _asked(v)
    return evaluate.recall_at_k(pq.adc_topk(q, pq.encode(v, book), book, K), exact.exact_knn(q, v, K, "l2", dimension(v)), K).select("query_id", F.round("recall", 6).alias("recall"))


@query(f"""{_PQ} {_RERANK}, f AS (SELECT * FROM rr WHERE rank <= {K}), kth AS (SELECT query_id, max(dist) AS kth FROM f GROUP BY 1)
SELECT ex.query_id, ex.id, round(ex.dist, 6) AS dist, CASE WHEN ex.dist = kth THEN 'tie' WHEN ex.dist > kth THEN 'farther' ELSE 'nearer' END AS verdict
FROM ex ANTI JOIN f ON ex.query_id = f.query_id AND ex.id = f.id LEFT JOIN kth ON ex.query_id = kth.query_id""")
def recall_tie_diagnosis(spark, d):
    v = _vectors(spark, d)
    book = _book(v)
    q = _asked(v)
    found = pq.search_rerank(q, pq.encode(v, book), v, book, K, 20)
    return evaluate.diagnose(found, exact.exact_knn(q, v, K, "l2", dimension(v)), K).select("query_id", "id", F.round("dist", 6).alias("dist"), "verdict")


@query()
def pq_trained_recall(spark, d):
    v = _vectors(spark, d)
    q = _asked(v)
    book = pq.train(v, dimension(v), M, iters=10, n_init=1)
    codes = pq.encode(v, book)
    truth = exact.exact_knn(q, v, K, "l2", dimension(v))
    one = lambda found, name: evaluate.recall_at_k(found, truth, K).agg(F.round(F.avg("recall"), 6).alias("recall")).withColumn("method", F.lit(name))
    return one(pq.adc_topk(q, codes, book, K), "adc").unionByName(one(pq.search_rerank(q, codes, v, book, K, 100), "rerank"))


# ---- graphs

_U = "(CAST(CAST('0x' || substr(md5('42:' || CAST(vec_id AS VARCHAR)), 1, 12) AS BIGINT) AS DOUBLE) + 1) / 281474976710657.0"
_LEVELS = f"SELECT vec_id AS id, CAST(least(floor(-ln({_U}) / ln(16)), 30) AS INTEGER) AS level FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL"


@query(_LEVELS)
def graph_levels(spark, d):
    return _vectors(spark, d).select("id", graph_level(F.col("id"), 16).alias("level"))


@query(f"WITH l AS ({_LEVELS}) SELECT CAST(g.level AS INTEGER) AS level, count(*) AS nodes FROM l, range(31) g(level) WHERE g.level <= l.level GROUP BY 1")
def graph_level_histogram(spark, d):
    return graph.level_histogram(graph.build_graph(_vectors(spark, d)))


@query(_knn_sql(_L2))
def graph_full_beam(spark, d):
    """With a beam as wide as the graph the search is exact."""
    v = _vectors(spark, d)
    g = written(graph.build_graph(v, ef_construction=100, shard_rows=300), "graph")
    return _out(graph.search_graph(g, _asked(v), K, ef=100_000))


@query()
def graph_recall_curve(spark, d):
    v = _vectors(spark, d)
    q = _asked(v)
    g = written(graph.build_graph(v, shard_rows=1_000), "graph")
    truth = written(exact.exact_knn(q, v, K, "l2", dimension(v)), "truth")
    out = None
    for ef in (10, 40, 160):
        found = graph.search_graph(g, q, K, ef)
        one = evaluate.recall_at_k(found, truth, K).agg(F.round(F.avg("recall"), 6).alias("recall")).select(F.lit(ef).alias("ef"), "recall")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_V}, f AS (SELECT min(id) AS base FROM v), c AS (SELECT a.id, a.e, round(list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 12) AS dist FROM v a, v b, f WHERE b.id = base AND a.id <> base),
o AS (SELECT *, row_number() OVER (ORDER BY dist, id) AS n FROM c),
near AS (SELECT x.n AS n, y.n AS m FROM o x JOIN o y ON y.n < x.n WHERE list_sum(list_transform(list_zip(x.e, y.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) < x.dist)
SELECT id, CAST(n AS INTEGER) AS place FROM o WHERE n <= 1 UNION ALL
SELECT id, CAST(2 AS INTEGER) AS place FROM o WHERE n = (SELECT min(n) FROM o WHERE n > 1 AND n NOT IN (SELECT n FROM near WHERE m = 1))""")
def neighbor_heuristic(spark, d):
    """The first two diverse neighbours of the smallest id, all others being its candidates."""
    v = _vectors(spark, d)
    first = v.agg(F.min("id")).first()[0]
    return graph.neighbor_heuristic(v, first, 2, keep_pruned=False)


@query("SELECT count(*) AS queries, 1 AS above FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND vec_id % 100 = 0")
def graph_search_floor(spark, d):
    """Whether a beam far narrower than the shards reaches a recall of 0.9 on the project's queries."""
    v = _vectors(spark, d)
    q = _asked(v)
    g = written(graph.build_graph(v, shard_rows=1_000), "graph")
    found = graph.search_graph(g, q, K, ef=64)
    return evaluate.recall_at_k(found, exact.exact_knn(q, v, K, "l2", dimension(v)), K, base=v.select("id")).agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).cast("int").alias("above"))


@query()
def graph_stats(spark, d):
    return graph.graph_stats(graph.build_graph(_vectors(spark, d)))


@query("SELECT CAST(0 AS BIGINT) AS violations")
def graph_invariants(spark, d):
    g = written(graph.build_graph(_vectors(spark, d), shard_rows=1_000), "graph")
    return graph.check_invariants(g, 16).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations"))


# ---- metrics and records


@query("""SELECT event_type, count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS stddev,
quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY event_type""")
def latency_summary(spark, d):
    return evaluate.latency_summary(table(spark, d, "events"), "event_type", "value")


@query("SELECT event_type, list_sort(list(value))[count(value) // 2 + 1] AS upper_median FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_upper_median(spark, d):
    return table(spark, d, "events").filter("value is not null").groupBy("event_type").agg(evaluate.upper_median("value").alias("upper_median"))


_LATEST = "(SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events WHERE {})"


@query(f"SELECT user_id, event_id, value FROM {_LATEST.format('true')} WHERE r = 1")
def records_latest(spark, d):
    return records.latest_per_key(table(spark, d, "events"), ["user_id"], "event_id").select("user_id", "event_id", "value")


@query(f"""SELECT user_id, a.value AS a, b.value AS b, CASE WHEN b.value <> 0 THEN round(a.value / b.value, 6) END AS ratio
FROM {_LATEST.format("event_id % 2 = 0")} a JOIN {_LATEST.format("event_id % 2 = 1")} b USING (user_id) WHERE a.r = 1 AND b.r = 1""")
def records_paired(spark, d):
    """Even and odd events stand for two systems; the last of each user on both sides is paired."""
    e = table(spark, d, "events")
    return records.paired(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "user_id", "event_id", "value")


@query("""WITH p AS (SELECT CAST(100 * l_linenumber + count(*) % 100 AS BIGINT) AS n, l_linenumber / 3.5 AS speedup FROM lineitem WHERE l_linenumber IS NOT NULL GROUP BY l_linenumber),
w AS (SELECT n, speedup, lead(n) OVER (ORDER BY n) AS n2, lead(speedup) OVER (ORDER BY n) AS s2 FROM p)
SELECT n AS n_low, n2 AS n_high, round(exp(ln(n) + (1 - speedup) / (s2 - speedup) * (ln(n2) - ln(n))), 6) AS n_cross FROM w WHERE speedup < 1 AND s2 >= 1 ORDER BY n LIMIT 1""")
def crossover_point(spark, d):
    """Line numbers stand for the sizes of a sweep, kept as records in a file: n_base and the measured speedup."""
    lines = table(spark, d, "lineitem").filter("l_linenumber is not null").groupBy("l_linenumber").agg(F.count("*").alias("c"))
    points = lines.select((100 * F.col("l_linenumber") + F.col("c") % 100).cast("long").alias("n_base"), F.struct((F.col("l_linenumber") / 3.5).alias("speedup")).alias("measurements"))
    path = scratch(spark, "sweep-records")
    records.append_records(points, path)
    return records.crossover(records.read_records(spark, path).select(F.col("n_base").alias("n"), F.col("measurements.speedup").alias("speedup")))


_ENV_OF = "event_id % 5 = 0 AS debug, event_id % 11 = 0 AS san, event_type = 'click' AS lost, event_id % 7 = 0 AS dirty"


@query(f"""WITH e AS (SELECT event_id, value, user_id, {_ENV_OF} FROM events WHERE event_id IS NOT NULL),
r AS (SELECT *, CASE WHEN debug THEN 'build type is Debug, not Release' WHEN san THEN 'built with sanitizers (address)' WHEN lost THEN 'git SHA could not be resolved' WHEN dirty THEN 'working tree is dirty' END AS reason FROM e)
SELECT coalesce(reason, '') AS reason, count(*) AS records, count(*) FILTER (reason IS NULL AND user_id % 3 <> 0) AS published FROM r GROUP BY 1""")
def records_published(spark, d):
    """Events stand for runs: written as records with their environment, read back, and gated."""
    e = table(spark, d, "events").filter("event_id is not null").selectExpr("event_id", "value", "user_id", *_ENV_OF.split(", "))
    env = e.select(
        "event_id", "value", "user_id", F.when(F.coalesce("lost", F.lit(False)), "unknown").otherwise("abc1234").alias("git_sha"), F.col("dirty").alias("git_dirty"),
        F.when(F.col("debug"), "Debug").otherwise("Release").alias("build_type"), F.when(F.col("san"), "address").otherwise("none").alias("sanitizers"),
    )
    env = env.withColumn("reason", F.coalesce(records.untrusted_reason(*(F.col(c) for c in ("git_sha", "git_dirty", "build_type", "sanitizers"))), F.lit("")))
    run = env.select(
        F.lit("flat").alias("index"), F.col("event_id").alias("n_base"), F.struct(F.when(F.col("user_id") % 3 == 0, "threads").otherwise("flat").alias("kind")).alias("index_params"), F.struct(F.col("value").alias("qps_mean")).alias("measurements"),
        F.struct("git_sha", "git_dirty", "build_type", "sanitizers", F.col("reason").alias("untrusted_reason"), (F.col("reason") == "").alias("trusted")).alias("env"),
    )
    path = scratch(spark, "records")
    records.append_records(run, path)
    back = records.read_records(spark, path)
    good = records.publishable(back, without=("threads",)).groupBy(F.col("env.untrusted_reason").alias("reason")).agg(F.count("*").alias("published"))
    every = back.groupBy(F.col("env.untrusted_reason").alias("reason")).agg(F.count("*").alias("records"))
    return every.join(good, "reason", "left").select("reason", "records", F.coalesce("published", F.lit(0)).alias("published"))


@query("""SELECT event_type, list(d ORDER BY d) AS days, list(n ORDER BY d) AS counts FROM (SELECT event_type, CAST(dayofmonth(ts) AS INTEGER) AS d, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL) GROUP BY event_type""")
def records_curves(spark, d):
    """Events a day as the points of one curve for each type."""
    g = table(spark, d, "events").filter("ts is not null").groupBy("event_type", F.dayofmonth("ts").alias("d")).agg(F.count("*").alias("n"))
    points = records.curves(g, ["event_type"], "d", "n")
    return points.select("event_type", F.transform("points", lambda p: p["x"]).alias("days"), F.transform("points", lambda p: p["y0"]).alias("counts"))


@query("""SELECT event_type, count(*) AS trials, round(avg(1 / value * 1000), 6) AS qps_mean, round(coalesce(stddev_samp(1 / value * 1000), 0), 6) AS qps_stddev, min(value) AS best_ms FROM events WHERE value > 0 GROUP BY event_type""")
def trial_rates(spark, d):
    """Each event stands for a trial of one query."""
    return records.trial_rates(table(spark, d, "events").withColumn("one", F.lit(1)).filter("not isnan(value)"), ["event_type"], "one", "value")


@query("SELECT user_id, event_id FROM events WHERE user_id = (SELECT max(user_id) FROM events)")
def records_largest_base(spark, d):
    return records.largest_base(table(spark, d, "events"), "user_id").select("user_id", "event_id")


@query("""WITH g AS (SELECT event_type, dayofmonth(ts) AS threads, round(sum(value), 6) AS qps FROM events WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY ALL)
SELECT event_type, CAST(threads AS INTEGER) AS threads, qps, round(qps / first_value(qps) OVER (PARTITION BY event_type ORDER BY threads), 6) AS speedup,
round(qps / first_value(qps) OVER (PARTITION BY event_type ORDER BY threads) / threads, 6) AS efficiency FROM g""")
def records_scaling(spark, d):
    """Days stand for thread counts, summed values for rates."""
    g = table(spark, d, "events").filter("value is not null and ts is not null").groupBy("event_type", F.dayofmonth("ts").alias("threads")).agg(F.round(F.sum("value"), 6).alias("qps"))
    return records.scaling(g, "event_type")


# ---- persistence, streams, formats, SQL surface


@query(_knn_sql(_L2))
def save_load_roundtrip(spark, d):
    v = _vectors(spark, d)
    g = graph.build_graph(v, ef_construction=100, shard_rows=300)
    root = scratch(spark, "snapshot")
    snapshot.save({"graph": g}, root, "graph", dimension(v), {"m": 16})
    tables, _ = snapshot.load(spark, root, "graph")
    return _out(graph.search_graph(tables["graph"], _asked(v), K, ef=100_000))


@query(f"{_PQ} SELECT query_id, id, round(dist, 6) AS dist, rank FROM adcr WHERE rank <= {K}")
def quantizer_roundtrip(spark, d):
    """Codes and codebook saved and loaded, then searched without vectors."""
    v = _vectors(spark, d)
    root = scratch(spark, "quantizer")
    PqIndex(v, book=_book(v)).save(root)
    return _out(PqIndex.load(spark, root).search(_asked(v), K))


@query(_knn_sql(_L2))
def graph_incremental_add(spark, d):
    """Odd ids added to a graph of the even ones."""
    v = _vectors(spark, d)
    index = GraphIndex(v.filter("id % 2 = 0"), ef_construction=100, shard_rows=300).add(v.filter("id % 2 = 1"))
    return _out(index.search(_asked(v), K, ef=100_000))


@query(_knn_sql(_L2))
def incremental_append_knn(spark, d):
    v = _vectors(spark, d)
    root, at, box = scratch(spark, "appended"), scratch(spark, "append-state"), scratch(spark, "append-in")
    v.repartition(3).write.parquet(box)
    stream = spark.readStream.schema("id long, embedding array<float>").option("maxFilesPerTrigger", 1).parquet(box)
    append.run_available(stream, root, at, dim=dimension(v))
    return _out(exact.exact_knn(_asked(v), append.current(spark, root), K, "l2", dimension(v)))


@query("SELECT vec_id AS id, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL")
def xvecs_roundtrip(spark, d):
    """Written as .fvecs and read back; the format keeps no ids, so they are matched by the smallest id of a vector."""
    xvecs.register(spark)
    v = _vectors(spark, d)
    path = scratch(spark, "xvecs")
    v.select("id", "embedding").write.format("fvecs").mode("overwrite").save(path)
    back = spark.read.format("fvecs").load(path)
    total = F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 6)
    return v.join(back.select("embedding").distinct(), "embedding").select("id", total.alias("total"), F.size("embedding").alias("dim"))


@query(_knn_sql(_L2))
def sql_function_knn(spark, d):
    v = _vectors(spark, d)
    sqlfuncs.register(spark)
    v.createOrReplaceTempView("quillon_base")
    if _asked(v).count() > exact.BROADCAST_QUERIES:
        return _out(exact.exact_knn_block(_asked(v), v, K))
    return spark.sql(f"""SELECT query_id, id, round(dist, 6) AS dist, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM (
        SELECT /*+ BROADCAST(q) */ q.id AS query_id, b.id, round(l2_sq(q.embedding, b.embedding), 9) AS dist
        FROM (SELECT * FROM quillon_base WHERE id % 100 = 0) q CROSS JOIN quillon_base b)) WHERE rank <= {K}""")


@query(f"""WITH {_V}, d AS (SELECT query_id, id, round({_L2}, 6) AS dist FROM q, v), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM d)
SELECT query_id, id, dist FROM r WHERE rank <= {K}""")
def lateral_knn(spark, d):
    v = _vectors(spark, d)
    if _asked(v).count() > exact.BROADCAST_QUERIES:
        return exact.exact_knn_block(_asked(v), v, K).select("query_id", "id", F.round("dist", 6).alias("dist"))
    sqlfuncs.register(spark, v, k=K)
    _asked(v).createOrReplaceTempView("quillon_asked")
    return spark.sql("SELECT q.query_id, n.id, n.dist FROM quillon_asked q, LATERAL knn_at(q.embedding) n")


@query(f"""WITH docs AS (SELECT doc_id, max(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
{_DOCS.split("GROUP BY doc_id)," + chr(10), 1)[1]},
qs AS (SELECT doc_id AS query_id, text FROM docs WHERE doc_id % 100 = 0),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT doc_id AS query_id, unnest(t) AS term FROM tok WHERE doc_id % 100 = 0) GROUP BY ALL),
{_bm25_sql('b')}, {_V}, dd AS (SELECT query_id, id, round({_L2}, 9) AS dist FROM q, v),
dense AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM dd) WHERE rank <= {K}),
{_rrf_sql(['b', 'dense'])}
SELECT query_id, rank, id, doc_key FROM f JOIN (SELECT doc_id AS id, min(source) AS doc_key FROM documents GROUP BY 1) USING (id)""")
def hybrid_retriever(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("doc_key"), "text")
    v = _vectors(spark, d)
    asked = docs.filter("doc_id % 100 = 0").groupBy(F.col("doc_id").alias("query_id")).agg(F.max("text").alias("text"))
    asked = asked.join(v.select(F.col("id").alias("query_id"), "embedding"), "query_id", "left")
    return HybridRetriever(docs, v, use_dense=True).search(asked, K)
