import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions.distance import METRICS, distance, l2_normalize, l2_sq, neg_ip
from quillon.operators import evaluate, exact, graph, kmeans, pq, topk
from quillon.operators.retriever import HybridRetriever
from quillon.plans.schema import DimensionError, dimension

V = "id long, embedding array<float>"


def vectors(spark, x, name="id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} long, embedding array<float>")


@pytest.fixture(scope="module")
def cloud():
    return np.random.default_rng(3).normal(size=(300, 8)).astype(np.float32)


def brute(q, b, k):
    d = ((q[:, None].astype(float) - b[None].astype(float)) ** 2).sum(-1)
    return {(i, int(j)) for i in range(len(q)) for j in np.lexsort((np.arange(len(b)), np.round(d[i], 9)))[:k]}


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 6.0, 3.0])], "a array<float>, b array<float>")
    for dim in (None, 3):
        assert df.select(l2_sq(F.col("a"), F.col("b"), dim), neg_ip(F.col("a"), F.col("b"), dim)).first() == (25.0, -25.0)
    assert df.select(F.size(l2_normalize(F.col("a")))).first()[0] == 3
    zero = spark.createDataFrame([([0.0, 0.0],)], "a array<float>")
    assert zero.select(l2_normalize(F.col("a"))).first()[0] is None
    with pytest.raises(ValueError):
        distance("hamming", F.col("a"), F.col("b"))
    assert set(METRICS) == {"l2", "ip", "cosine"}


def test_topk_ties_and_limits(spark):
    df = spark.createDataFrame([(0, 9, 1.0), (0, 3, 1.0), (0, 7, 1.0), (1, 5, float("nan")), (1, 6, 2.0)], "query_id long, id long, dist double")
    assert [r.id for r in topk.topk_per(df, 2).filter("query_id = 0").orderBy("rank").collect()] == [3, 7]
    assert [r.id for r in topk.topk_per(df, 5).filter("query_id = 1").orderBy("rank").collect()] == [6, 5]
    assert topk.topk_per(df, 0).count() == 0 and topk.topk_global(df, 0).count() == 0
    assert [r.id for r in topk.topk_global(df, 2).collect()] == [3, 7]


def test_line_points(spark):
    base = vectors(spark, [[i] for i in range(10)])
    q = spark.createDataFrame([(0, [3.2])], "query_id long, embedding array<float>")
    for f in (exact.exact_knn, exact.exact_knn_block):
        got = f(q, base, 3).orderBy("rank").collect()
        assert [r.id for r in got] == [3, 4, 2] and got[0].dist == pytest.approx(0.04, abs=1e-6)


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_exact_paths_agree(spark, cloud, metric):
    base = vectors(spark, cloud).unionByName(spark.createDataFrame([(1000, None)], V))
    q = vectors(spark, cloud[:20] * 1.5, "query_id")
    a = {(r.query_id, r.id, r.rank) for r in exact.exact_knn(q, base, 5, metric, 8).collect()}
    b = {(r.query_id, r.id, r.rank) for r in exact.exact_knn_block(q, base, 5, metric, query_block=7, base_block=50).collect()}
    c = {(r.query_id, r.id, r.rank) for r in exact.exact_knn(q, base, 5, metric, most_broadcast=3).collect()}
    assert a == b == c and len(a) == 100
    if metric == "l2":
        assert {x[:2] for x in a} == brute(cloud[:20] * np.float32(1.5), cloud, 5)


def test_empty_sides(spark):
    none = spark.createDataFrame([], V)
    q = spark.createDataFrame([(0, [1.0])], "query_id long, embedding array<float>")
    assert exact.exact_knn(q, none, 3).count() == 0 and exact.exact_knn_block(q, none, 3).count() == 0
    assert dimension(none) == 0
    with pytest.raises(DimensionError):
        dimension(vectors(spark, [[1.0]]).unionByName(spark.createDataFrame([(7, [1.0, 2.0])], V)))


def test_recall_and_diagnosis(spark):
    rows = lambda q, ids: [(q, i, k + 1) for k, i in enumerate(ids)]
    found = spark.createDataFrame(rows(0, [5, 3, 9]) + rows(1, [5, 3, 9]) + rows(2, [5, 3, 9]), "query_id long, id long, rank int")
    truth = evaluate.truth_rows(spark.createDataFrame([(0, [3, 5, 9, 1]), (1, [3, 5, 42]), (2, [1, 2, 4])], "query_id long, neighbors array<int>"), 3)
    got = {r.query_id: r.recall for r in evaluate.recall_at_k(found, truth, 3).collect()}
    assert got == {0: 1.0, 1: pytest.approx(2 / 3), 2: 0.0}
    assert {r.recall for r in evaluate.recall_at_k(found, truth, 0).collect()} == {1.0}
    ours = spark.createDataFrame([(0, 1, 1.0, 1), (0, 2, 2.0, 2)], "query_id long, id long, dist double, rank int")
    theirs = spark.createDataFrame([(0, 1, 1.0), (0, 3, 2.0), (0, 4, 1.5)], "query_id long, id long, dist double")
    assert {(r.id, r.verdict) for r in evaluate.diagnose(ours, theirs, 2).collect()} == {(3, "tie"), (4, "nearer")}


def test_latency_summary(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 11)] + [("b", 1.0), ("b", None)], "t string, value double")
    got = {r.t: r for r in evaluate.latency_summary(df, "t", "value").collect()}
    assert (got["a"].p50, got["a"].p99, got["a"].max) == (5.0, 10.0, 10.0) and got["b"].stddev == 0.0 and got["b"].n == 1
    sd = spark.createDataFrame([("a", float(x)) for x in (2, 4, 4, 4, 5, 5, 7, 9)], "t string, value double")
    assert evaluate.latency_summary(sd, "t", "value").first().stddev == pytest.approx(2.13809, abs=1e-5)
    assert df.filter("t = 'a'").groupBy("t").agg(evaluate.upper_median("value")).first()[1] == 6.0
    assert df.groupBy("t").agg(evaluate.percentile("value", 0.9).alias("p")).filter("t = 'a'").first().p == 9.0


def test_kmeans_laws(spark):
    rng = np.random.default_rng(0)
    blobs = np.concatenate([np.array(c) + rng.normal(0, 0.2, (50, 2)) for c in ((-40, -40), (-40, 40), (40, -40), (40, 40))]).astype(np.float32)
    got = kmeans.kmeans(vectors(spark, blobs), k=4)
    assert got["inertia"] < 200 and sorted(map(tuple, np.sign(got["centroids"]))) == [(-1, -1), (-1, 1), (1, -1), (1, 1)]
    assert got["inertia_per_init"] == sorted(got["inertia_per_init"])
    same = kmeans.kmeans(vectors(spark, np.ones((10, 3))), k=256)
    assert len(same["centroids"]) == 10 and same["inertia"] == 0
    assert len(kmeans.kmeans(spark.createDataFrame([], V))["centroids"]) == 0
    two = kmeans.train_local(np.repeat([[0.0, 0.0], [5.0, 5.0]], 50, axis=0), 16, 25, 1e-4, 42, 1)
    assert two["inertia"] == 0
    c, inertia, _, reseeds = kmeans.lloyd(vectors(spark, blobs), np.array([[0.0, 0.0], [999.0, 999.0]]), 5)
    assert reseeds >= 1 and np.isfinite(c).all() and inertia > 0


def test_quantizer(spark, cloud):
    v = vectors(spark, cloud)
    with pytest.raises(ValueError):
        pq.train(v, 8, 3)
    book = pq.first_vectors_codebook(v, 8, 4)
    codes = pq.encode(v, book)
    foot = pq.footprint(codes, book).first()
    assert (foot.n_codes, foot.code_bytes, foot.bytes_per_vector, foot.compression_ratio) == (300, 1200, 4.0, 8.0)
    q = vectors(spark, cloud[:10], "query_id")
    truth = exact.exact_knn(q, v, 5)
    mean = lambda f: evaluate.recall_at_k(f, truth, 5).agg(F.avg("recall")).first()[0]
    adc, again = mean(pq.adc_topk(q, codes, book, 5)), mean(pq.search_rerank(q, codes, v, book, 5, 300))
    assert adc > 0.5 and again == 1.0
    errors = [pq.reconstruction_error(v, pq.encode(v, b), b).first().reconstruction_error for b in (pq.train(v, 8, m, iters=5, n_init=1) for m in (2, 8))]
    assert errors[1] < errors[0]
    chunked = {tuple(r) for r in pq.adc_topk(q, codes, book, 5, most_queries=3).collect()}
    assert chunked == {tuple(r) for r in pq.adc_topk(q, codes, book, 5).collect()}
    few = pq.first_vectors_codebook(vectors(spark, cloud[:20]), 8, 4)
    assert len(few.parts[0]) == 20  # only trained centroids


def test_graph(spark, cloud):
    v = vectors(spark, cloud)
    with pytest.raises(ValueError):
        graph.build_graph(v, m=1)
    q = vectors(spark, cloud[:25] + np.float32(0.05), "query_id")
    truth = exact.exact_knn(q, v, 10)
    for shard_rows in (1000, 120):
        g = graph.build_graph(v, m=8, ef_construction=60, shard_rows=shard_rows).cache()
        assert graph.check_invariants(g, 8).count() == 0
        full = {(r.query_id, r.id, r.rank) for r in graph.search_graph(g, q, 10, ef=1000).collect()}
        assert full == {(r.query_id, r.id, r.rank) for r in truth.collect()}
        recalls = [evaluate.recall_at_k(graph.search_graph(g, q, 10, ef), truth, 10).agg(F.avg("recall")).first()[0] for ef in (10, 80)]
        assert recalls[1] >= recalls[0] and recalls[1] >= 0.95
        assert graph.search_graph(g, q, 10, ef=1).filter("query_id = 0").count() == 10
        assert graph.graph_stats(g).first().nodes == 300
    wide = graph.build_graph(v, m=4, ef_construction=20, extend=True, keep_pruned=False)
    assert graph.check_invariants(wide, 4).count() == 0
    one = graph.build_graph(vectors(spark, [[1.0, 2.0]]))
    q1 = spark.createDataFrame([(0, [0.0, 0.0])], "query_id long, embedding array<float>")
    assert [r.id for r in graph.search_graph(one, q1, 10).collect()] == [0]
    bad = spark.createDataFrame([(0, 1, 0, [1.0], [[1, 1]])], "shard int, id long, level int, embedding array<float>, links array<array<long>>")
    assert {r.violation for r in graph.check_invariants(bad, 4).collect()} == {"link to itself", "link held twice"}


def test_level_ratio(spark):
    from quillon.functions.draws import graph_level

    n = {r.level: r["count"] for r in spark.range(20000).select(graph_level(F.col("id"), 16).alias("level")).groupBy("level").count().collect()}
    above = sum(c for lv, c in n.items() if lv >= 1)
    assert 0.75 / 16 < above / 20000 < 1.25 / 16


def test_nan_comes_last_on_both_ways(spark):
    nan = float("nan")
    base = spark.createDataFrame([(1, [nan, 1.0]), (2, [9.0, 9.0]), (3, [0.0, 0.0]), (4, None)], "id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 1.0]), (1, [0.0, 0.0])], "query_id long, embedding array<float>")
    for metric in ("l2", "cosine", "ip"):
        few, many = ([(r.query_id, r.id, r.rank) for r in got.orderBy("query_id", "rank").collect()] for got in (exact.exact_knn(q, base, 3, metric, 2), exact.exact_knn(q, base, 3, metric, 2, most_broadcast=1)))
        assert few == many and few
    assert [r[1] for r in [(r.rank, r.id) for r in exact.exact_knn_block(q, base, 3).filter("query_id = 0").orderBy("rank").collect()]] == [3, 2, 1]
    own = exact.exact_knn(q, base.filter("id > 1"), 1, lambda a, b, dim: F.abs(a[0] - b[0]).cast("double"))
    assert {(r.query_id, r.id) for r in own.collect()} == {(0, 3), (1, 3)}


def test_guards(spark):
    truth = spark.createDataFrame([(0, 1), (0, 9)], "query_id long, id long")
    with pytest.raises(ValueError):
        evaluate.recall_at_k(truth.withColumn("rank", F.lit(1)), truth, 2, base=spark.range(5))
    with pytest.raises(ValueError):
        kmeans.kmeans(spark.createDataFrame([(1, [float("nan"), 1.0]), (2, [1.0, 2.0])], "id long, embedding array<float>"), k=2)
    docs = spark.createDataFrame([(0, "a", "x"), (1, "b", "y")], "doc_id long, doc_key string, text string")
    v = spark.createDataFrame([(0, [1.0]), (7, [2.0])], "id long, embedding array<float>")
    with pytest.raises(ValueError):
        HybridRetriever(docs, v, use_dense=True).check()
    assert HybridRetriever(docs, v.withColumn("id", F.least("id", F.lit(1))), use_dense=True).check()
    assert [r[0] for r in spark.createDataFrame([(2.0, 1.0), (2.0, 0.0)], "a double, b double").select(evaluate.relative_lift(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0]
    assert spark.createDataFrame([(float(x),) for x in (4, 1, 3, 2)], "v double").agg(evaluate.upper_median("v")).first()[0] == 3.0


def test_distance_calls_are_summed_over_shards(spark, cloud):
    base = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(np.asarray(cloud)[:90])], "id long, embedding array<float>")
    q = base.limit(3).withColumnRenamed("id", "query_id")
    got = graph.search_graph(graph.build_graph(base, m=4, ef_construction=20, shards=3), q, 5, ef=10).collect()
    assert all(len({r.distance_calls for r in got if r.query_id == i}) == 1 for i in {r.query_id for r in got}) and min(r.distance_calls for r in got) > 30


def test_many_queries_are_scanned_in_blocks(spark, cloud):
    base, q = vectors(spark, cloud), vectors(spark, cloud[:30], "query_id")
    book = pq.first_vectors_codebook(base, 8, 4, 16)
    codes = pq.encode(base, book)
    rows = lambda **kw: sorted(map(tuple, pq.adc_topk(q, codes, book, 5, **kw).collect()))
    assert rows() == rows(most_queries=3, query_block=7, code_block=64) and len(rows()) == 150
    assert pq.adc_topk(q.limit(0), codes, book, 5).count() == 0
