import numpy as np
import pytest

from quillon.api import Bm25Index, FlatIndex, GraphIndex, PqIndex
from quillon.operators import records
from quillon.plans.schema import DimensionError
from quillon.plans.snapshot import SnapshotError


def vectors(spark, x, start=0, name="id"):
    return spark.createDataFrame([(start + i, [float(v) for v in r]) for i, r in enumerate(x)], f"{name} long, embedding array<float>")


def test_graph_index(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(120, 6)).astype(np.float32)
    q = vectors(spark, x[:10], name="query_id")
    want = {(r.query_id, r.id) for r in FlatIndex(vectors(spark, x)).search(q, 5).collect()}
    index = GraphIndex(vectors(spark, x[:80]), m=6, ef_construction=40).add(vectors(spark, x[80:], 80))
    assert {(r.query_id, r.id) for r in index.search(q, 5, ef=500).collect()} == want
    index.save(str(tmp_path / "g"))
    again = GraphIndex.load(spark, str(tmp_path / "g"))
    assert {(r.query_id, r.id) for r in again.search(q, 5, ef=500).collect()} == want and again.stats().first().nodes == 120
    with pytest.raises(ValueError):
        again.add(vectors(spark, x[:1]))
    with pytest.raises(DimensionError):
        again.add(vectors(spark, [[1.0]], 999))


def test_quantizer_index(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(150, 8)).astype(np.float32)
    v, q = vectors(spark, x), vectors(spark, x[:5], name="query_id")
    index = PqIndex(v, m=4, iters=4, n_init=1)
    index.save(str(tmp_path / "p"))
    bare = PqIndex.load(spark, str(tmp_path / "p"))
    rows = lambda i: sorted(map(tuple, i.search(q, 5).collect()))
    assert rows(bare) == rows(index) and bare.footprint().first().compression_ratio == 8.0
    with pytest.raises(ValueError):
        bare.search_rerank(q, 5)
    full = PqIndex.load(spark, str(tmp_path / "p"), v)
    assert full.search_rerank(q, 1, 150).filter("id = query_id").count() == 5 and full.reconstruction_error().first().n == 150
    with pytest.raises(SnapshotError):
        GraphIndex.load(spark, str(tmp_path / "p"))


def test_text_index(spark):
    index = Bm25Index(spark.createDataFrame([(0, "a b"), (1, "b c")], "doc_id long, text string"))
    assert index.search(spark.createDataFrame([(0, "c")], "query_id long, text string")).first().id == 1
    assert index.stats().first().vocab_size == 3 and index.idf().count() == 3


def test_record_rules(spark):
    full = "index string, n_base long, k long, index_params struct<kind:string>, env struct<trusted:boolean>, measurements struct<recall_at_k:double,qps_mean:double>"
    rows = spark.createDataFrame(
        [("hnsw", 5, 10, ("hnsw",), (True,), (0.9, 1.0)), ("hnsw", 9, 10, ("threads",), (True,), (0.9, 1.0)), ("pq", 9, 10, ("pq",), (False,), (0.9, 1.0)), ("flat", 9, 10, ("flat",), (True,), (None, 1.0)), ("flat", 9, 10, None, None, (0.5, 1.0))], full
    )
    assert sorted(r.n_base for r in records.publishable(rows, without=("threads",)).collect()) == [5, 9]  # the last has neither index_params nor env
    assert records.publishable(rows, trusted_only=False).count() == 4 and records.largest_base(rows).count() == 4
    pts = spark.createDataFrame([("a", 80, 0.9), ("a", 9, 0.5)], "g string, ef int, r double")
    assert [tuple(p) for p in records.curves(pts, ["g"], "ef", "r").first().points] == [(9, 0.5), (80, 0.9)]
    rate = records.trial_rates(spark.createDataFrame([("a", 10, 5.0), ("a", 10, 0.0)], "g string, n int, ms double"), ["g"], "n", "ms").first()
    assert (rate.trials, rate.qps_mean, rate.qps_stddev, rate.best_ms) == (1, 2000.0, 0.0, 5.0)
    assert records.environment(spark).count() == 1
