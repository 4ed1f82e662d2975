import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import sqlfuncs
from quillon.operators import records
from quillon.plans import lineage, snapshot
from quillon.sources import textfiles, xvecs
from quillon.streaming import append

V = "id long, embedding array<float>"


def test_snapshot(spark, tmp_path):
    root = str(tmp_path / "s")
    df = spark.createDataFrame([(1, [1.0]), (2, None)], V)
    with pytest.raises(snapshot.SnapshotError):
        snapshot.load(spark, root, "k")
    assert snapshot.save({"t": df}, root, "k", 1, {"m": 4}) == 1
    tables, manifest = snapshot.load(spark, root, "k")
    assert sorted(map(tuple, tables["t"].collect())) == [(1, [1.0]), (2, None)] and manifest["params"] == {"m": 4}
    with pytest.raises(snapshot.SnapshotError, match="kind"):
        snapshot.load(spark, root, "other")
    assert snapshot.save({"t": df.filter("id = 1")}, root, "k", 1) == 2
    assert snapshot.load(spark, root, "k")[0]["t"].count() == 1 and snapshot.load(spark, root, "k", 1)[0]["t"].count() == 2
    df.limit(1).write.mode("append").parquet(f"{root}/v2/t")
    with pytest.raises(snapshot.SnapshotError, match="not as it was written"):
        snapshot.load(spark, root, "k")
    for text, why in (("{", "damaged"), (json.dumps({"format": "x"}), "format"), (json.dumps({"format": snapshot.FORMAT, "version": 99}), "version")):
        with open(f"{root}/v1/manifest.json", "w") as f:
            f.write(text)
        crc = f"{root}/v1/.manifest.json.crc"
        if os.path.exists(crc):
            os.remove(crc)
        with pytest.raises(snapshot.SnapshotError, match=why):
            snapshot.load(spark, root, "k", 1)


def test_append_stream(spark, tmp_path):
    root, box = str(tmp_path / "a"), str(tmp_path / "in")
    spark.createDataFrame([(1, [1.0]), (1, [0.5]), (2, [2.0])], V).coalesce(1).write.parquet(box)
    stream = lambda: spark.readStream.schema(V).parquet(box)
    append.run_available(stream(), root, str(tmp_path / "c"))
    spark.createDataFrame([(2, [9.0]), (3, [3.0]), (None, [1.0]), (4, None)], V).coalesce(1).write.mode("append").parquet(box)
    append.run_available(stream(), root, str(tmp_path / "c"))
    got = {r.id: r.embedding for r in append.current(spark, root).collect()}
    assert got == {1: [0.5], 2: [2.0], 3: [3.0]} and snapshot.versions(spark, root) == 2
    more = append.append_batch(root, compact=2)
    more(spark.createDataFrame([([7.0],), ([6.0],), (None,)], "embedding array<float>"), 5)  # ids are assigned
    assert {r.id: r.embedding for r in append.current(spark, root).collect()} == got | {4: [6.0], 5: [7.0]}
    assert len(snapshot.load(spark, root, "vectors")[1]["tables"]) == 1
    add = append.append_batch(root)
    add(spark.createDataFrame([(8, [8.0])], V), 1)  # a batch handed over again
    assert snapshot.versions(spark, root) == 3


def test_xvecs(spark, tmp_path):
    xvecs.register(spark)
    x = np.random.default_rng(0).normal(size=(50, 3)).astype("<f4")
    path = str(tmp_path / "a.fvecs")
    np.c_[np.full(50, 3, "<i4").view("<f4"), x].astype("<f4").tofile(path)
    assert xvecs.header(path) == (3, 50)
    got = spark.read.format("fvecs").option("records_per_partition", 7).load(path).orderBy("id").collect()
    assert [r.id for r in got] == list(range(50)) and np.array_equal(np.array([r.embedding for r in got], "<f4"), x)
    assert spark.read.format("fvecs").option("max_count", 9).option("records_per_partition", 4).load(path).agg(F.max("id")).first()[0] == 8
    out = str(tmp_path / "o")
    spark.createDataFrame([(0, [1, 2]), (1, [3, 4])], "query_id long, neighbors array<int>").coalesce(1).write.format("ivecs").mode("overwrite").save(out)
    assert [r.neighbors for r in spark.read.format("ivecs").load(out).orderBy("query_id").collect()] == [[1, 2], [3, 4]]
    for data in (b"abc", np.array([0, 1], "<i4").tobytes(), np.array([2, 1], "<i4").tobytes(), np.array([200_000], "<i4").tobytes()):
        bad = tmp_path / "bad.fvecs"
        bad.write_bytes(data)
        with pytest.raises(ValueError):
            xvecs.header(str(bad))


def test_text_files(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("a\tone\n\nb\nc\tthree\tmore\n")
    got = sorted(map(tuple, textfiles.read_corpus_tsv(spark, str(tmp_path / "c.tsv")).collect()))
    assert got == [("a", "one"), ("b", ""), ("c", "three")]
    (tmp_path / "q.tsv").write_text("q1\ta\twhat\nq2\tzz\twho\nshort\ta\n")
    keys = spark.createDataFrame([(1, "a"), (5, "a")], "id long, doc_key string")
    assert [tuple(r) for r in textfiles.read_queries_tsv(spark, str(tmp_path / "q.tsv"), keys).collect()] == [("q1", 5, "what")]
    q = spark.createDataFrame([("a",), ("zz",), (None,)], "gold_key string")
    known, lost = textfiles.split_orphans(q, keys)
    assert known.count() == 1 and lost.count() == 2
    textfiles.write_tsv(spark.createDataFrame([("k", "a \n b")], "k string, t string").coalesce(1), str(tmp_path / "o"), ["t"])
    assert spark.read.text(str(tmp_path / "o")).first()[0] == "k\ta b"
    rows = textfiles.numbered(spark.createDataFrame([(c,) for c in "dbca"], "x string"), "x")
    assert {(r.x, r.id) for r in rows.collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    (tmp_path / "r.jsonl").write_text('{"tag":"t","n_base":5}\n')
    assert textfiles.read_jsonl(spark, str(tmp_path / "r.jsonl"), "tag string, n_base long").first() == ("t", 5)


def test_records(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"tag":"t","n_base":5,"measurements":{"qps_mean":2.0}}\n{broken\n')
    with pytest.raises(Exception):
        records.read_records(spark, str(tmp_path / "r.jsonl")).collect()
    (tmp_path / "ok.jsonl").write_text('{"tag":"t","n_base":5,"index_params":{"M":16,"m":8,"kind":"x"},"measurements":{"qps_mean":2.0}}\n{"tag":"u"}\n')
    back = records.read_records(spark, str(tmp_path / "ok.jsonl"))
    records.append_records(back, str(tmp_path / "again"))
    for df in (back, records.read_records(spark, str(tmp_path / "again"))):
        assert {(r.tag, r.index_params and (r.index_params.graph_m, r.index_params.m)) for r in df.collect()} == {("t", (16, 8)), ("u", None)}
    env = spark.createDataFrame([("abc", False, "Release", "none"), ("unknown", False, "Release", "none"), ("abc", True, "Release", "none"), ("abc", False, "Debug", "none"), ("abc", False, "Release", "address"), ("abc", None, "Release", "none")], "sha string, dirty boolean, build string, san string")
    got = [r[0] for r in env.select(records.untrusted_reason(*map(F.col, env.columns))).collect()]
    assert got == [None, "git SHA could not be resolved", "working tree is dirty", "build type is Debug, not Release", "built with sanitizers (address)", "working tree is dirty"]
    env = records.environment(spark).first()
    assert env.peak_rss_mib > 0 and env.trusted == (env.untrusted_reason == "")
    with pytest.raises(ValueError):
        records.markdown(spark.range(5), ["id"], most=4)
    assert json.loads(records.summary_json(spark.createDataFrame([(1, None)], "a int, b string"))) == {"a": 1, "b": None}
    search = lambda q, k: q.limit(k)
    assert [r.queries for r in records.measure(search, spark.range(3), 2, trials=2).collect()] == [3, 3]
    assert records.sweep(spark.range(4), spark.range(2), [2, 4], lambda v: search, lambda v: search, 1, 1).count() == 2
    rows = spark.createDataFrame([(1, 1, 2.0), (1, 2, 4.0), (2, 1, 3.0)], "k int, pos int, v double")
    assert {tuple(r) for r in records.latest_per_key(rows, ["k"], "pos").collect()} == {(1, 2, 4.0), (2, 1, 3.0)}
    assert {tuple(r) for r in records.paired(rows, rows.filter("k = 1"), "k", "pos", "v").collect()} == {(1, 4.0, 4.0, 1.0)}
    cross = records.crossover(spark.createDataFrame([(10, 0.5), (1000, 1.5)], "n long, speedup double")).first()
    assert cross.n_low == 10 and cross.n_cross == pytest.approx(100.0)
    scale = records.scaling(spark.createDataFrame([("a", 1, 10.0), ("a", 2, 18.0)], "g string, threads int, qps double"), "g")
    assert {(r.threads, r.speedup, r.efficiency) for r in scale.collect()} == {(1, 1.0, 1.0), (2, 1.8, 0.9)}
    assert records.markdown(rows.filter("k = 2"), ["k", "v"]).splitlines() == ["| k | v |", "|---|---|", "| 2 | 3.0000 |"]


def test_sql_surface(spark):
    sqlfuncs.register(spark, spark.createDataFrame([(1, [0.0, 1.0]), (2, [3.0, 4.0]), (3, None)], V), k=1)
    assert spark.sql("select l2_sq(array(float(1)), array(float(4))), neg_ip(array(float(2)), array(float(3))), ascii_tokens('A-b'), rrf(60, 1)").first() == (9.0, -6.0, ["a", "b"], 1 / 61)
    got = spark.sql("select q.i, n.id from (select 1 i, array(float(3), float(3)) v) q, lateral knn_at(q.v) n").collect()
    assert [tuple(r) for r in got] == [(1, 2)]


def test_written_is_read_from_the_shared_folder(spark):
    df = lineage.written(spark.range(5), "t")
    assert df.count() == 5 and "Scan parquet" in df._jdf.queryExecution().toString().replace("FileScan", "Scan")
    assert lineage.shared_dir(spark)
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    lineage.clear(spark)
    assert not os.path.exists(path)


def test_cluster_without_a_folder_is_an_error():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {"x": 1}

    Session.conf = type("C", (), {"get": staticmethod(lambda k, d: d)})()
    with pytest.raises(RuntimeError):
        lineage.shared_dir(Session())


def test_entry_without_extras(spark):
    import __spark_entry__ as e

    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 40
    if os.path.isdir("/root/testdata/sf0.001"):
        assert e.entry(spark).columns == ["query_id", "id", "dist", "rank"]
