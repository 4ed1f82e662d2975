from math import log

import pytest
from pyspark.sql import functions as F

from quillon.functions.text import clean, tokenize
from quillon.operators import evaluate, fusion, lexical
from quillon.operators.retriever import HybridRetriever

DOCS = [(0, "the cat sat on the mat"), (1, "the cat"), (2, "dogs and birds sing"), (3, None), (4, "")]


@pytest.fixture(scope="module")
def index(spark):
    return lexical.text_index(spark.createDataFrame(DOCS + [DOCS[1], (None, "lost")], "doc_id long, text string").withColumn("tf", F.lit("clash")))


def ask(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_tokens(spark):
    df = spark.createDataFrame([("error-code X_4417!",), ("KéA",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(tokenize(F.col("t"))).collect()] == [["error", "code", "x", "4417"], ["a"], [], []]
    assert spark.createDataFrame([(" a \t\n b ",)], "t string").select(clean(F.col("t"))).first()[0] == "a b"


def test_bm25_by_formula(spark, index):
    n, avgdl = index.stats.first()
    assert n == 5 and avgdl == pytest.approx(12 / 5)
    got = lexical.bm25_topk(index, ask(spark, "cat"), 10).orderBy("rank").collect()
    idf = log(1 + (5 - 2 + 0.5) / 2.5)
    score = lambda length: idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * length / avgdl))
    assert [r.id for r in got] == [1, 0]
    assert [r.score for r in got] == [pytest.approx(score(2), abs=1e-9), pytest.approx(score(6), abs=1e-9)]


def test_bm25_laws(spark, index):
    assert lexical.bm25_topk(index, ask(spark, "", "unknownterm"), 5).count() == 0
    one = lexical.bm25_scores(index, ask(spark, "cat")).orderBy("id").collect()
    two = lexical.bm25_scores(index, ask(spark, "cat cat")).orderBy("id").collect()
    assert [r.score * 2 for r in one] == [pytest.approx(r.score) for r in two]
    flat = lexical.bm25_scores(index, ask(spark, "cat"), b=0.0).collect()
    assert len({round(r.score, 9) for r in flat}) == 1
    assert lexical.bm25_idf(index).filter("idf <= 0").count() == 0
    empty = lexical.text_index(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.stats.first() == (0, 0.0) and lexical.bm25_topk(empty, ask(spark, "cat"), 5).count() == 0
    assert lexical.index_bytes(index).first().doc_count == 5


def most_joined(plan):
    """The largest number of rows that a join of an executed plan gave."""
    name = plan.nodeName()
    inner = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if name.endswith("QueryStage") else [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().apply("numOutputRows").value() if "Join" in name else 0
    return max([own, *map(most_joined, inner)])


def test_bm25_of_pairs_joins_no_others(spark, tmp_path):
    from quillon.plans import catalogue

    n = 150
    spark.createDataFrame([(i, f"k{i}", f"the cat number {i % 7} " + "mat " * (i % 3)) for i in range(n)] + [(n, None, "the lost"), (n + 1, "k3", None)], "doc_id long, doc_key string, text string").write.parquet(f"{tmp_path}/corpus.parquet")
    spark.createDataFrame([(i, f"k{i}", f"the cat the {i % 7}") for i in range(n)] + [(n, "nowhere", "cat"), (n + 1, "k1", None), (n + 2, "k1", "dog")], "query_no long, gold_key string, question string").write.parquet(f"{tmp_path}/text_queries.parquet")
    df = catalogue.bm25_score_pairs(spark, str(tmp_path))
    got = {(r.query_id, r.id): r.score for r in df.collect()}
    assert most_joined(df._jdf.queryExecution().executedPlan()) <= 4 * n
    every = lexical.bm25_scores(lexical.text_index(catalogue._documents(spark, str(tmp_path))), catalogue._questions(spark, str(tmp_path))).filter("query_id = id").collect()
    assert got == {(r.query_id, r.id): pytest.approx(r.score, abs=1e-6) for r in every} and len(got) == n


def test_tfidf(spark, index):
    got = lexical.tfidf_topk(index, ask(spark, "cat nowhere"), 5).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 0] and 0 < got[0].score <= 1
    same = lexical.tfidf_topk(index, ask(spark, "dogs and birds sing"), 5).first()
    assert same.id == 2 and same.score == pytest.approx(1.0)


def test_best_in_shard_is_exact():
    import numpy as np

    rng = np.random.default_rng(5)
    for docs, terms, k in ((3_000, 40, 10), (3_000, 40, 120), (7, 5, 3)):
        has = rng.random((terms, docs)) < rng.choice([0.004, 0.2, 0.9], (terms, 1))
        has[0] = True
        code, doc = np.nonzero(has)
        ids = np.sort(rng.choice(10**6, docs, replace=False))
        weight = np.round(rng.gamma(2, 1, len(code)), 1) + 0.1  # many ties
        n = rng.integers(1, min(terms, 8) + 1, 60)
        starts = np.r_[0, np.cumsum(n)]
        qcode, qtimes = np.concatenate([rng.choice(terms, x, replace=False) for x in n]), rng.choice([1, 1, 1, 2, 5], starts[-1])
        qtimes[:3] = 50_000  # doesn't fit 16 bits
        scale = rng.choice([1.0, 0.37], 60)
        q, i, s = lexical.best_in_shard(code, doc, weight, ids, terms, qcode, qtimes, starts, scale, k, rows=8, batch=500)
        for a in range(60):
            total = np.zeros(docs)
            for c, t in zip(qcode[starts[a] : starts[a + 1]], qtimes[starts[a] : starts[a + 1]]):
                total[doc[code == c]] += t * weight[code == c]
            score = np.round(total * scale[a], 9)
            best = np.lexsort((ids, -score.astype(np.float32)))
            best = best[total[best] > 0][:k]
            assert i[q == a].tolist() == ids[best].tolist() and s[q == a].tolist() == score[best].tolist()


def test_equal_questions_are_searched_once(spark, index):
    asked = ask(spark, "the cat", "cat birds", "cat the", "cat the!")
    got, same = lexical.topk_in_blocks(index, asked, 3, [("bm25", 1.2, 0.75), ("tfidf",)])
    assert {r.query_id for r in got.collect()} == {0, 1} and {tuple(r) for r in same.collect()} == {(0, 0), (1, 1), (2, 0), (3, 0)}
    for both, one in zip(lexical.bm25_and_tfidf(index, asked, 3), (lexical.bm25_topk(index, asked, 3), lexical.tfidf_topk(index, asked, 3))):
        rows = {tuple(r) for r in both.collect()}
        assert rows == {tuple(r) for r in one.collect()} and len({r[0] for r in rows}) == 4


def lists(spark, *ids):
    return [spark.createDataFrame([(0, i, k + 1) for k, i in enumerate(x)], "query_id long, id long, rank int") for x in ids]


def test_fusion(spark):
    got = fusion.reciprocal_rank_fusion(lists(spark, [7, 3, 5], [3, 7, 9]), 4).orderBy("rank").collect()
    assert [r.id for r in got] == [3, 7, 5, 9] and got[0].score == pytest.approx(1 / 61 + 1 / 62, abs=1e-9)
    assert [r.id for r in fusion.reciprocal_rank_fusion(lists(spark, [5, 6, 7])).orderBy("rank").collect()] == [5, 6, 7]


def test_evaluator(spark):
    found = spark.createDataFrame([(0, 10, 1), (1, 11, 6), (2, 5, 1)], "query_id long, id long, rank int")
    gold = spark.createDataFrame([(0, 10), (1, 11), (2, 12), (3, 13)], "query_id long, gold_id long")
    ranks = evaluate.gold_ranks(found, gold)
    hit = evaluate.hits_at(ranks).first()
    assert (hit.queries, hit.hit_at_1, hit.hit_at_5, hit.hit_at_10) == (4, 0.25, 0.25, 0.5)
    other = evaluate.gold_ranks(spark.createDataFrame([(2, 12, 2)], "query_id long, id long, rank int"), gold)
    assert evaluate.contingency(ranks, other).first().asDict() == {"both": 0, "only_a": 1, "only_b": 1, "neither": 2, "oracle": 0.5}
    assert evaluate.overlap(found, found, gold, 10).first().overlap == pytest.approx(3 / 40)


def test_hybrid(spark):
    docs = spark.createDataFrame([(i, f"k{i}", t) for i, t in DOCS], "doc_id long, doc_key string, text string")
    v = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "id long, embedding array<float>")
    q = spark.createDataFrame([(0, "cat", [4.0, 0.0])], "query_id long, text string, embedding array<float>")
    gated = HybridRetriever(docs, v)
    assert [r.doc_key for r in gated.search(q, 2).orderBy("rank").collect()] == ["k1", "k0"]
    for use_graph in (False, True):
        both = HybridRetriever(docs, v, use_dense=True, use_graph=use_graph)
        assert {r.doc_key for r in both.search(q, 4).collect()} == {"k1", "k0", "k4", "k3"}
        assert [r.id for r in both.search_image_only(q, 2).orderBy("rank").collect()] == [4, 3]
    assert gated.stats().first().doc_count == 5
    with pytest.raises(ValueError):
        HybridRetriever(docs).search_image_only(q)
