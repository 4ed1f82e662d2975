import numpy as np
import pytest

from quillon.llm import rank_walk

RANKED = "list_id int, query_no long, rank int, id long, dist double"
QUERIES = "query_no long, alpha double"
LISTS = "list_id int, name string, is_image boolean"


def tables(spark, rows, queries=((0, 1.0), (1, 0.0), (2, None))):
    lists = spark.createDataFrame([(1, "a", False), (2, "b", False), (3, "i", True)], LISTS)
    return spark.createDataFrame(rows, RANKED), spark.createDataFrame(list(queries), QUERIES), lists


def dense(lists, n_items, damping=0.85):
    """Stationary order by a full transition matrix."""
    items = sorted({i for x in lists for i in x})
    at = {i: k for k, i in enumerate(items)}
    p = np.full((len(items), len(items)), (1 - damping) / len(items))
    for order in lists:
        for i in items:
            to = order[: order.index(i) + 1] if i in order else order
            for j in to:
                p[at[i], at[j]] += damping / len(lists) / len(to)
    x = np.full(len(items), 1 / len(items))
    for _ in range(500):
        x = x @ p
    return {i: x[at[i]] for i in items}


def rows_of(q, lists, scale=1.0):
    return [(k + 1, q, None, i, r * scale * 10**k) for k, order in enumerate(lists) for r, i in enumerate(order)]


@pytest.mark.parametrize("seed", range(3))
def test_both_paths_equal_the_matrix(spark, seed):
    rng = np.random.default_rng(seed)
    lists = [list(map(int, rng.choice(30, 20, replace=False))) for _ in range(2)]
    args = tables(spark, rows_of(0, lists) + rows_of(1, [[5, 6], [6, 5]]))
    want = dense(lists, 30)
    for hot in (10**6, 10):
        got = {r.id: r for r in rank_walk.rank_walk(*args, hot_rows=hot).filter("query_no = 0").collect()}
        assert set(got) == set(want)
        assert all(abs(got[i].stationarity - want[i]) < 1e-5 for i in want)
        assert [i for i in sorted(got, key=lambda i: got[i].position)] == sorted(got, key=lambda i: (-got[i].stationarity, i))
        assert sorted(r.position for r in got.values()) == list(range(1, len(want) + 1))


def test_range_does_not_matter(spark):
    lists = [[1, 2, 3, 4, 5, 6, 7], [2, 1, 3, 5, 4, 8, 9]]
    order = lambda scale: [r.id for r in rank_walk.rank_walk(*tables(spark, rows_of(0, lists, scale))).orderBy("position").collect()]
    assert order(1.0) == order(1e9) and set(order(1.0)[:2]) == {1, 2}


def test_gate_dirt_and_ties(spark):
    nan = float("nan")
    rows = [(1, q, None, i, 1.0) for q in (0, 1, 2) for i in range(8, 0, -1)]  # all tied: ids 1..5 lead
    rows += [(2, q, None, i, d) for q in (0, 1, 2) for i, d in ((1, 0.0), (1, 9.0), (2, 9.0), (9, nan), (3, None), (4, float("inf")))]
    rows += [(3, q, None, i, -1.0) for q in (0, 1, 2) for i in (2, 7)] + [(2, 5, None, 1, 0.0), (None, 0, None, 1, 0.0), (1, None, None, 1, 0.0), (1, 0, None, None, 0.0)]
    args = tables(spark, rows + rows[:5])
    found = {tuple(r) for r in rank_walk.agreed_heads(rank_walk.rank_walk(*args)).collect()}
    assert found == {(0, 2)} | {(q, i) for q in (1, 2) for i in (1, 2, 4)}  # image list counts only for query 0
    nothing = tables(spark, [])
    assert rank_walk.rank_walk(*nothing).count() == 0


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    r, q, lists = tables(spark, rows_of(0, [[1, 2], [2, 1]]))
    r = r.withColumn("position", F.lit("x")).withColumn("n_lists", F.lit(1)).withColumn("alpha", F.lit(2))
    assert rank_walk.rank_walk(r, q.withColumn("id", F.lit(1)), lists.withColumn("query_no", F.lit(0))).count() == 2


def test_one_long_list_keeps_its_order():
    n = 1_000_000
    q = np.zeros(n, np.int64)
    _, ids, position, *_ = rank_walk.walk(q, q, np.arange(n)[::-1].copy(), 0.85, 1e-9, 200)
    assert (position == n - ids).all()  # neighbours far down differ by 1e-13, a ten-millionth of the mean


def test_hot_queries_end_like_others(spark):
    rng = np.random.default_rng(7)
    args = tables(spark, rows_of(0, [list(map(int, rng.permutation(40))) for _ in range(3)]))
    cool, hot = ({r.id: (r.position, r.stationarity) for r in rank_walk.rank_walk(*args, damping=0.5, max_iter=2, hot_rows=h).collect()} for h in (10**6, 10))
    assert {i: p for i, (p, _) in cool.items()} == {i: p for i, (p, _) in hot.items()}
    assert all(abs(hot[i][1] - cool[i][1]) < 1e-11 for i in cool)


def test_heads_reach_their_bound(spark):
    """The least stationarity of an agreed head holds on both ways, and keeps most other items out."""
    rng = np.random.default_rng(11)
    lists = [[1, 2, 3, *(int(i) for i in rng.permutation(np.arange(10, 60)))], [3, 9, 1, 2, *(int(i) for i in rng.permutation(np.arange(10, 60)))]]
    args = tables(spark, rows_of(0, lists) + rows_of(1, [[4, 5], [5, 4]]))
    for hot in (10**6, 50):
        walked = rank_walk.rank_walk(*args, hot_rows=hot)
        rows = walked.collect()
        heads = {(r.query_no, r.id) for r in rows if r.lists_in == r.n_lists >= 2 and r.worst_rank <= 5}
        reached = {(r.query_no, r.id) for r in rows if r.stationarity >= r.head_bound}
        assert heads == {(0, 1), (0, 2), (0, 3), (1, 4), (1, 5)} <= reached and len(reached) < 0.3 * len(rows)
        assert {tuple(r) for r in rank_walk.agreed_heads(walked).collect()} == heads


def test_a_query_stops_by_itself():
    one = [(0, k, i) for k in (1, 2) for i in ([1, 2, 3, 4] if k == 1 else [3, 1, 5])]
    slow = [(1, k, i) for k in (1, 2, 3) for i in np.random.default_rng(k).permutation(300).tolist()]
    cols = lambda rows: (np.array(c) for c in zip(*rows))
    alone = rank_walk.walk(*cols(one), 0.85, 1e-4, 200)
    beside = rank_walk.walk(*cols(one + slow), 0.85, 1e-4, 200)
    assert all((a == b[: len(a)]).all() for a, b in zip(alone, beside))
