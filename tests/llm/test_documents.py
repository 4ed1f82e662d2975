from collections import Counter, defaultdict
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import merge_replay, mixture, repetition

DOCS = "doc_id long, text string, source string"
TEXTS = [
    None, "", " ", "\n\n \t x", "Hello world, hello!", "aaaaaaa" * 30, "z" * 20_000, "naïve café — Ünïcode", "日本語のテキスト、東京。", "Привет мир",
    "<|endoftext|> is text", "it's we'll I'd THEY'RE", "12,345.67 and 1/2½²", "tabs\tand\r\nlines  ", "🙂🙃 emoji‍", "ab" * 500, "'s't 've", " nbsp　wide",
]


def reference_encoder():
    tokenizers = pytest.importorskip("tokenizers")
    path = os.path.dirname(merge_replay.DEFAULT_RANKS) + "/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no vocabulary files")
    t = tokenizers.Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda texts: [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_ids_equal_the_public_library(spark):
    want = reference_encoder()(TEXTS)
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "s"), (None, "x", "s")], DOCS).withColumn("ids", F.lit("clash")).withColumn("tokens", F.lit(1))
    for sizes in ({}, {"block_chars": 50, "known_words": 3}):
        got = merge_replay.encode(df, **sizes).collect()
        assert len(got) == len(TEXTS) + 2
        for r in got:
            if r.doc_id is not None:
                assert r.ids == want[r.doc_id], TEXTS[r.doc_id]
    counts = {r.doc_id: r.tokens for r in merge_replay.with_token_counts(df.select("doc_id", "text")).collect()}
    assert all(counts[i] == len(w) for i, w in enumerate(want))
    assert merge_replay.encode(spark.createDataFrame([], DOCS)).count() == 0


def test_replay_of_random_words():
    encode = reference_encoder()
    rng = random.Random(0)
    texts = ["".join(rng.choices("ab cdeθあ's1\n", k=rng.randint(0, 60))) for _ in range(400)]
    assert [x.tolist() for x in merge_replay.encode_block(texts, merge_replay.DEFAULT_RANKS, {})] == encode(texts)


def brute_share(text):
    words = [w.lower() for w in repetition.WORD.findall(text or "")]
    seen, mark = set(), [False] * len(words)
    for i in range(len(words) - 4):
        g = tuple(words[i : i + 5])
        if g in seen:
            for j in range(i, i + 5):
                mark[j] = True
        seen.add(g)
    return sum(mark) / len(words) if words else 0.0


def test_repetition_against_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", "  ", "a a a a a a", "one two three four five", "x_y z-1"] + [" ".join(rng.choices("abcdefg", k=rng.randint(1, 40))) for _ in range(150)]
    texts += [("the same sentence again and again. " * 9), "word " * 5000, "Größe STRASSE straße " * 20, "q" * 30_000]
    df = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)] + [(7, texts[7], "s")], DOCS).withColumn("share", F.lit(5)).withColumn("score", F.lit("clash"))
    got = repetition.repetition(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert r.share == pytest.approx(brute_share(texts[r.doc_id]), abs=1e-12)
        assert r.anomalous or r.share < 0.3
    assert repetition.repetition(spark.createDataFrame([], DOCS)).count() == 0
    plain = repetition.repetition(spark.createDataFrame([(1, "nothing repeats here", "s")], DOCS)).first()
    assert plain.share == 0 and plain.words == 3


def test_many_distinct_words_are_numbered_exactly():
    words = [f"w{i}" for i in range(6000)]
    assert not repetition.repeated_words(words).any()
    mark = repetition.repeated_words(words + words[100:105] + ["new"])
    assert np.flatnonzero(mark).tolist() == list(range(6000, 6005))


def test_forest_isolates_the_odd_one():
    x = np.random.default_rng(0).normal(size=(400, 3))
    forest = repetition.IsolationForest(np.vstack([x, [[9, 9, 9]]]))
    s = forest.score(np.vstack([x, [[9, 9, 9]]]))
    assert s[-1] > np.quantile(s[:-1], 0.99)


PLAN = "source string, weight double, max_repeats int"


def mixed(spark, weights, repeats, rows=3000, **kw):
    rng = random.Random(5)
    names = list(weights)
    data = [(i, "tok " * rng.randint(1, 30), rng.choice([names[0]] * 6 + names[1:3] + [" " + names[0].upper() + " ", "elsewhere", None])) for i in range(rows)]
    data += [(rows + 1, None, names[0]), (rows + 2, "", names[1])]
    df = spark.createDataFrame(data + data[:1], DOCS).withColumn("tokens", F.lit(9)).withColumn("block", F.lit(9)).withColumn("weight", F.lit(9))
    plan = spark.createDataFrame([(n, w, r) for (n, w), r in zip(weights.items(), repeats)], PLAN).withColumn("shard", F.lit(1))
    return df, plan, mixture.mix(df, plan, shards=4, block_docs=8, **kw)


def test_mixture(spark):
    df, plan, (selection, report) = mixed(spark, {"a": 0.5, "b": 0.3, "c": 0.1, "missing": 0.1}, [1, 2, 3, 2])
    rows = {r.source: r for r in report.collect()}
    sizes = mixture.measured(df).collect()
    total, per = sum(r.tokens for r in sizes), Counter()
    for r in sizes:
        per[r.source] += r.tokens
    for s, (w, most) in {"a": (0.5, 1), "b": (0.3, 2), "c": (0.1, 3), "missing": (0.1, 2)}.items():
        r = rows[s]
        assert r.tokens == per[s] and r.short == (most * per[s] < w * total)
        assert abs(r.reached - min(w * total, most * per[s])) <= 31
    used = selection.collect()
    tokens = {r.doc_id: r.tokens for r in sizes}
    assert sum(tokens[u.doc_id] for u in used) == sum(r.reached for r in rows.values()) and sum(r.documents for r in rows.values()) == len(used)
    times = defaultdict(set)
    for u in used:
        if u.doc_id:  # document 0 is stored twice
            assert u.repeat not in times[u.doc_id]
            times[u.doc_id].add(u.repeat)
    limit = {"a": 1, "b": 2, "c": 3}
    assert all(u.repeat < limit[u.source] for u in used)
    for k in range(4):
        places = [u.place for u in used if u.shard == k]
        assert sorted(places) == list(range(1, len(places) + 1)) and len(places) > 0.15 * len(used)
    assert sum(r.actual for r in rows.values()) == pytest.approx(1.0)


def test_quota_tree_is_exact():
    blocks = np.array([1000, 7, 0, 313])
    q = mixture.split_quotas(blocks, 7, 3)
    assert (q.sum(0) == blocks).all() and (q >= 0).all() and q.sum(1).max() - q.sum(1).min() <= 7
    assert (mixture.split_quotas(blocks, 7, 3) == q).all()


def test_empty_mixture(spark):
    none = spark.createDataFrame([], DOCS)
    plan = spark.createDataFrame([("a", 1.0, 1), (None, 0.5, 2), ("b", None, None)], PLAN)
    selection, report = mixture.mix(none, plan)
    assert selection.count() == 0 and {r.source: r.reached for r in report.collect()} == {"a": 0, "b": 0}
    assert mixture.mix(none, spark.createDataFrame([], PLAN))[1].count() == 0


def test_rare_repetition_outside_the_sample_is_flagged(spark):
    plain = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    texts = [f"{plain(i, 10)} {plain(i, 10)} {plain(i + 10000, 17 + i % 20)}" for i in range(3250)]  # shares of 0.17 to 0.27
    texts += ["word " * (300 + 40 * i) for i in range(50)]  # far from all others
    texts += [f"{plain(i, 10)} {plain(i, 10)} {plain(i + 10000, 10)}" for i in range(5000, 5012)]  # a third, and in no way odd else
    df = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    got = repetition.repetition(df, training_rows=100).collect()
    low = [r for r in got if r.doc_id > 3300]
    assert all(0.3 <= r.share < 0.34 for r in low) and all(r.anomalous for r in got if r.share >= 0.3)
    assert sum(r.anomalous for r in got) < len(got)


def test_short_sources_and_layout(spark):
    df, plan, (selection, report) = mixed(spark, {"a": 0.5, "b": 0.3, "c": 0.1, "missing": 0.1}, [1, 2, 3, 2])
    short = {r.source for r in report.filter("short").collect()}
    assert "missing" in short and {r.source for r in mixture.short_sources(df, plan, shards=4, block_docs=8).collect()} == short
    again = mixture.mix(df.repartition(7).unionByName(df.limit(0)), plan, shards=4, block_docs=8)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, selection.collect()))
