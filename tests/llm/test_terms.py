from collections import Counter
from math import log
import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.llm import page_terms, ppmi, radix_counts

CORPUS, POSTINGS = "doc_id long, text string", "term string, doc_id long, tf int"


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    pages = [(d, " ".join(rng.choices(words, weights=[60] * 2 + [1] * 38, k=rng.randint(0, 60)))) for d in range(60)]
    pages += [(100, None), (101, ""), (102, "  \n"), (103, "x" * 50_000 + " " + "Hot hot HOT " * 2000), (None, "lost w1")]
    truth = {(t, d): n for d, x in pages if d is not None and x for t, n in Counter(t.lower() for t in re.findall("[A-Za-z0-9]+", x)).items()}
    rows = []
    for (t, d), n in truth.items():
        kind = rng.random()
        if kind < 0.05:
            continue  # only the text has it
        rows.append((t.upper() if kind < 0.1 else t + " " if kind < 0.15 else t, d, None if kind > 0.95 else 0 if kind > 0.9 else n))
        if kind > 0.8:
            rows.append((t, d, n if kind < 0.9 else 0))
    rows += [("stored", 7, 3), ("stored", 900, 2), ("none", 5, None), (None, 1, 1), ("", 1, 1), ("w1", None, 1)]
    truth |= {("stored", 7): 3, ("stored", 900): 2}
    df = spark.createDataFrame(pages + pages[:9], CORPUS)
    return spark.createDataFrame(rows, POSTINGS).withColumn("n", F.lit("clash")).withColumn("radix", F.lit("clash")), df.withColumn("term", F.lit("clash")).withColumn("tf", F.lit(9)), truth


def test_page_terms(data):
    assert {(r.term, r.doc_id): r.tf for r in page_terms.page_terms(*data[:2]).collect()} == data[2]


def test_ppmi_by_formula(data):
    truth = data[2]
    pages, total, length = Counter(), Counter(), Counter()
    for (t, d), n in truth.items():
        pages[t] += 1
        total[t] += n
        length[d] += n
    whole, smooth = sum(length.values()), sum(v**0.75 for v in length.values())
    got = ppmi.ppmi(*data[:2])
    rows = got.collect()
    assert len(rows) == len(truth)
    for r in rows:
        want = max(0.0, log(r.tf / whole / (total[r.term] / whole * length[r.doc_id] ** 0.75 / smooth)))
        assert (r.pages, r.total) == (pages[r.term], total[r.term]) and r.ppmi == pytest.approx(want, abs=1e-9)
    found = {(r.term, r.doc_id) for r in ppmi.marking_terms(*data[:2]).collect()}
    assert found == {(t, d) for (t, d), n in truth.items() if n >= 4 and 2 <= pages[t] <= 12}


@pytest.mark.parametrize("most_rows,width", [(10**6, 3), (60, 2), (7, 1)])
def test_frequencies(data, most_rows, width):
    truth = data[2]
    pages, total = Counter(), Counter()
    for (t, _), n in truth.items():
        pages[t] += 1
        total[t] += n
    n = len({d for _, d in truth})
    mark = lambda t: "rare" if pages[t] < 3 or total[t] < 5 else "common" if pages[t] > 0.3 * n else None
    got = {r.term: (r.occurrences, r.pages, r.mark) for r in radix_counts.term_frequencies(*data[:2], most_rows=most_rows, width=width).collect()}
    assert got == {t: (total[t], pages[t], mark(t)) for t in pages}


def test_hot_term_is_split(spark):
    rows = spark.createDataFrame([("hot", d, 1, 0) for d in range(500)], "term string, doc_id long, stored long, counted long")
    leaves, held = radix_counts.spill(rows, 50, 3)
    assert len(leaves) > 5 and held.count() == 500
    got = radix_counts.aggregate(spark, leaves, "200MB").groupBy("term").agg(F.sum("pages"), F.sum("occurrences")).collect()
    assert [tuple(r) for r in got] == [("hot", 500, 500)]


def test_empty(spark):
    none = spark.createDataFrame([], POSTINGS), spark.createDataFrame([], CORPUS)
    assert ppmi.ppmi(*none).count() == 0 and radix_counts.term_frequencies(*none).count() == 0

