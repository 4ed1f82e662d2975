"""Repetition inside single documents: rule statistics judged by an isolation forest.

The rules measure what part of a text repeats words, phrases, sentences, lines and paragraphs of itself. An
isolation forest over these statistics gives each document a score from its path lengths through random
splits; the score above which a document is anomalous is calibrated on all rows, labelled by the share.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import written

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[.!?。！？]+\s*")
FEATURES = ("share", "longest", "top_phrase", "lines", "sentences", "paragraphs", "poverty", "length")


def repeated_words(words: list[str], span: int = 5) -> np.ndarray:
    """For each word whether it is within ``span`` consecutive words that stood, as the same, at an earlier place."""
    n = len(words)
    if n <= span:
        return np.zeros(n, bool)
    known: dict[str, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    gram, width = ids, 1
    while width < span:  # exact numbering of longer and longer runs: a run is (shorter run, next word)
        gram = gram[:-1] * len(known) + ids[width:]
        width += 1
        if width < span and gram.max() > (1 << 62) // len(known):
            gram = np.unique(gram, return_inverse=True)[1]
    _, first, at = np.unique(gram, return_index=True, return_inverse=True)
    again = np.flatnonzero(first[at] < np.arange(len(gram)))
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + span, -1)
    return np.cumsum(edge[:-1]) > 0


def _again(parts: list[str]) -> float:
    """Share of the characters that are in parts equal to an earlier part."""
    held = [p for p in (x.strip() for x in parts) if p]
    total = sum(map(len, held))
    return sum(len(p) * (c - 1) for p, c in Counter(held).items()) / total if total else 0.0


def statistics(text: str | None, span: int = 5) -> tuple[float, ...]:
    """The values of FEATURES for one whole text; all 0 without words."""
    words = [w.lower() for w in WORD.findall(text)] if text else []
    n = len(words)
    if not n:
        return (0.0,) * len(FEATURES)
    mark = repeated_words(words, span)
    edges = np.flatnonzero(np.diff(np.r_[False, mark, False]))
    longest = int((edges[1::2] - edges[::2]).max()) if len(edges) else 0
    if n >= 2:
        top = Counter(zip(words, words[1:])).most_common(1)[0][1] / (n - 1)
    else:
        top = 0.0
    return (float(mark.sum()) / n, longest / n, top, _again(text.split("\n")), _again(SENTENCE.split(text)), _again(re.split(r"\n\s*\n", text)), 1 - len(set(words)) / n, log(1 + n))


def _c(n: np.ndarray | float):
    """Mean path length of an unsuccessful search in a tree of n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees of random splits, kept as flat arrays."""

    def __init__(self, x: np.ndarray, trees: int = 64, rows: int = 256, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.trees, self.size = [], min(rows, len(x))
        for _ in range(trees):
            feature, cut, left, right, depth = [], [], [], [], []

            def grow(r: np.ndarray, d: int) -> int:
                at = len(feature)
                for a, v in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (depth, d + float(_c(len(r))))):
                    a.append(v)
                lo, hi = (x[r].min(0), x[r].max(0)) if len(r) > 1 else (np.zeros(1), np.zeros(1))
                open_ = np.flatnonzero(hi > lo)
                if len(open_) and d < 12:
                    f = int(rng.choice(open_))
                    c = rng.uniform(lo[f], hi[f])
                    below = x[r, f] <= c
                    feature[at], cut[at] = f, c
                    left[at], right[at] = grow(r[below], d + 1), grow(r[~below], d + 1)
                return at

            grow(rng.choice(len(x), self.size, replace=False), 0)
            self.trees.append(tuple(map(np.array, (feature, cut, left, right, depth))))

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, depth in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                below = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
                at = np.where(inner, np.where(below, left[at], right[at]), at)
            total += depth[at]
        return 2 ** (-total / len(self.trees) / max(float(_c(self.size)), 1e-9)) if self.size > 1 else np.full(len(x), 0.5)


def repetition(documents: DataFrame, least_share: float = 0.3, span: int = 5, training_rows: int = 20_000, margin: float = 0.1, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, words, share, score, anomalous) of every row.

    ``share`` is the repeated words by all words (0 without words: null, empty and blank texts). The forest is
    fitted on about ``training_rows`` rows chosen by hash, of any number of rows; ``anomalous`` is a score of
    at least the least one among all rows with a share of ``least_share`` or more, less ``margin`` of all
    scores' range. Without such rows no score is too low. Repeated rows stay, a null id stays null.
    """
    spark = documents.sparkSession
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = np.array([statistics(t, span) for t in b.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(stats.tolist(), pa.list_(pa.float64()))], ["doc_id", "f"])

    n = documents.count()
    share = min(1.0, training_rows / max(n, 1))
    chosen = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = chosen.mapInArrow(measured, f"doc_id {kind}, f array<double>").select("f").toArrow()
    x = np.array(sample.column(0).to_pylist(), float).reshape(-1, len(FEATURES))
    forest = IsolationForest(x) if len(x) else None
    held = spark.sparkContext.broadcast(forest)  # 64 trees of at most 511 nodes

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                stats = np.array([statistics(t, span) for t in b.column(1).to_pylist()]).reshape(-1, len(FEATURES))
                s = held.value.score(stats) if held.value is not None else np.full(len(stats), 0.5)
                words = np.round(np.expm1(stats[:, -1])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(stats[:, 0]), pa.array(np.round(s, 12))], ["doc_id", "words", "share", "score"])

    scored = written(rows.mapInArrow(judged, f"doc_id {kind}, words long, share double, score double"), "repetition-scores")
    low, high, labelled = scored.agg(F.min("score"), F.max("score"), F.min(F.when(F.col("share") >= least_share, F.col("score")))).first()
    least = float("-inf") if labelled is None else labelled - margin * (high - low)
    return scored.withColumn("anomalous", F.col("score") >= F.lit(least))
