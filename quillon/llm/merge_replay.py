"""Encoding texts with a public byte-level BPE vocabulary by replaying its merges over a whole block of text.

The distinct words of a block are laid out as one chain of tokens. An inverted index maps each pair of
neighbouring tokens to its positions; merges are applied in rank order, each to all its positions at once,
and only the touched neighbours enter the index again. A merge belongs to one word, so blocks of the
corpus can be replayed apart with the same result: the index is partitioned with the documents and no text
is shuffled.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_RANKS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: Fixed value: the word pattern published with this vocabulary.
WORD_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_held: dict[str, tuple] = {}


def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pair_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """Packed pair of token ids -> id of their union, for every way to cut a token into two tokens."""
    out = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                out[a << 32 | b] = rank
    return out


def loaded(path: str) -> tuple[np.ndarray, dict[int, int], object]:
    """Ids of single bytes, pair table and compiled pattern; read once in each worker."""
    if path not in _held:
        import regex

        ranks = vocabulary(path)
        _held[path] = (np.array([ranks[bytes([b])] for b in range(256)], np.int64), pair_table(ranks), regex.compile(WORD_PATTERN))
    return _held[path]


def replay(words: list[bytes], single: np.ndarray, pairs: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words in a row and the offset of each word's first (one more offset at the end)."""
    size = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(size)
    n = int(ends[-1]) if len(words) else 0
    if not n:
        return np.empty(0, np.int32), np.zeros(len(words) + 1, np.int64)
    token = single[np.frombuffer(b"".join(words), np.uint8)]
    word_end = np.zeros(n, bool)
    word_end[ends[size > 0] - 1] = True
    nxt = np.arange(1, n + 1)
    nxt[word_end] = -1
    prv = np.arange(-1, n - 1)
    prv[1:][word_end[:-1]] = -1
    alive = np.ones(n, bool)
    index: dict[int, list[np.ndarray]] = {}
    queue: list[tuple[int, int]] = []

    def enter(at: np.ndarray) -> None:
        keys = token[at] << 32 | token[nxt[at]]
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], at[order]
        cuts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        for key, part in zip(keys[cuts].tolist(), np.split(at, cuts[1:])):
            rank = pairs.get(key)
            if rank is not None:
                if key in index:
                    index[key].append(part)
                else:
                    index[key] = [part]
                    heapq.heappush(queue, (rank, key))

    enter(np.flatnonzero(nxt >= 0))
    while queue:
        rank, key = heapq.heappop(queue)
        parts = index.pop(key)
        at = np.concatenate(parts) if len(parts) > 1 else parts[0]
        a, b = key >> 32, key & 0xFFFFFFFF
        at = at[alive[at] & (token[at] == a)]
        at = at[nxt[at] >= 0]
        at = at[token[nxt[at]] == b]
        if not len(at):
            continue
        if len(parts) > 1 or a == b:
            at = np.unique(at)
        if a == b:  # of overlapping places in a run the first, third, ... merge
            joined = np.r_[False, nxt[at[:-1]] == at[1:]]
            first = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
        gone = nxt[at]
        after = nxt[gone]
        token[at] = rank
        alive[gone] = False
        nxt[at] = after
        has = after >= 0
        prv[after[has]] = at[has]
        before = prv[at]
        near = np.concatenate([before[before >= 0], at[has]])
        if len(near):
            enter(np.unique(near))
    ids = token[alive].astype(np.int32)
    kept = np.cumsum(alive)
    return ids, np.r_[0, np.where(ends > 0, kept[np.maximum(ends - 1, 0)], 0)]


def encode_block(texts: list[str | None], path: str, known: dict[str, np.ndarray]) -> list[np.ndarray]:
    """Ids of each text. ``known`` keeps the words of earlier blocks of the same task."""
    single, pairs, pattern = loaded(path)
    split = [pattern.findall(t) if t else [] for t in texts]
    fresh = list({w for words in split for w in words} - known.keys())
    ids, offsets = replay([w.encode("utf-8", "surrogatepass") for w in fresh], single, pairs)
    bounds = offsets.tolist()
    for i, w in enumerate(fresh):
        known[w] = ids[bounds[i] : bounds[i + 1]]
    empty = np.empty(0, np.int32)
    return [np.concatenate([known[w] for w in words]) if words else empty for words in split]


def _blocks(batches: Iterator[pa.RecordBatch], most_chars: int) -> Iterator[pa.Table]:
    held, chars = [], 0
    for b in batches:
        for s in range(0, b.num_rows, 256):
            part = b.slice(s, 256)
            held.append(part)
            chars += part.column(1).nbytes
            if chars >= most_chars:
                yield pa.Table.from_batches(held)
                held, chars = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, most_chars: int, most_known: int) -> Iterator[tuple[pa.Table, list[np.ndarray]]]:
    known: dict[str, np.ndarray] = {}
    for t in _blocks(batches, most_chars):
        if len(known) > most_known:
            known = {}
        yield t, encode_block(t.column(1).to_pylist(), path, known)


def encode(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", ranks: str = DEFAULT_RANKS, block_chars: int = 8_000_000, known_words: int = 300_000) -> DataFrame:
    """(doc_id, ids): the token ids of each row's whole text, without special tokens (their strings are
    ordinary text). Null and empty texts have an empty list, a null id stays null, repeated rows stay.

    ``block_chars`` bounds the text held by a task at once (one text more at most), ``known_words`` the
    words remembered between blocks; neither changes a result.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, ids in _encoded(batches, ranks, block_chars, known_words):
            flat = pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)), flat)
            yield from pa.table([t.column(0).combine_chunks(), lists], ["doc_id", "ids"]).to_batches(max_chunksize=2_000)

    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(of, f"doc_id {df.schema[id_col].dataType.simpleString()}, ids array<int>")


def with_token_counts(df: DataFrame, text_col: str = "text", ranks: str = DEFAULT_RANKS, block_chars: int = 8_000_000, known_words: int = 300_000) -> DataFrame:
    """``df``'s columns but the text, and ``tokens``: the number of ids ``encode`` gives."""
    rest = [c for c in df.columns if c != text_col]
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, ids in _encoded(batches, ranks, block_chars, known_words):
            cols = [t.column(i).combine_chunks() for i in range(2, 2 + len(rest))]
            yield from pa.table([*cols, pa.array([len(x) for x in ids], pa.int64())], [*rest, "tokens"]).to_batches()

    packed = df.select(F.lit(0).alias("_at"), F.col(text_col).cast("string").alias("_text"), *rest)
    return packed.mapInArrow(of, f"{kinds}, tokens long")
