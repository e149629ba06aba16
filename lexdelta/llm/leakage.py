"""Evaluation passages inside a training corpus, found with suffix arrays of the training text.

A shard is a run of documents of about ``shard_words`` words inside one task. Its text is reduced to the runs of at
least ``min_words`` words any two neighbours of which are neighbours in a test too (others cannot match), and the suffixes of
those runs are sorted: the shard's suffix array. Every test suffix is bisected in it, which gives the interval of training suffixes that begin
with its first ``min_words`` words, and each match is stretched to its full verbatim length. Intervals are expanded
a bounded number of rows at a time, so a passage that many tests and many documents hold takes no more memory.

The corpus is scanned once a block of tests and never shuffled. Tests are sent to the tasks in blocks
of about ``block_chars`` characters, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexdelta.llm.words import words

MIN_WORDS = 18


class TestBlock:
    """Token numbers (from 1) of a block of tests; 0 stands between tests."""

    __test__ = False

    def __init__(self, ids: list, texts: list[str]) -> None:
        self.vocabulary: dict[str, int] = {}
        tokens, owner, first = [0], [-1], []
        for k, text in enumerate(texts):
            first.append(len(tokens))
            for w in words(text):
                tokens.append(self.vocabulary.setdefault(w, len(self.vocabulary) + 1))
                owner.append(k)
            tokens.append(0)
            owner.append(-1)
        self.ids = ids
        self.tokens = np.array(tokens, np.int64)
        self.owner = np.array(owner, np.int64)
        self.first = np.array(first, np.int64)
        pair = (self.tokens[:-1] > 0) & (self.tokens[1:] > 0)
        self.bigrams = np.unique(self.tokens[:-1][pair] << 32 | self.tokens[1:][pair])

    def probes(self, n: int) -> np.ndarray:
        """Where the suffixes of at least ``n`` words begin."""
        return np.flatnonzero(_left(self.tokens) >= n)


def _runs(tokens: np.ndarray, least: int, bigrams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of at least ``least`` tokens any two neighbours of which are in ``bigrams``, a zero before, between and after, and where each token stood."""
    known = tokens > 0
    both = known[1:] & known[:-1]
    at = np.flatnonzero(both)
    linked = np.zeros(len(tokens) + 1, bool)  # whether a token goes on from the one before
    code = tokens[at] << 32 | tokens[at + 1]
    if len(bigrams):
        spot = np.minimum(np.searchsorted(bigrams, code), len(bigrams) - 1)
        linked[at + 1] = bigrams[spot] == code
    start, end = np.flatnonzero(known & ~linked[:-1]), np.flatnonzero(known & ~linked[1:])
    long_ = end - start + 1 >= least
    start, size = start[long_], (end - start)[long_] + 2
    at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
    inner = np.ones(len(at), bool)
    inner[np.cumsum(size) - 1] = False
    out = np.zeros(len(at), np.int64)
    out[inner] = tokens[at[inner]]
    return np.r_[0, out], np.r_[-1, at]


def _left(tokens: np.ndarray) -> np.ndarray:
    """How many tokens stand from each place to the next zero."""
    zeros = np.flatnonzero(tokens == 0)
    return zeros[np.searchsorted(zeros, np.arange(len(tokens)))] - np.arange(len(tokens))


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Places of the non-zero tokens in the order of what follows up to the next zero, by prefix doubling.

    ``tokens`` end with a zero. Equal suffixes stand in the order of their places.
    """
    left = _left(tokens)
    rank, w, longest = tokens, 1, int(left.max(initial=0))
    while w < longest:
        second = np.where(left > w, rank[np.minimum(np.arange(len(rank)) + w, len(rank) - 1)], 0)
        distinct, rank = np.unique(rank * (int(rank.max()) + 1) + second, return_inverse=True)
        rank = rank.reshape(-1)
        if len(distinct) == len(rank):
            break
        w *= 2
    places = np.flatnonzero(left)
    return places[np.argsort(rank[places], kind="stable")]


def _below(text: np.ndarray, at: np.ndarray, test: np.ndarray, probe: np.ndarray, n: int, or_equal: bool) -> np.ndarray:
    """Whether the ``n`` tokens of ``text`` from ``at`` come before those of ``test`` from ``probe``, or are equal."""
    out = np.full(len(at), or_equal)
    open_ = np.arange(len(at))
    for k in range(n):
        x, y = text[at[open_] + k], test[probe[open_] + k]
        differ = x != y
        out[open_[differ]] = x[differ] < y[differ]
        open_ = open_[~differ]
        if not len(open_):
            break
    return out


def _bisect(text: np.ndarray, order: np.ndarray, test: np.ndarray, probe: np.ndarray, n: int, right: bool) -> np.ndarray:
    """For each test suffix the first place in ``order`` that is not below it (``right``: that is above it) in its first ``n`` tokens."""
    low, high = np.zeros(len(probe), np.int64), np.full(len(probe), len(order), np.int64)
    live = np.arange(len(probe))
    while len(live):
        mid = (low[live] + high[live]) // 2
        below = _below(text, order[mid], test, probe[live], n, right)
        low[live[below]] = mid[below] + 1
        high[live[~below]] = mid[~below]
        live = live[low[live] < high[live]]
    return low


def search_shard(tokens: np.ndarray, block: TestBlock, min_words: int = MIN_WORDS, rows: int = 1 << 20) -> Iterator[np.ndarray]:
    """Rows (place in the shard, place in the tests, length) of the maximal verbatim matches, in parts of about ``rows`` candidates."""
    text, place = _runs(tokens, min_words, block.bigrams)
    if len(text) == 1:
        return
    order = suffix_array(text)
    order = order[_left(text)[order] >= min_words]
    probe, low = block.probes(min_words), None
    low = _bisect(text, order, block.tokens, probe, min_words, False)
    met = low < len(order)
    met[met] = ~_below(block.tokens, probe[met], text, order[low[met]], min_words, False)
    probe, low = probe[met], low[met]
    n = _bisect(text, order, block.tokens, probe, min_words, True) - low
    ends = np.cumsum(n)
    start = 0
    while start < len(probe):
        to = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + rows, "right")))
        m = n[start:to]
        p = np.repeat(probe[start:to], m)
        s = order[np.repeat(low[start:to], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)]
        # a match whose preceding words agree too is part of a longer one
        first = (text[s - 1] == 0) | (text[s - 1] != block.tokens[p - 1])
        s, p = s[first], p[first]
        length = np.full(len(s), min_words, np.int64)
        live = np.arange(len(s))
        while len(live):
            x, y = text[s[live] + length[live]], block.tokens[p[live] + length[live]]
            live = live[(x == y) & (x > 0)]
            length[live] += 1
        if len(s):
            yield np.stack([place[s], p, length], 1)
        start = to


def _scan(docs: DataFrame, block: TestBlock, min_words: int, shard_words: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(block)
    key_type = docs.schema["_id"].dataType.simpleString()

    def flush(ids: list, parts: list[np.ndarray]) -> Iterator[pd.DataFrame]:
        b = shared.value
        starts = np.cumsum([0] + [len(x) + 1 for x in parts])
        tokens = np.concatenate([y for x in parts for y in (x, [0])]).astype(np.int64)
        for found in search_shard(tokens, b, min_words):
            doc = np.searchsorted(starts, found[:, 0], "right") - 1
            item = b.owner[found[:, 1]]
            yield pd.DataFrame({"doc_id": [ids[d] for d in doc], "item_id": [b.ids[i] for i in item], "word_at": found[:, 0] - starts[doc], "item_word_at": found[:, 1] - b.first[item], "n_words": found[:, 2]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = shared.value.vocabulary
        ids: list = []
        parts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for i, text in zip(batch["_id"].tolist(), batch["_text"]):
                got = [vocabulary.get(w, 0) for w in words(text)]
                if len(got) < min_words:
                    continue
                ids.append(i)
                parts.append(np.array(got, np.int64))
                held += len(got)
                if held >= shard_words:
                    yield from flush(ids, parts)
                    ids, parts, held = [], [], 0
        if parts:
            yield from flush(ids, parts)

    return docs.mapInPandas(run, f"doc_id {key_type}, item_id bigint, word_at bigint, item_word_at bigint, n_words bigint")


def leaked(docs: DataFrame, tests: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", test_id: str = "item_id", test_text: str = "text", min_words: int = MIN_WORDS, shard_words: int = 400_000, block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, item_id, word_at, item_word_at, n_words): a row for each longest verbatim match of ``min_words`` words or more.

    ``word_at`` and ``item_word_at`` say where it begins in the document and in the test, counted from 0. Texts that are NULL, empty or shorter match nothing; repeated documents and
    tests each count; empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    lean = docs.select(F.col(doc_id).alias("_id"), F.col(doc_text).alias("_text")).where("_text is not null")
    t = tests.select(F.col(test_id).cast("bigint").alias("i"), F.col(test_text).alias("t")).where("t is not null")
    total = t.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // block_chars)
    out = None
    for k in range(blocks):
        rows = t.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()  # about block_chars characters
        part = _scan(lean, TestBlock([r["i"] for r in rows], [r["t"] for r in rows]), min_words, shard_words)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"doc_id {lean.schema['_id'].dataType.simpleString()}, item_id bigint, word_at bigint, item_word_at bigint, n_words bigint")
    return out


def leaked_items(matches: DataFrame) -> DataFrame:
    """(doc_id, item_id): which tests stand in which documents, each once."""
    return matches.select("doc_id", "item_id").distinct()


def without_leaks(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without the documents in ``found``; a NULL id is kept."""
    return docs.join(found.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")
