"""Benchmark decontamination: a BM25 inverted index of the test items with block-max WAND.

The items are the index, every window of every training text is a query. Windows
are as long as two of the longest items and overlap by half, so an item-long
excerpt always lies whole in one. An item's scores are divided by its score for
its own text, so one threshold serves all items.

Postings are kept in blocks of neighbouring items; each block and term has the
largest impact in it. As in block-max WAND a block is opened only if the terms'
block maxima can add up to the threshold: first over the distinct words of the
window's two halves, then over its own distinct words. Only postings of opened
blocks are scored, and every item at or above the threshold is retrieved. A
retrieved item is a leak if the window has at least ``overlap`` of its five-word
shingles and at least half of the words of its question and of its answer.

Items come with columns ``question`` and ``answer``, or with ``text`` whose last
sentence is taken as the answer. The index goes to the executors only up to
``INDEX_BYTES`` of item text; beyond that the items are dealt into shards of that
size and the texts are read once for each shard.

Defined cases: null text counts as empty; items without words match nothing;
items of one to four words have one shingle; repeated items each match.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .passages import WORD

INDEX_BYTES = 16 << 20
BLOCK, THRESHOLD, OVERLAP, SHINGLE = 8, 0.75, 0.8, 5
K1, B = 1.2, 0.75
#: Words of text that a worker looks at in one go.
GO = 400_000


class Numbers(dict):
    def __missing__(self, word: str) -> int:
        return -1


def tokens(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def split_item(text: str | None) -> tuple[str, str]:
    """(question, answer): the last sentence of a text is its answer; a single sentence has none."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+", (text or "").strip()) if tokens(p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text or "", "")


class Index:
    """BM25 impacts of items, relative to each item's own score, in blocks."""

    def __init__(self, items: list[tuple[int, str, str]]):
        given = [(i, tokens(q), tokens(a)) for i, q, a in items]
        given = self._like_by_like([x for x in given if x[1] or x[2]])
        self.ids = [x[0] for x in given]
        self.words = [q + a for _, q, a in given]
        self.parts = [(set(q), set(a)) for _, q, a in given]
        self.longest = max(map(len, self.words), default=1)
        n, mean = len(given), sum(map(len, self.words)) / max(1, len(given))
        counts = [{w: x.count(w) for w in set(x)} for x in self.words]
        df: dict[str, int] = {}
        for c in counts:
            for w in c:
                df[w] = df.get(w, 0) + 1
        self.number = Numbers((w, i) for i, w in enumerate(sorted(df)))
        self.n_blocks = -(-n // BLOCK)
        self.block_max = np.zeros((len(df), max(1, self.n_blocks)), np.float32)
        postings: list[list[list[tuple[int, float]]]] = [[[] for _ in range(self.n_blocks)] for _ in df]
        for i, c in enumerate(counts):
            size = K1 * (1 - B + B * len(self.words[i]) / mean)
            impact = {w: np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * (K1 + 1) / (tf + size) for w, tf in c.items()}
            whole = sum(impact.values())
            for w, x in impact.items():
                t = self.number[w]
                postings[t][i // BLOCK].append((i, x / whole))
                self.block_max[t, i // BLOCK] = max(self.block_max[t, i // BLOCK], x / whole)
        self.postings = postings
        self.shingles = [self._shingles(w) for w in self.words]

    @staticmethod
    def _like_by_like(given: list[tuple]) -> list[tuple]:
        """Items with the same frequent words, so of one language, next to each other: block maxima get tighter."""
        df: dict[str, int] = {}
        for _, q, a in given:
            for w in {*q, *a}:
                df[w] = df.get(w, 0) + 1
        return sorted(given, key=lambda x: (sorted({*x[1], *x[2]}, key=lambda w: (-df[w], w))[:3], len(x[1]) + len(x[2]), str(x[0])))

    @staticmethod
    def _shingles(words: list[str]) -> set[tuple]:
        k = min(SHINGLE, len(words))
        return {tuple(words[j : j + k]) for j in range(len(words) - k + 1)}

    def retrieve(self, terms: list[int], blocks: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """The items of ``blocks`` that score at least ``threshold`` for a window's distinct terms."""
        out = []
        for b in blocks.tolist():
            score: dict[int, float] = {}
            for t in terms:
                for i, x in self.postings[t][b]:
                    score[i] = score.get(i, 0.0) + x
            out += [(i, s) for i, s in score.items() if s >= threshold]
        return out

    def overlap(self, item: int, words: list[str], inside: set[tuple] | None = None) -> tuple[float, float, float]:
        """Shares of the item's shingles, of its question's and of its answer's words that a window has."""
        k = min(SHINGLE, len(self.words[item]))
        have = inside if inside is not None and k == SHINGLE else {tuple(words[j : j + k]) for j in range(len(words) - k + 1)}
        mine, there = self.shingles[item], set(words)
        part = lambda s: len(s & there) / len(s) if s else 1.0
        return len(mine & have) / len(mine), part(self.parts[item][0]), part(self.parts[item][1])

    def matches(self, words: list[str], threshold: float, overlap: float):
        """(window's start, item, score, overlaps) of the leaks in one text."""
        yield from self.scan([words], threshold, overlap)

    def scan(self, texts: list[list[str]], threshold: float, overlap: float):
        """(text, window's start, item, score, overlaps) of the leaks in some texts."""
        step = self.longest
        sizes = np.array([len(t) for t in texts], np.int64)
        if not sizes.sum():
            return
        base = np.cumsum(sizes) - sizes
        term = np.fromiter(map(self.number.__getitem__, chain.from_iterable(texts)), np.int32, int(sizes.sum()))
        # Halves of windows: the distinct terms' block maxima, added up for each half.
        halves = -(-sizes // step)
        half_base = np.cumsum(halves) - halves
        known = np.flatnonzero(term >= 0)
        text_of = np.repeat(np.arange(len(sizes)), sizes)[known]
        half = half_base[text_of] + (known - base[text_of]) // step
        key = np.unique(half * len(self.postings) + term[known])
        half, distinct = key // max(1, len(self.postings)), key % max(1, len(self.postings))
        sums = np.zeros((int(halves.sum()) + 1, self.block_max.shape[1]), np.float32)
        if len(key):
            at = np.flatnonzero(np.r_[True, half[1:] != half[:-1]])
            sums[half[at]] = np.add.reduceat(self.block_max[distinct], at)
        windows = np.maximum(halves - 1, np.minimum(halves, 1))
        of = np.repeat(np.arange(len(sizes)), windows)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        start = base[of] + nth * step
        stop = np.minimum(start + 2 * step, base[of] + sizes[of])
        first = half_base[of] + nth
        second = np.where(halves[of] > 1, first + 1, len(sums) - 1)
        open_ = sums[first] + sums[second] >= threshold - 1e-4
        for w in np.flatnonzero(open_.any(axis=1)).tolist():
            a, b = int(start[w]), int(stop[w])
            distinct = np.unique(term[a:b])
            distinct = distinct[distinct >= 0]
            reach = self.block_max[distinct].sum(axis=0)
            blocks = np.flatnonzero(open_[w] & (reach >= threshold - 1e-5))
            if not len(blocks):
                continue
            found = self.retrieve(distinct.tolist(), blocks, threshold)
            if found:
                k = int(of[w])
                words = texts[k][a - int(base[k]) : b - int(base[k])]
                inside = {tuple(words[j : j + SHINGLE]) for j in range(len(words) - SHINGLE + 1)}
                for item, score in found:
                    shares = self.overlap(item, words, inside)
                    if shares[0] >= overlap and min(shares[1:]) >= 0.5:
                        yield k, a - int(base[k]), item, score, shares


def _shards(items: DataFrame, limit: int) -> list[list[tuple]]:
    """The items as (id, question, answer), dealt into shards of at most about ``limit`` bytes."""
    if "question" in items.columns and "answer" in items.columns:
        given = items.select("item_id", F.coalesce("question", F.lit("")).alias("q"), F.coalesce("answer", F.lit("")).alias("a"))
    else:
        given = items.select("item_id", F.coalesce("text", F.lit("")).alias("q"), F.lit(None).cast("string").alias("a"))
    size = given.agg(F.sum(F.octet_length("q") + F.coalesce(F.octet_length("a"), F.lit(0)))).first()[0] or 0
    n = int(-(-size // limit)) or 1
    dealt = given.withColumn("shard", F.pmod(F.xxhash64("item_id", "q"), F.lit(n)))
    for k in range(n):
        yield [(r["item_id"], *((r["q"], r["a"]) if r["a"] is not None else split_item(r["q"]))) for r in dealt.where(F.col("shard") == k).collect()]


def _run(items: list[tuple], threshold: float, overlap: float):
    def run(batches):
        index = Index(items)
        for batch in batches:
            ids, texts, at, n, out = batch.column("doc_id").to_pylist(), [], [], 0, []

            def look():
                for k, start, item, score, shares in index.scan(texts, threshold, overlap):
                    out.append((ids[at[k]], index.ids[item], start, float(score), *shares))
                texts.clear()
                at.clear()

            for i, text in enumerate(batch.column("text")):
                texts.append(tokens(text.as_py()))
                at.append(i)
                n += len(texts[-1])
                if n > GO // max(1, index.n_blocks // 16):
                    look()
                    n = 0
            look()
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int64()] + [pa.float64()] * 4, strict=True)], names=["doc_id", "item_id", "start", "score", "overlap", "question_overlap", "answer_overlap"])

    return run


def find_leaks(documents: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """doc_id, item_id, score, overlap, question_overlap, answer_overlap and windows (how many
    windows show it) of each benchmark item found in each document; the largest values count."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id bigint, item_id bigint, start bigint, score double, overlap double, question_overlap double, answer_overlap double"
    found = None
    for shard in _shards(items.withColumn("item_id", F.col("item_id").cast("long")), index_bytes):
        part = rows.mapInArrow(_run(shard, threshold, overlap), schema)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("overlap").alias("overlap"), F.max("question_overlap").alias("question_overlap"), F.max("answer_overlap").alias("answer_overlap"), F.count("*").alias("windows"))


def remove_leaks(documents: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of ``documents`` whose doc_id has no leak; rows with a null doc_id stay, as no leak can name them."""
    return documents.join(find_leaks(documents, items, **how).select("doc_id").distinct(), "doc_id", "left_anti")
