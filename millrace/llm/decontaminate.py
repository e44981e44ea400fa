"""Benchmark decontamination: rare word-pair seeds, then Smith-Waterman alignment.

Texts and test items are words (runs of letters and digits, A-Z lower-cased).
A document is contaminated if a Smith-Waterman alignment over words with an item
(substitutions, gaps and reordered ends cost score) reaches ``least`` of the
score of an exact copy. Seeds lose no such alignment: with M matched words and
a score of T or more it has at most 2 M - T edits, so of the M - 1 steps from a
matched word to the next at most M - T / 2 have two edits or more, and at least
K = T / 2 - 1 have one or none. Such a step is a pair of words that are next to
each other, or have one word between, in the item and in the document. Each
step begins at another word of the item, so one of them begins outside any
K - 1 words: an item's pairs are counted over all documents and its seeds are
all pairs but those that begin at its K - 1 most frequent places. A seed's place
in a document names a passage around it, as long as the item and the longest
gaps on either side, which is aligned with the item.

Items are broadcast in parts of at most ``MAX_PART_WORDS`` words; a larger
benchmark takes several passes over the documents, with the same result.

Defined results: null and empty texts are clean; items without words are never
found; an item of one word is its own seed, of longer ones two words near each
other are needed, even where one would reach ``least``. The best match is exact
from ``least`` on; a smaller one is a lower bound. Documents are judged
row by row, so repeated rows, ties and extra columns need no care; empty tables
give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ._text import Block, U64, blocks, doc_of, mix, prefix_hash, span_hash
from .toxicity import plain_words

#: Distances of the words of a pair; an item of one word is a pair with itself.
LAGS = (1, 2)
MATCH, MISMATCH, GAP = 2, -1, -1
MAX_PART_WORDS = 1_000_000


def word_hashes(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and where each text's begin."""
    s, e, first = plain_words(b)
    return span_hash(prefix_hash(b.buf), s, e), first


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each pair; all pairs advance together, an item's word at a time."""
    n, rows = len(items), max(map(len, items))
    cols = max(map(len, passages))
    a, b = np.zeros((n, rows), U64), np.ones((n, cols), U64)  # what pads them never matches
    for i, (x, y) in enumerate(zip(items, passages)):
        a[i, : len(x)], b[i, : len(y)] = x | U64(2), y | U64(2)
    h, best = np.zeros((n, cols + 1), np.int32), np.zeros(n, np.int32)
    ramp = -GAP * np.arange(cols + 1, dtype=np.int32)
    size = np.array(list(map(len, items)))
    for k in range(rows):
        t = np.maximum(h[:, :-1] + np.where(b == a[:, k : k + 1], MATCH, MISMATCH), h[:, 1:] + GAP)
        h[:, 1:] = np.maximum(t, 0)
        h = np.maximum.accumulate(h + ramp, axis=1) - ramp  # gaps in the item
        np.maximum(best, np.where(k < size, h.max(axis=1), 0), out=best)
    return best


class Items:
    """Word hashes of some items, and the seeds that lead to them."""

    def __init__(self, hashes: list[np.ndarray], least: float):
        self.words = hashes
        size = np.array(list(map(len, hashes)), np.int64)
        self.score = np.ceil(MATCH * size * least - 1e-9).astype(np.int64)  # what an alignment must reach
        self.slack = np.maximum(MATCH * size - self.score, 0)  # most edits of such an alignment
        self.lags = sorted({k for m in size.tolist() for k in (LAGS if m > 1 else (0,))})
        seeds, item, place = [], [], []
        for i, h in enumerate(hashes):
            for k in LAGS if len(h) > 1 else (0,):
                g = pair_hashes(h, k)
                seeds.append(g), item.append(np.full(len(g), i)), place.append(np.arange(len(g)))
        self.seed = np.concatenate(seeds) if seeds else np.empty(0, U64)
        self.item = np.concatenate(item) if item else np.empty(0, np.int64)
        self.place = np.concatenate(place) if place else np.empty(0, np.int64)

    def keep_rare(self, counts: dict[int, int]) -> None:
        n = np.array([counts.get(int(s), 0) for s in self.seed.view(np.int64)])
        keep = np.zeros(len(n), bool)
        cut = np.searchsorted(self.item, np.arange(len(self.words) + 1)).tolist()
        for (a, z), score in zip(zip(cut, cut[1:]), self.score.tolist()):
            if z > a:
                at = np.bincount(self.place[a:z], n[a:z])
                steps = max(1, -(-score // 2) - 1)  # places where an alignment has a seed, at least
                rare = np.zeros(len(at), bool)
                rare[np.argsort(at, kind="stable")[: max(0, len(at) - steps + 1)]] = True
                keep[a:z] = rare[self.place[a:z]]
        keep &= n > 0
        order = np.argsort(self.seed[keep], kind="stable")
        self.seed, self.item, self.place = self.seed[keep][order], self.item[keep][order], self.place[keep][order]


def pair_hashes(h: np.ndarray, lag: int) -> np.ndarray:
    """Hashes of each word with the word ``lag`` places on."""
    x = mix(h + U64(0x632BE59BD9B4E019))
    return mix(x[: len(x) - lag] * U64(0x9E3779B97F4A7C15) + x[lag:]) if len(x) > lag else np.empty(0, U64)


def _found(known: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Indices of the elements of ``h`` that are in the sorted ``known``."""
    if not len(known) or not len(h):
        return np.empty(0, np.int64)
    low = np.zeros(1 << 16, bool)  # a filter that leaves few to be searched
    low[(known & U64(0xFFFF)).astype(np.int64)] = True
    i = np.flatnonzero(low[(h & U64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(known, h[i]), len(known) - 1)
    return i[known[at] == h[i]]


def _pairs(h: np.ndarray, doc: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Pair hashes inside texts, and their places."""
    if len(h) <= lag:
        return np.empty(0, U64), np.empty(0, np.int64)
    at = np.flatnonzero(doc[lag:] == doc[: len(doc) - lag])
    return pair_hashes(h, lag)[at], at


def best_matches(b: Block, items: Items) -> np.ndarray:
    """Each text's best alignment score, as a share of an exact copy's."""
    h, first = word_hashes(b)
    doc = doc_of(first)
    todo: dict[tuple[int, int], list[tuple[int, int]]] = {}
    hits = []
    for lag in items.lags:
        g, at = _pairs(h, doc, lag)
        k = _found(items.seed, g)
        hits += zip(at[k].tolist(), np.searchsorted(items.seed, g[k]).tolist(), np.searchsorted(items.seed, g[k], "right").tolist())
    for p, low, high in sorted(hits):
        d = int(doc[p])
        for j in range(low, high):
            i = int(items.item[j])
            m, more = len(items.words[i]), int(items.slack[i])
            lo, hi = p - int(items.place[j]) - more, p - int(items.place[j]) + m + more
            spans = todo.setdefault((d, i), [])
            if spans and lo <= spans[-1][1]:
                spans[-1] = (min(lo, spans[-1][0]), max(hi, spans[-1][1]))
            else:
                spans.append((lo, hi))
    pairs = []
    for (d, i), spans in todo.items():
        m = len(items.words[i]) + int(items.slack[i])  # an alignment is no longer
        for lo, hi in spans:
            lo, hi = max(lo, int(first[d])), min(hi, int(first[d + 1]))
            pairs += [(d, i, q, min(q + 3 * m, hi)) for q in range(lo, max(lo + 1, hi - m), 2 * m)]  # long stretches in overlapping parts
    best = np.zeros(b.n)
    pairs.sort(key=lambda x: (len(items.words[x[1]]), x[3] - x[2]))
    for a in range(0, len(pairs), 256):
        some = pairs[a : a + 256]
        score = align([items.words[i] for _, i, _, _ in some], [h[p:q] for _, _, p, q in some])
        for (d, i, _, _), s in zip(some, score.tolist()):
            best[d] = max(best[d], s / (MATCH * len(items.words[i])))
    return best


def benchmark_parts(benchmark: DataFrame, least: float, text: str = "text"):
    """The items, some at a time: within ``MAX_PART_WORDS`` words, or one."""
    part, total = [], 0
    for row in benchmark.select(text).where(F.col(text).isNotNull()).toLocalIterator():
        h, _ = word_hashes(Block([row[0].encode("utf-8", "replace")], lower=True))
        if part and total + len(h) > MAX_PART_WORDS:
            yield Items(part, least)
            part, total = [], 0
        if len(h):
            part.append(h)
            total += len(h)
    if part:
        yield Items(part, least)


def count_seeds(df: DataFrame, items: Items, text: str = "text") -> dict[int, int]:
    """How often each seed occurs in all documents; at most one row a seed reaches the driver."""
    shared = df.sparkSession.sparkContext.broadcast((np.unique(items.seed), items.lags))

    def count(batches):
        known, lags = shared.value
        n = np.zeros(len(known), np.int64)
        for batch in batches:
            for _, b in blocks(batch, text, lower=True):
                h, first = word_hashes(b)
                doc = doc_of(first)
                for k in lags:
                    g, _ = _pairs(h, doc, k)
                    n += np.bincount(np.searchsorted(known, g[_found(known, g)]), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(known[at].view(np.int64)), pa.array(n[at])], ["seed", "n"])

    got = df.select(text).mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()
    return dict(zip(got["seed"].to_pylist(), got["n"].to_pylist()))


def decontaminate(df: DataFrame, benchmark: DataFrame, least: float = 0.5, text: str = "text", keep_all: bool = False) -> DataFrame:
    """The clean rows of ``df``; with ``keep_all`` all rows, with the best match as ``match`` and ``contaminated`` (which replace columns of these names)."""
    if keep_all:
        df = df.drop(*{"match", "contaminated"} - {text})
    ship(df.sparkSession)
    out = df.withColumn("__mr_match", F.lit(0.0))
    schema = out.schema
    for items in benchmark_parts(benchmark, least, text):
        items.keep_rare(count_seeds(df, items, text))
        shared = df.sparkSession.sparkContext.broadcast(items)

        def judge(batches, shared=shared):
            for batch in batches:
                for part, b in blocks(batch, text, lower=True):
                    m = pa.array(np.maximum(part.column(part.num_columns - 1).to_numpy(), best_matches(b, shared.value)))
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], m], part.schema.names)

        out = out.mapInArrow(judge, schema)
    if keep_all:
        return out.withColumn("contaminated", F.col("__mr_match") >= least).withColumnRenamed("__mr_match", "match")
    return out.where(F.col("__mr_match") < least).drop("__mr_match")
