"""Toxicity scores by FTRL-proximal logistic regression on hashed word n-grams and skip-grams.

A text's features are its distinct words, pairs of neighbouring words and pairs
with one word between (words: runs of letters and digits, A-Z lower-cased).
FTRL-proximal gives each coordinate its own rate, and its L1 term leaves few
weights that aren't zero: these are broadcast, at most 2 ** BITS of them.

It learns, in the driver, from labelled texts in the order of a hash of the id:
at most ``max_rows`` of them, and no more than ``max_features`` features in all
(the first text always counts). Features are made where the texts are, so the
driver gets numbers only. The settings were chosen by cross-validation (four
folds by text, least log loss) among the rows that may be learned from.

Defined results: null and empty texts have no features and get the bias alone;
null labels aren't learned from; labels that repeat count each; without labels
all scores are 0.5. Repeated rows and empty tables need no care; extra columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ._linear import sigmoid
from ._store import drop_table, table
from ._text import Block, U64, blocks, doc_of, mix, prefix_hash, span_hash

BITS = 20
_SIGN = np.zeros(256, bool)
_SIGN[:128] = True
_SIGN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False


def plain_words(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :meth:`Block.words`, with ASCII signs as white space (in the buffer, too)."""
    b.buf = np.where(_SIGN[b.buf], np.uint8(32), b.buf)
    return b.words()


def grams(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of all words, pairs and skip pairs of a lower-cased block."""
    s, e, first = plain_words(b)
    h, doc = span_hash(prefix_hash(b.buf), s, e), doc_of(first)
    rows, feats = [doc], [h]
    for gap in (1, 2):
        same = doc[gap:] == doc[:-gap]
        rows.append(doc[gap:][same])
        feats.append(mix(h[:-gap][same] * U64(0x9E3779B97F4A7C15) + h[gap:][same] + U64(gap)))
    return np.concatenate(rows), (np.concatenate(feats) >> U64(64 - BITS)).astype(np.int32)


class Ftrl:
    """Per-coordinate FTRL-proximal for binary features; the last coordinate is the bias, without L1."""

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 5.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        l1 = np.where(i == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2))

    def learn(self, i: np.ndarray, y: float) -> None:
        """One text: its distinct features with the bias."""
        w = self.weights(i)
        g = sigmoid(w.sum()) - y
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def text_features(b: Block) -> list[np.ndarray]:
    """Each text's distinct features, sorted."""
    r, f = grams(b)
    key = np.unique(r.astype(np.int64) << BITS | f)
    cut = np.searchsorted(key, np.arange(b.n + 1) << BITS)
    flat = (key & ((1 << BITS) - 1)).astype(np.int32)
    return [flat[p:q] for p, q in zip(cut, cut[1:])]


def fit(rows: list[np.ndarray], y: list[int], epochs: int = 2, seed: int = 5) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and values of the non-zero weights, and the bias; ``rows``: each text's distinct features."""
    model = Ftrl()
    order = np.arange(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        rng.shuffle(order)
        for k in order.tolist():
            model.learn(np.append(rows[k], np.int32(1 << BITS)), y[k])
    w = model.weights(np.arange((1 << BITS) + 1))
    at = np.flatnonzero(w[:-1])
    return at.astype(np.int32), w[at], float(w[-1])


def sample(rows: DataFrame, known: DataFrame, max_rows: int, max_features: int) -> tuple[list[np.ndarray], list[int]]:
    """Features and labels to learn from; ``rows``: doc_id, text; ``known``: doc_id, y."""
    h = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(11)), F.lit(1 << 30))
    total = known.count()
    share = int(min(1.0, 1.1 * max_rows / max(1, total)) * (1 << 30))

    def features(batches):
        for batch in batches:
            for part, b in blocks(batch, lower=True):
                f = text_features(b)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(x) for x in f], pa.int32()), pa.array([x.tobytes() for x in f], pa.binary())], ["h", "y", "n", "f"])

    # about max_rows narrow rows, so this side may be broadcast
    some = rows.join(F.broadcast(known.where(h < share)), "doc_id").select(h.alias("h"), "y", "text").mapInArrow(features, "h long, y int, n int, f binary")
    made, path = table(some, "labelled")
    size = made.select("h", "n").toArrow()
    hs, ns = size["h"].to_numpy(), size["n"].to_numpy().astype(np.int64)
    by = np.argsort(hs, kind="stable")[:max_rows]
    use = max(1, int(np.searchsorted(np.cumsum(ns[by]), max_features, "right")))
    last = int(hs[by[:use]][-1]) if len(by) else -1
    got = made.where(F.col("h") <= last).toArrow()
    order = np.lexsort((got["n"].to_numpy(), got["h"].to_numpy()))[:use].tolist()
    flat, ys = got["f"], got["y"].to_pylist()
    out = [np.frombuffer(flat[i].as_py(), np.int32) for i in order], [ys[i] for i in order]
    drop_table(rows.sparkSession, path)
    return out


def toxicity(df: DataFrame, labels: DataFrame, held_out: F.Column | None = None, max_rows: int = 16_000, max_features: int = 16_000_000, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    ``labels``: doc_id and ``label`` (0 or 1). ``held_out``: a boolean column on doc_id, rows whose labels aren't
    learned from; by default crc32 of the id's text mod 3 = 1.
    """
    ship(df.sparkSession)
    if held_out is None:
        held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & ~held_out)
    shared = df.sparkSession.sparkContext.broadcast(fit(*sample(rows, known, max_rows, max_features)))

    def score(batches):
        at, w, bias = shared.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[at] = w
        for batch in batches:
            for part, b in blocks(batch, lower=True):
                r, f = grams(b)
                live = dense[f] != 0
                key = np.unique(r[live].astype(np.int64) << BITS | f[live])
                s = sigmoid(bias + np.bincount(key >> BITS, dense[key & ((1 << BITS) - 1)], b.n))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = dict(df.dtypes)[doc_id]
    return rows.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
