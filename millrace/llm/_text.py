"""Vectorised primitives on blocks of UTF-8 texts, shared by the operators of this subpackage.

A block joins whole texts with line feeds, so that every text is preceded and
followed by white space. All work on it is numpy on flat arrays: no loop over
characters or words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Text in a block; with its separators it just fits tables of 2 ** 21 entries.
BLOCK_BYTES = (1 << 21) - 16
_MASK = (1 << 64) - 1
#: glibc's; other C libraries have none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_BASE = 0x9E3779B97F4A7C15 | 1
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def trim() -> None:
    """Give freed memory back to the system: a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_TAB = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(_BASE, -1, 1 << 64)
        _POW[:] = []
        for r in (_BASE, inverse):
            p = np.empty(size, U64)
            p[0] = 1
            k = 1
            while k < size:
                p[k : 2 * k] = p[:k] * U64(pow(r, k, 1 << 64))
                k *= 2
            _POW.append(p)
    return _POW[0], _POW[1]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial hash; see :func:`span_hash`."""
    out = np.empty(len(buf) + 1, U64)
    out[0] = 0
    v = _TAB[buf]
    v *= _powers(len(buf) + 1)[0][: len(buf)]
    np.cumsum(v, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, equal for equal bytes wherever they lie."""
    h = prefix[end] - prefix[start]
    h *= _powers(len(prefix))[1][start]
    h += (end - start).astype(U64) * U64(0xA0761D6478BD642F)
    return mix(h)


def combine(hashes: np.ndarray, n: int) -> np.ndarray:
    """Order-dependent hashes of each n consecutive values (len - n + 1 of them)."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    out = np.zeros(m, U64)
    for k in range(n):
        out *= U64(_BASE)
        out += mix(hashes[k : k + m] + U64(0x632BE59BD9B4E019))
    return mix(out)


class Block:
    """Texts of some rows in one buffer: ``buf`` and each text's ``start`` and ``end`` in it."""

    def __init__(self, texts: list[bytes | None], lower: bool = False):
        joined = b"\n" + b"\n".join(x or b"" for x in texts) + b"\n"
        self.buf = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        size = np.fromiter((len(x) if x else 0 for x in texts), np.int64, len(texts))
        self.end = np.cumsum(size + 1)
        self.start = self.end - size
        self.n = len(texts)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words (maximal runs without 0x20, 0x09-0x0D), and where each text's words begin (n + 1)."""
        sp = SPACE[self.buf]
        edge = np.flatnonzero(sp[1:] != sp[:-1]) + 1
        s, e = edge[::2], edge[1::2]
        return s, e, np.append(np.searchsorted(s, self.start), len(s))


def blocks(batch: pa.RecordBatch, column: str = "text", max_bytes: int = BLOCK_BYTES, lower: bool = False) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Slices of a batch with their texts; a slice has ``max_bytes`` of text at most, or one text."""
    i = batch.schema.get_field_index(column)
    texts = batch.column(i).cast(pa.large_binary()).to_pylist()
    a = size = 0
    for b, x in enumerate(texts):
        n = len(x) if x else 0
        if b > a and size + n > max_bytes:
            yield batch.slice(a, b - a), Block(texts[a:b], lower)
            a, size = b, 0
        size += n + 1
    if len(texts) > a:
        yield batch.slice(a), Block(texts[a:], lower)
    del texts
    trim()


def doc_of(first: np.ndarray) -> np.ndarray:
    """The text's number of each word, from the third result of :meth:`Block.words`."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sums_by(values: np.ndarray, first: np.ndarray, dtype=np.float64) -> np.ndarray:
    """Sum of ``values[first[i]:first[i + 1]]`` for each i; empty ranges give 0."""
    c = np.concatenate([[0], np.cumsum(values, dtype=dtype)])
    return c[first[1:]] - c[first[:-1]]
