"""Hashed features and small linear learners, fitted with numpy on bounded samples."""

from __future__ import annotations

import numpy as np

from ._text import Block, U64


def gram_codes(buf: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Hashed index of the byte n-gram that starts at each position (positions near the end wrap into zeros)."""
    code = np.zeros(len(buf), np.uint32 if order <= 4 else U64)
    kind = code.dtype.type
    for k in range(order):
        code[: len(buf) - k] |= buf[k:].astype(code.dtype) << kind(8 * k)
    if order <= 4:
        code ^= np.uint32(0x9E37 * order)
        code *= np.uint32(2654435761)
        code ^= code >> np.uint32(15)
        code *= np.uint32(2246822519)
        return (code >> np.uint32(32 - bits)).astype(np.int32)
    code ^= U64(0x9E37 * order)
    code *= U64(0x9E3779B97F4A7C15)
    return (code >> U64(64 - bits)).astype(np.int32)


def gram_rows(block: Block, orders: tuple[int, ...], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every byte n-gram that lies in a text."""
    rows, feats = [], []
    for k in orders:
        code = gram_codes(block.buf, k, bits)
        size = np.maximum(block.end - block.start - k + 1, 0)
        row = np.repeat(np.arange(block.n), size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(block.start, size)
        rows.append(row)
        feats.append(code[at])
    return np.concatenate(rows), np.concatenate(feats)


def sparse(rows: np.ndarray, feats: np.ndarray, n: int, dim: int, value: str = "l2") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) with one entry for each pair; values are counts scaled to unit length."""
    key, count = np.unique(rows.astype(np.int64) * dim + feats, return_counts=True)
    r, f, v = key // dim, key % dim, count.astype(np.float64)
    if value == "log":
        v = 1 + np.log(v)
    norm = np.sqrt(np.bincount(r, v * v, n))
    return r, f, v / norm[r]


def fit_linear(r, f, v, y, dim: int, l2: float = 1e-4, steps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on (row, feature, value) entries, by accelerated full gradients."""
    s = np.where(y > 0, 1.0, -1.0)

    def slope(w, b):
        g = -s / (1 + np.exp(np.clip(s * (np.bincount(r, v * w[f], len(y)) + b), -500, 500))) / len(y)
        return np.bincount(f, v * g[r], dim) + l2 * w, g.sum()

    return _accelerated(slope, dim, 2.0, steps)


def fit_dense(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-4, steps: int = 80) -> tuple[np.ndarray, float]:
    """An L2-SVM (squared hinge) on unit vectors; rows with ``weight`` 0 don't count."""
    s = np.where(y > 0, 1.0, -1.0)

    def slope(w, b):
        g = -2 * weight * s * np.maximum(0, 1 - s * (x @ w.astype(np.float32) + b))
        return g.astype(np.float32) @ x + l2 * w, g.sum()

    return _accelerated(slope, x.shape[1], 0.25, steps)


def _accelerated(slope, dim: int, rate: float, steps: int) -> tuple[np.ndarray, float]:
    w, b, zw, zb, t = np.zeros(dim), 0.0, np.zeros(dim), 0.0, 1.0
    for _ in range(steps):
        gw, gb = slope(zw, zb)
        nw, nb = zw - rate * gw, zb - rate * gb
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        zw, zb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, float(b)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))
