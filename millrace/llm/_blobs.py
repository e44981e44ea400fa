"""Numpy arrays in binary columns: what chunk-wise operators write and shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext

from ._text import Block


def pack(x: np.ndarray, level: int = 1) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), level)


def unpack(x: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), dtype)


def split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, indices) for each bucket that occurs, indices ascending."""
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]])) if len(b) else []
    for a, z in zip(cut, [*cut[1:], len(b)]):
        yield int(b[a]), order[a:z]


def columns(batch: bool = False, **cols):
    """A table or record batch of (values, type) columns."""
    made = {k: pa.array(v, t) for k, (v, t) in cols.items()}
    return pa.RecordBatch.from_pydict(made) if batch else pa.table(made)


def chunked(batches, size: int, lower: bool = False) -> Iterator[tuple[int, Block, list[pa.Array]]]:
    """Puts the rows of a task together to chunks of about ``size`` bytes of text: (unique number, texts, other columns).

    The text is the last column. The numbers are unique in a run; write the chunks before they are used twice.
    """
    number = TaskContext.get().partitionId() << 32
    texts, rest, total = [], [], 0
    for batch in batches:
        rows = batch.column(batch.num_columns - 1).cast(pa.large_binary())
        a = 0
        for i in range(len(rows)):
            x = rows[i].as_py() or b""
            texts.append(x)
            total += len(x) + 1
            if total >= size:
                rest.append(batch.slice(a, i + 1 - a))
                a = i + 1
                yield number, Block(texts, lower), _joined(rest)
                texts, rest, total, number = [], [], 0, number + 1
        if a < len(rows):
            rest.append(batch.slice(a))
    if texts:
        yield number, Block(texts, lower), _joined(rest)


def _joined(parts: list[pa.RecordBatch]) -> list[pa.Array]:
    return [pa.concat_arrays([p.column(i) for p in parts]) for i in range(parts[0].num_columns - 1)]
