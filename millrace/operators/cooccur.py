"""Pairs of keys that share groups, counted without a row for each pair in a shuffle.

A group's sorted keys leave as one row a key with the keys after it (four bytes each); whoever has all rows of a key
counts them in numpy.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import release, ship, stored

#: Pairs that a task counts, about; elements that it holds before it adds them up.
_TASK, _HELD = 4_000_000, 8_000_000


def _tails(batches):
    """Rows (all: sorted list) become rows (k, tail): each element with those after it that differ from it."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        x = b.column(0)
        values, ends = np.asarray(x.flatten()), np.cumsum(np.asarray(x.value_lengths(), dtype=np.int64))
        end = np.repeat(ends, np.diff(ends, prepend=0))
        at, first = 0, np.arange(len(values)) + 1
        if len(values) > 1:
            last = np.append(np.flatnonzero((values[1:] != values[:-1]) | (end[1:] != end[:-1])), len(values) - 1)
            first = last[np.searchsorted(last, np.arange(len(values)))] + 1
        n = np.cumsum(end - first)
        while at < len(values):  # a long list has many elements after each one
            to = max(at + 1, int(np.searchsorted(n, (n[at - 1] if at else 0) + _HELD // 4, "right")))
            k = np.arange(at, to)[(end - first)[at:to] > 0]
            m = (end - first)[k]
            stop = np.cumsum(m)
            take = np.repeat(first[k] - (stop - m), m) + np.arange(stop[-1] if len(m) else 0)
            yield pa.RecordBatch.from_arrays([pa.array(values[k], pa.int32()), pa.ListArray.from_arrays(pa.array(np.append(0, stop), pa.int32()), pa.array(values[take], pa.int32()))], ["k", "tail"])
            at = to


def _added(keys, counts, more):
    import numpy as np

    new, n = np.unique(np.concatenate(more), return_counts=True)
    if keys is None:
        return new, n
    both = np.concatenate([keys, new])
    order = np.argsort(both, kind="stable")
    both, n = both[order], np.concatenate([counts, n])[order]
    start = np.flatnonzero(np.append(True, both[1:] != both[:-1]))
    return both[start], np.add.reduceat(n, start)


def _counter(least: int, top: int | None):
    def count(batches):
        """Rows (k, tail) of whole keys become rows (k, other, n)."""
        import numpy as np
        import pyarrow as pa

        keys, counts, more, held = None, None, [], 0
        for b in batches:
            x = b.column(1)
            more.append(np.repeat(np.asarray(b.column(0)).astype(np.int64) << 32, np.asarray(x.value_lengths())) | np.asarray(x.flatten()).astype(np.int64))
            held += len(more[-1])
            if held > _HELD:
                keys, counts = _added(keys, counts, more)
                more, held = [], 0
        if more:
            keys, counts = _added(keys, counts, more)
        if keys is None:
            return
        bound = least
        if top is not None and len(counts) > top:
            bound = max(least, int(np.partition(counts, len(counts) - top)[len(counts) - top]))
        if bound > 1:
            keys, counts = keys[counts >= bound], counts[counts >= bound]
        for at in range(0, len(keys), 1 << 16):
            k, n = keys[at : at + (1 << 16)], counts[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(k >> 32, pa.int32()), pa.array(k & 0xFFFFFFFF, pa.int32()), pa.array(n, pa.int64())], ["k", "other", "n"])

    return count


def co_counts(df: DataFrame, group: str, key: str, least: int = 1, top: int | None = None, repeats: bool = False) -> DataFrame:
    """(k, other, n), k < other: in how many groups both keys are, if in ``least`` or more.

    With ``repeats`` equal rows count each by each, otherwise once. With ``top`` each task keeps its pairs down to its
    ``top``-th greatest count with all that tie, so no pair is missing that reaches the ``top``-th greatest of all.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType
    collect = F.collect_list if repeats else F.collect_set
    one = df.select(F.col(group).alias("g"), F.col(key).alias("k")).where("g is not null and k is not null")
    lists = stored(one.groupBy("g").agg(F.sort_array(collect("k")).alias("all")).where(F.size("all") > 1).select("all"), "lists")
    release(spark)
    n = F.size("all").cast("double")
    whole = isinstance(kind, T.IntegralType)
    seen = lists.agg(F.sum(n * (n - 1) / 2).alias("n"), *([F.min(F.element_at("all", 1)).alias("low"), F.max(F.element_at("all", -1)).alias("high")] if whole else [])).first()
    parts = max(math.ceil((seen["n"] or 0) / _TASK), min(spark.sparkContext.defaultParallelism, math.ceil((seen["n"] or 0) / 50_000)), 1)
    if whole and (seen["n"] is None or (seen["low"] >= 0 and seen["high"] < 1 << 31)):
        ship(spark)
        tails = lists.select(F.col("all").cast("array<int>").alias("all")).mapInArrow(_tails, "k int, tail array<int>")
        out = tails.repartition(parts, "k").mapInArrow(_counter(least, top), "k int, other int, n long")
        return out.select(F.col("k").cast(kind).alias("k"), F.col("other").cast(kind).alias("other"), "n")
    tails = lists.select("all", F.posexplode("all").alias("p", "k")).select("k", F.slice("all", F.col("p") + 2, F.size("all")).alias("tail")).where(F.size("tail") > 0)
    out = tails.repartition(parts, "k").select("k", F.explode("tail").alias("other")).where("k <> other").groupBy("k", "other").agg(F.count("*").alias("n"))
    return out.where(F.col("n") >= least) if least > 1 else out
