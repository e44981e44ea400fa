"""A bit table of fixed size over keys: most rows that a join can't match need no shuffle.

The table has WORDS * 64 bits however many keys there are (1 MB), so it may always be broadcast. A key whose bit is
unset isn't among the keys; others go through the exact join. With more keys fewer rows are spared; results are the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 17


def _word(h: Column) -> Column:
    return F.pmod(h, F.lit(WORDS)).cast("int")


def _bit(h: Column) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 32), F.lit(64)).cast("int")


def sieve_bits(keys: DataFrame, h: Column) -> np.ndarray:
    """The bits of the keys' hashes ``h`` (long)."""
    bits = np.zeros(WORDS, np.int64)
    got = keys.select(_word(h).alias("w"), _bit(h).alias("b")).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("v")).toArrow()
    bits[got["w"].to_numpy()] = got["v"].to_numpy()
    return bits


def in_sieve(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes (unsigned) may be among the keys."""
    word = bits.view(np.uint64)[(h & np.uint64(WORDS - 1)).astype(np.int64)]
    return (word >> ((h >> np.uint64(32)) & np.uint64(63))) & np.uint64(1) > 0


def sieve(keys: DataFrame, h: Column) -> DataFrame:
    """One row with the bits of the keys' hashes."""
    return F.broadcast(keys.sparkSession.createDataFrame([(sieve_bits(keys, h).tolist(),)], "__mr_bits array<long>"))


def split(df: DataFrame, bits: DataFrame, h: Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose key may be among the keys, and rows whose key is not."""
    on = F.getbit(F.get(F.col("__mr_bits"), _word(h)), _bit(h))
    return tuple(df.join(bits, on == k).drop("__mr_bits") for k in (1, 0))


def anti_join(df: DataFrame, bad: DataFrame, h: Column, bad_h: Column, on: Column) -> DataFrame:
    """``df`` left-anti ``bad`` on ``on``; only rows that pass the sieve are shuffled. ``bad`` has distinct keys and is used twice: a table, best.

    An outer join and a filter, as the optimizer would push an anti join below the sieve.
    """
    maybe, rest = split(df, sieve(bad, bad_h), h)
    mark = bad.withColumn("__mr_found", F.lit(True))
    return rest.unionByName(maybe.join(mark, on, "left").where(F.col("__mr_found").isNull()).select(df.columns))
