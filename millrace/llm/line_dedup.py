"""Deletes later copies of repeated runs of lines, by winnowing over line hashes.

A text is the sequence of 128-bit hashes of its lines (without white space at
their ends; lines without words are left out). Winnowing slides a window over
it that has just enough lines for ``min_words`` words (from each line forward,
and to each line from behind), and selects the window's least hash, the first
of equal ones; most windows select the same line as their neighbours, so there
are at most as many fingerprints as lines. Two equal runs of ``min_words`` words
or more have equal windows, so a fingerprint in common: this is guaranteed.

Fingerprints are counted, and places whose fingerprint occurs more than once go
on. There, the match is extended on line hashes: to the left by each number of
lines for which the fingerprint stays the least, and from there to the right
until the run has ``min_words`` words. Equal extended runs are joined, and one
that starts later than the first of its kind (by document id, then line;
a run that overlaps the first in one text doesn't count) is deleted. A maximal
run is the union of such runs, whatever places it shares its parts with, so
lines are deleted exactly if they are in a run of ``min_words`` words or more
that is somewhere before.

Defined results: null and empty texts stay as they are. Lines without words
stay, unless a deleted run holds them. Rows with equal id and text are one
document and stay alike. Rows without an id come last. Texts that lose all
their words become empty; ``drop_empty`` removes such rows. Empty tables give
empty results; other columns pass through, n_chars is set anew.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ._sieve import in_sieve, sieve, sieve_bits, split
from ._store import drop_table, table
from ._text import Block, U64, blocks, mix, prefix_hash, span_hash

SALTS = 16
_OTHER = mix(np.arange(256, dtype=U64)).argsort().astype(np.uint8)  # a second hash is that of other bytes


def _lines(b: Block) -> tuple[np.ndarray, ...]:
    """Two hashes, words, text and number of each line that has a word."""
    s, e, _ = b.words()
    feed = np.flatnonzero(b.buf == 10)
    ls, le = feed[:-1] + 1, feed[1:]
    p, q = np.searchsorted(s, ls), np.searchsorted(s, le)
    doc = np.searchsorted(b.start, ls, "right") - 1
    number = np.arange(len(ls)) - np.searchsorted(ls, b.start)[doc]
    some = q > p
    p, q, doc, number = p[some], q[some], doc[some], number[some]
    return *(span_hash(prefix_hash(x), s[p], e[q - 1]) for x in (b.buf, _OTHER[b.buf])), q - p, doc, number


def winnow(h: np.ndarray, words: np.ndarray, doc: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last line of each distinct window, and the line that it selects (indices)."""
    n = len(h)
    total = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(total, total[:-1] + min_words)  # lines i to end - 1
    start = np.searchsorted(total, total[1:] - min_words, "right") - 1
    at = np.arange(n)
    ok = end <= n
    ok[ok] = doc[end[ok] - 1] == doc[at[ok]]
    ok2 = start >= 0
    ok2[ok2] = doc[start[ok2]] == doc[at[ok2]]
    a = np.concatenate([at[ok], start[ok2]])
    z = np.concatenate([end[ok] - 1, at[ok2]])
    pair = np.unique(a.astype(np.int64) * (n + 1) + z)
    a, z = pair // (n + 1), pair % (n + 1)
    least = np.empty(len(a), np.int64)
    for k, i in _by_size(z - a + 1):
        least[i] = a[i] + h[a[i, None] + np.arange(k)].argmin(axis=1)
    return a, z, least


def _by_size(size: np.ndarray):
    """(lines, some windows of so many lines), in parts of bounded size."""
    for k in np.unique(size).tolist():
        i = np.flatnonzero(size == k)
        step = max(1, (1 << 20) // k)
        yield from ((k, i[c : c + step]) for c in range(0, len(i), step))


def extend(h: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Hashes of the runs from line a to z."""
    code = np.zeros(len(a), U64)
    for k, i in _by_size(z - a + 1):
        for j in range(k):
            code[i] = mix(code[i] * U64(0x9E3779B97F4A7C15) + h[a[i] + j])
    return code


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """The columns h1, h2, words, number of all texts of a batch, and each line's text."""
    size = np.array([len(x) for x in batch.column("number")], np.int64)
    h1, h2, words, number = (batch.column(c).flatten().to_numpy() for c in ("h1", "h2", "words", "number"))
    return h1.view(U64), h2.view(U64), words, number, np.repeat(np.arange(len(size)), size)


def line_dedup(df: DataFrame, min_words: int = 25, doc_id: str = "doc_id", text: str = "text", drop_empty: bool = True) -> DataFrame:
    """``df`` without later copies of repeated runs of lines; the same columns."""
    spark = df.sparkSession
    ship(spark)
    keyed = df.withColumn("__mr_h", F.xxhash64(text))

    def read(batches):
        for batch in batches:
            for part, b in blocks(batch, "_t"):
                h1, h2, words, doc, number = _lines(b)
                first = np.searchsorted(doc, np.arange(b.n + 1))
                long = np.flatnonzero(np.bincount(doc, words, b.n) >= min_words)  # others have no window
                take = np.repeat(np.isin(np.arange(b.n), long), np.diff(first))
                cut = pa.array(np.concatenate([[0], np.cumsum(np.diff(first)[long])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(cut, pa.array(x[take])) for x in (h1.view(np.int64), h2.view(np.int64), words.astype(np.int32), number.astype(np.int32))]
                rows = pa.array(long)
                yield pa.RecordBatch.from_arrays([part.column(0).take(rows), part.column(1).take(rows), *lists], ["_id", "_h", "h1", "h2", "words", "number"])

    kind = dict(df.dtypes)[doc_id]
    src = keyed.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("_id"), F.col("__mr_h").alias("_h"), F.col(text).alias("_t"))
    lines, p_lines = table(src.mapInArrow(read, f"_id {kind}, _h long, h1 array<long>, h2 array<long>, words array<int>, number array<int>"), "lines")

    def fingerprints(batches):
        for batch in batches:
            h, _, words, _, doc = _flat(batch)
            f, n = np.unique(h[np.unique(winnow(h, words, doc, min_words)[2])], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(n)], ["f", "n"])

    twice = lines.mapInArrow(fingerprints, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).where("n > 1")
    bits = spark.sparkContext.broadcast(sieve_bits(twice, F.col("f")))  # of fixed size

    def runs(batches):
        for batch in batches:
            h, h2, words, number, doc = _flat(batch)
            a, z, least = winnow(h, words, doc, min_words)
            go = in_sieve(bits.value, h[least])
            a, z = a[go], z[go]
            rows = pa.array(doc[a])
            cols = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(extend(h, a, z).view(np.int64)), pa.array(extend(h2, a, z).view(np.int64)), pa.array(number[a]), pa.array(number[z])]
            yield pa.RecordBatch.from_arrays(cols, ["_id", "_h", "w1", "w2", "a", "z"])

    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    # one shuffle of the runs, which the count and the join both use; a run that many texts hold is split by a salt
    near = lines.mapInArrow(runs, f"_id {kind}, _h long, w1 long, w2 long, a int, z int").withColumn("salt", F.pmod(F.xxhash64("_h", "a"), F.lit(SALTS)).cast("int")).repartition("w1", "w2", "salt")
    place = F.struct(F.col("_id").isNull().alias("none"), "_id", "_h", "a", "z")
    some = near.groupBy("w1", "w2", "salt").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    first = some.groupBy("w1", "w2").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").select("w1", "w2", "first", salts.alias("salt"))
    same = F.col("first._id").eqNullSafe(F.col("_id")) & (F.col("first._h") == F.col("_h"))
    later = near.join(first, ["w1", "w2", "salt"]).where(~same | (F.col("a") > F.col("first.z")))
    gone = later.groupBy("_id", "_h").agg(F.array_distinct(F.flatten(F.collect_set(F.sequence("a", "z")))).alias("__mr_gone"))  # a text's own lines

    gone, _ = table(gone, "gone")
    drop_table(spark, p_lines)
    key = F.xxhash64(doc_id, "__mr_h")
    maybe, rest = split(keyed, sieve(gone, F.xxhash64("_id", "_h")), key)  # texts that lose nothing aren't shuffled
    joined = maybe.join(gone.withColumnsRenamed({"_id": "__mr_gid", "_h": "__mr_gh"}), F.col(doc_id).eqNullSafe(F.col("__mr_gid")) & (F.col("__mr_h") == F.col("__mr_gh")), "left").drop("__mr_gid", "__mr_gh", "__mr_h")
    cut = joined.withColumn(text, F.when(F.col("__mr_gone").isNull(), F.col(text)).otherwise(_without(F.col(text), F.col("__mr_gone"))))
    if drop_empty:
        cut = cut.where(F.col("__mr_gone").isNull() | F.col(text).rlike("[^ \\t-\\r]"))
    if "n_chars" in df.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("__mr_gone").isNull(), F.col("n_chars")).otherwise(F.length(text)))
    return cut.select(df.columns).unionByName(rest.select(df.columns))


def _without(text: F.Column, gone: F.Column) -> F.Column:
    """The text without the lines of these numbers."""
    lines = F.split(text, "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return F.array_join(F.transform(kept, lambda i: F.element_at(lines, i + 1)), "\n")
