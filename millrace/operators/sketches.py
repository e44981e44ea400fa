"""Stream sketches in batch form, on rows (seq, item) with seq from 0; a batch is seq div size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import linear_hash, trailing_zeros

COEFFICIENTS = [(104729, 7919), (130363, 1299709), (15485, 32452), (86028, 49979), (67867, 15487)]
PRIME = 2333333


def batches(df: DataFrame, seq: str, item: str, size: int) -> DataFrame:
    """(batch, seq, item) by count-based tumbling windows."""
    return df.select(F.floor(F.col(seq) / size).cast("long").alias("batch"), F.col(seq).alias("seq"), F.col(item).alias("item"))


def batch_distinct(b: DataFrame) -> DataFrame:
    return b.groupBy("batch").agg(F.count("*").alias("n"), F.count_distinct("item").alias("n_distinct"))


def hll_distinct(b: DataFrame, rsd: float = 0.02) -> DataFrame:
    """Per batch, and mergeable: the union of all batches' sketches as batch -1."""
    sk = b.groupBy("batch").agg(F.hll_sketch_agg("item", 12).alias("s"))
    return sk.select("batch", F.hll_sketch_estimate("s").alias("estimate")).union(sk.agg(F.lit(-1).cast("long"), F.hll_sketch_estimate(F.hll_union_agg("s"))))


def cumulative_distinct(b: DataFrame) -> DataFrame:
    """(batch, new_items, total): items first seen in a batch, and the running total. The window is over one row a batch."""
    first = b.groupBy("item").agg(F.min("batch").alias("batch"))
    new = b.select("batch").distinct().join(first.groupBy("batch").agg(F.count("*").alias("new_items")), "batch", "left").fillna(0, ["new_items"])
    return new.withColumn("total", F.sum("new_items").over(Window.orderBy("batch")))


def bloom_fpr(b: DataFrame, size: int, coefficients=None, prime: int = PRIME) -> DataFrame:
    """(batch, n, positives, false_positives, fpr) of a Bloom filter that tests a batch before it adds it.

    A bit is set from the batch after the first that hits it, so an item is positive in batch t if the latest of
    its bits' first batches is before t; it was seen if its own first batch is. The filter is a table of at most
    ``size`` rows, and exact truth a table of first batches: no sequential state. fpr is null where its
    denominator is 0.
    """
    cs = coefficients or COEFFICIENTS
    k = len(cs)
    first = b.groupBy("item").agg(F.min("batch").alias("first"))
    pos = first.select("item", "first", F.explode(F.array(*[linear_hash(F.col("item"), a, c, prime, size) for a, c in cs])).alias("bit"))
    bits = pos.groupBy("bit").agg(F.min("first").alias("set_in"))
    known = pos.join(bits, "bit").groupBy("item").agg(F.max("set_in").alias("set_in"), F.first("first").alias("first"))
    t = b.groupBy("batch", "item").agg(F.count("*").alias("n")).join(known, "item")
    positive, seen = F.col("set_in") < F.col("batch"), F.col("first") < F.col("batch")
    zero = F.lit(0).cast("long")
    out = t.groupBy("batch").agg(F.sum("n").alias("n"), F.sum(F.when(positive, F.col("n")).otherwise(zero)).alias("positives"), F.sum(F.when(positive & ~seen, F.col("n")).otherwise(zero)).alias("false_positives"))
    return out.withColumn("fpr", F.round(F.try_divide("false_positives", F.col("n") - F.col("positives") + F.col("false_positives")), 6))


def flajolet_martin(b: DataFrame, size: int, coefficients=None, prime: int = PRIME) -> DataFrame:
    """(batch, truth, estimate): mean over the hashes of 2 to the most trailing zeros, beside the exact count."""
    cs = coefficients or COEFFICIENTS
    r = [F.max(trailing_zeros(linear_hash(F.col("item"), a, c, prime, size))).alias(f"r{k}") for k, (a, c) in enumerate(cs)]
    t = b.groupBy("batch", "item").count().groupBy("batch").agg(F.count("*").alias("truth"), *r)
    return t.select("batch", "truth", F.round(sum(F.pow(F.lit(2.0), F.col(f"r{k}")) for k in range(len(cs))) / len(cs)).cast("long").alias("estimate"))


def fm_ratio(fm: DataFrame) -> DataFrame:
    return fm.agg(F.round(F.sum("estimate") / F.sum("truth"), 6).alias("ratio"))


def _draws(df: DataFrame, seq: str, item: str, size: int) -> DataFrame:
    """(n, item, slot) of the arrivals that enter a reservoir; n counts from 1, its draws are arithmetic hashes of n."""
    n = F.col(seq) + 1
    draw = linear_hash(n, 48271, 11, 2147483647, 1000003)
    slot = linear_hash(n, 69621, 7, 2147483647, size)
    return df.select(n.alias("n"), F.col(item).alias("item"), F.when(n <= size, n - 1).otherwise(slot).alias("slot"), draw.alias("draw")).where((F.col("n") <= size) | (F.col("draw") * F.col("n") < F.lit(size) * 1000003)).drop("draw")


def reservoir(df: DataFrame, seq: str, item: str, size: int) -> DataFrame:
    """(slot, item, n): the sample after the whole stream; a slot's last accepted arrival, by one aggregation."""
    return _draws(df, seq, item, size).groupBy("slot").agg(F.max_by("item", "n").alias("item"), F.max("n").alias("n"))


def reservoir_trace(df: DataFrame, seq: str, item: str, size: int, every: int, slots: list[int]) -> DataFrame:
    """(n, s_<slot> ...): some slots after each batch of ``every`` arrivals.

    An arrival belongs to the batch that it falls in; a slot's content after a batch is its last arrival so far:
    a running last value over one row a batch and slot.
    """
    a = _draws(df, seq, item, size).where(F.col("slot").isin(slots)).withColumn("b", F.ceil(F.col("n") / every).cast("long") * every)
    per = a.groupBy("slot", "b").agg(F.max_by("item", "n").alias("item"))
    ends = df.select((F.ceil((F.col(seq) + 1) / every).cast("long") * every).alias("b")).distinct()
    grid = ends.select("b", F.explode(F.array(*map(F.lit, slots))).alias("slot"))
    run = grid.join(per, ["b", "slot"], "left").withColumn("item", F.last("item", True).over(Window.partitionBy("slot").orderBy("b")))
    return run.groupBy(F.col("b").alias("n")).agg(*[F.max(F.when(F.col("slot") == k, F.col("item"))).alias(f"s_{k}") for k in slots])
