"""MinHash signatures, banded candidates and exact Jaccard similarity of sets in (set_id, element) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import linear_hash
from ..session import release, ship, stored
from .blocks import compare, first_shared, sketched

#: (a, b) of h(x) = ((a x + b) mod PRIME) mod range.
COEFFICIENTS = [(1009 + 7919 * k, 104729 + 15485863 * k % 32452843) for k in range(30)]
PRIME = 2147483647
#: Sets of a bucket that one task pairs with all others of it.
SPLIT = 2048


def signatures(sets: DataFrame, coefficients=None, prime: int = PRIME, size: int = 1 << 30) -> DataFrame:
    """(set_id, h0, h1, ...): the least hash of each function over a set's elements, in one aggregation."""
    cs = coefficients or COEFFICIENTS
    return sets.groupBy("set_id").agg(*[F.min(linear_hash(F.col("element"), a, b, prime, size)).alias(f"h{k}") for k, (a, b) in enumerate(cs)])


def bands(sig: DataFrame, bands: int, rows: int) -> DataFrame:
    """(set_id, band, bucket): the rows of a signature that a band compares, as text."""
    each = [F.struct(F.lit(k).alias("band"), F.concat_ws("_", *[F.col(f"h{k * rows + j}").cast("string") for j in range(rows)]).alias("bucket")) for k in range(bands)]
    return sig.select("set_id", F.explode(F.array(*each)).alias("_b")).select("set_id", "_b.band", "_b.bucket")


def bucket_sizes(banded: DataFrame) -> DataFrame:
    return banded.groupBy("band", "bucket").agg(F.count("*").alias("n"), F.min("set_id").alias("first"))


def candidates(banded: DataFrame) -> DataFrame:
    """(a, b), a < b: sets that share a bucket. Buckets of one set are dropped first.

    A bucket's rows carry digests of all of their set's buckets (128 bits each), so that a pair is made only in the first
    band that it shares; large buckets are split by one of the two sets. Nothing is shuffled for a pair.
    """
    ship(banded.sparkSession)
    kind = banded.schema["set_id"].dataType.simpleString()
    digest = [F.struct("band", x.alias("h")) for x in (F.xxhash64("bucket"), F.xxhash64(F.lit("second"), "bucket"))]
    each = banded.groupBy("set_id").agg(*[F.transform(F.sort_array(F.collect_list(x)), lambda v: v["h"]).alias(n) for x, n in zip(digest, ("h", "g"))], F.sort_array(F.collect_list(F.struct("band", "bucket"))).alias("own"))
    rows = each.select("set_id", "h", "g", F.posexplode("own").alias("p", "o")).select("set_id", "h", "g", "p", "o.band", "o.bucket")
    rows = rows.join(bucket_sizes(banded).where("n > 1").select("band", "bucket", "n"), ["band", "bucket"])
    parts = F.ceil(F.col("n") / SPLIT).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("set_id"), parts).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = rows.select("band", "bucket", "part", (F.col("own") == F.col("part")).alias("left"), "p", "set_id", "h", "g", F.xxhash64("band", "bucket", "part").alias("cell"))
    keys = ["cell", "band", "bucket", "part"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "set_id").mapInArrow(first_shared, f"a {kind}, b {kind}")


def verify(whole: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs with Jaccard similarity >= threshold; sets (set_id, s) travel as arrays, once a pair."""
    joined = pairs.join(whole.select(F.col("set_id").alias("a"), F.col("s").alias("sa")), "a").join(whole.select(F.col("set_id").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return joined.withColumn("_i", both).withColumn("similarity", F.col("_i") / (F.size("sa") + F.size("sb") - F.col("_i"))).where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def in_a_bucket(pairs: DataFrame, sig: DataFrame, n_bands: int, n_rows: int) -> DataFrame:
    """The pairs that :func:`candidates` has, too: those whose signatures agree in a band."""
    h = [F.array(*[F.col(f"h{k * n_rows + j}") for j in range(n_rows)]) for k in range(n_bands)]
    s = sig.select("set_id", F.array(*h).alias("h"))
    both = pairs.join(s.toDF("a", "ha"), "a").join(s.toDF("b", "hb"), "b")
    return both.where(F.exists(F.zip_with("ha", "hb", lambda x, y: x == y), lambda x: x)).select(pairs.columns)


def similar_pairs(sets: DataFrame, n_bands: int = 15, n_rows: int = 2, threshold: float = 0.5) -> DataFrame:
    """Similar pairs that share a band's bucket: the exact join's pairs are far fewer than those in the buckets."""
    return in_a_bucket(jaccard_pairs(sets, threshold), signatures(sets), n_bands, n_rows)


def jaccard_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """The exact similarity join.

    Every two sets of fitting sizes are compared, in blocks, by sketches of a byte an element whose difference bounds the
    similarity from above; only pairs that may reach the threshold are rows, and these are verified on whole sets. The
    comparisons are the square of the number of sets, memory and shuffles grow with it. Exact.
    """
    spark, kind = sets.sparkSession, sets.schema["set_id"].dataType.simpleString()
    ship(spark)
    whole = stored(sets.groupBy("set_id").agg(F.collect_set(F.col("element").cast("long")).alias("s")), "sets")
    release(spark)
    k = max(1, min(16, whole.count() // 1000))
    sketches = whole.mapInArrow(sketched, f"set_id {kind}, n int, c int, bits binary").withColumn("own", F.pmod(F.xxhash64("set_id"), F.lit(k)).cast("int"))
    cells = sketches.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select((F.least("own", "other") * k + F.greatest("own", "other")).alias("cell"), (F.col("own") <= F.col("other")).alias("left"), "set_id", "n", "c", "bits")
    close = cells.repartition(k * k, "cell").groupBy("cell").applyInArrow(compare(threshold), f"a {kind}, b {kind}")
    close = stored(close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "close")
    release(spark)
    return verify(whole, close, threshold)


def precision_recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: n_found, n_truth, n_both, precision, recall."""
    both = found.select("a", "b", F.lit(1).alias("f")).join(truth.select("a", "b", F.lit(1).alias("t")), ["a", "b"], "full")
    out = both.agg(F.count("f").alias("n_found"), F.count("t").alias("n_truth"), F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("n_both"))
    return out.select("*", F.round(F.try_divide("n_both", "n_found"), 6).alias("precision"), F.round(F.try_divide("n_both", "n_truth"), 6).alias("recall"))
