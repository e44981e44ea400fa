"""Frequent itemsets: A-Priori levels as joins and aggregates, and SON candidates."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def baskets(df: DataFrame, key: str, item: str, min_size: int = 0) -> DataFrame:
    """(basket, items): each key's distinct items in order; only those with more than ``min_size``."""
    out = df.where(F.col(key).isNotNull() & F.col(item).isNotNull()).groupBy(F.col(key).alias("basket")).agg(F.array_sort(F.collect_set(item)).alias("items"))
    return out.where(F.size("items") > min_size) if min_size else out


def _rows(b: DataFrame) -> DataFrame:
    return b.select("basket", F.explode("items").alias("item"))


def frequent_items(b: DataFrame, support: int) -> DataFrame:
    """(items, n): sets of one."""
    return _rows(b).groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= support).select(F.array("item").alias("items"), "n")


def next_level(b: DataFrame, level: DataFrame, support: int, size: int) -> DataFrame:
    """Frequent sets of ``size`` from those of ``size - 1``.

    Candidates extend a frequent set by a greater item with which the set's other members are frequent, too (all
    subsets are checked); they are counted by joining candidates to the baskets that hold their first two items.
    ``size`` is 3 or more.
    """
    prev = level.select("items")
    a = prev.select(F.slice("items", 1, size - 2).alias("prefix"), F.element_at("items", -1).alias("x"))
    z = a.withColumnRenamed("x", "y")
    # joined on the shared prefix: each pair of siblings once
    cand = a.join(z, "prefix").where("x < y").select(F.concat("prefix", F.array("x", "y")).alias("items"))
    if size > 2:
        subsets = cand.select("items", F.explode(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: F.filter("items", lambda v, i: i != k - 1))).alias("sub"))
        cand = subsets.join(prev.withColumnRenamed("items", "sub"), "sub", "left_semi").groupBy("items").agg(F.count("*").alias("k")).where(F.col("k") == size).select("items")
    # baskets of frequent items only; each pair in one meets the candidates that begin with it
    keep = prev.select(F.explode("items").alias("item")).distinct()
    slim = _rows(b).join(keep, "item", "left_semi").groupBy("basket").agg(F.array_sort(F.collect_set("item")).alias("all")).where(F.size("all") >= size)
    held = slim.select("all", F.posexplode("all").alias("p", "x")).select("x", F.slice("all", F.col("p") + 2, F.size("all")).alias("after"))
    held = held.select("x", F.posexplode("after").alias("p", "y"), "after").select("x", "y", F.slice("after", F.col("p") + 2, F.size("after")).alias("rest")).where(F.size("rest") >= size - 2)
    first = cand.select("items", F.element_at("items", 1).alias("x"), F.element_at("items", 2).alias("y"), F.slice("items", 3, size).alias("more"))
    fits = F.array_contains("rest", F.element_at("items", -1)) if size == 3 else F.size(F.array_except("more", "rest")) == 0
    return held.join(first, ["x", "y"]).where(fits).groupBy("items").agg(F.count("*").alias("n")).where(F.col("n") >= support)


def frequent_pairs(b: DataFrame, support: int) -> DataFrame:
    """Pairs, counted inside each basket after infrequent items have gone (A-Priori)."""
    keep = frequent_items(b, support).select(F.element_at("items", 1).alias("item"))
    slim = _rows(b).join(keep, "item", "left_semi").groupBy("basket").agg(F.array_sort(F.collect_set("item")).alias("items"))
    pairs = slim.select(F.explode(_combinations2(F.col("items"))).alias("items"))
    return pairs.groupBy("items").agg(F.count("*").alias("n")).where(F.col("n") >= support)


def _combinations2(items):
    """All ordered pairs of an array's elements."""
    at = F.sequence(F.lit(1), F.size(items))
    return F.flatten(F.transform(at, lambda i: F.transform(F.slice(items, i + 1, F.size(items)), lambda y: F.array(F.element_at(items, i), y))))


def frequent_itemsets(b: DataFrame, support: int, cut=None) -> DataFrame:
    """(size, items, n) of every size, level by level until a level is empty.

    ``cut`` materialises a level (default: ``DataFrame.checkpoint``), so plans stay short.
    """
    cut = cut or (lambda df: df.checkpoint())
    level = cut(frequent_items(b, support))
    out = level.withColumn("size", F.lit(1))
    for size in count(2):
        level = cut(frequent_pairs(b, support) if size == 2 else next_level(b, level, support, size))
        if level.isEmpty():
            break
        out = out.unionByName(level.withColumn("size", F.lit(size)))
    return out.select("size", "items", "n")


def son_candidates(b: DataFrame, support: int, parts: int, part=None, max_size: int = 1) -> DataFrame:
    """(items, locals): sets of up to ``max_size`` items that reach their share of the support in some part of the baskets.

    Each part's threshold is support * (its baskets) / (all baskets), so every frequent set is among them. ``part``: a
    column from 0 to ``parts`` - 1; by default from a hash of the basket.
    """
    part = F.pmod(F.xxhash64("basket"), F.lit(parts)) if part is None else part
    p = b.withColumn("part", part)
    sizes = p.groupBy("part").agg(F.count("*").alias("own"))
    total = sizes.agg(F.sum("own").alias("total"))
    share = F.broadcast(sizes.join(F.broadcast(total)))  # `parts` rows
    enough = F.col("n") * F.col("total") >= F.lit(support) * F.col("own")
    local = p.select("part", "basket", F.explode("items").alias("item")).groupBy("part", "item").agg(F.count("*").alias("n"))
    level = local.join(share, "part").where(enough).select("part", F.array("item").alias("items"))
    out = level
    for size in range(2, max_size + 1):
        a = level.select("part", F.slice("items", 1, size - 2).alias("prefix"), F.element_at("items", -1).alias("x"))
        cand = a.join(a.withColumnRenamed("x", "y"), ["part", "prefix"]).where("x < y").select("part", F.concat("prefix", F.array("x", "y")).alias("set"))
        first = cand.select("part", "set", F.element_at("set", 1).alias("k1"), F.element_at("set", 2).alias("k2"))
        held = p.select("part", "items", F.posexplode("items").alias("at", "k1")).select("part", "items", "k1", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("k2"))
        n = held.join(first, ["part", "k1", "k2"]).where(F.size(F.array_except("set", "items")) == 0).groupBy("part", "set").agg(F.count("*").alias("n"))
        level = n.join(share, "part").where(enough).select("part", F.col("set").alias("items"))
        out = out.unionByName(level)
    return out.groupBy("items").agg(F.count("*").alias("locals"))


def retail_rows(df: DataFrame, date: str, customer: str, product: str) -> DataFrame:
    """(basket, item): short date and customer without leading zeros, product without leading zeros."""
    from ..functions.expr import short_date, strip_zeros

    return df.select(F.concat_ws("-", short_date(F.col(date)), strip_zeros(F.col(customer))).alias("basket"), strip_zeros(F.col(product)).alias("item"))


def report_lines(sets: DataFrame) -> DataFrame:
    """One line a size: ('a', 'b'),('c', 'd') in order; for reports of results that fit a line."""
    item = F.concat(F.lit("('"), F.array_join("items", "', '"), F.lit("')"))
    return sets.groupBy(F.size("items").alias("size")).agg(F.array_join(F.sort_array(F.collect_list(item)), ",").alias("line")).orderBy("size")
