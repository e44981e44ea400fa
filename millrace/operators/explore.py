"""Counts, top-k, joins, set operations and partition studies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def summary(df: DataFrame, user: str, item: str, date: str, year: int) -> DataFrame:
    """One row: n_rows, n_year, n_user, n_item in one pass."""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(F.year(date) == year).alias("n_year"), F.count_distinct(user).alias("n_user"), F.count_distinct(item).alias("n_item"))


def top_k(df: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The k most frequent keys with their counts; ties by key. Plans as TakeOrderedAndProject over partial counts."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def average_by(fact: DataFrame, dim: DataFrame, on: str, group: str, value: str, digits: int = 6) -> DataFrame:
    """Mean of a fact's value by a dimension's attribute, highest first.

    The fact is reduced to (sum, count) for each join key before the join, so the join moves one row a key.
    """
    part = fact.groupBy(on).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    out = part.join(dim.select(on, group), on).groupBy(group).agg(F.round(F.sum("_s") / F.sum("_n"), digits).alias("average"), F.sum("_n").alias("n"))
    return out.orderBy(F.desc("average"), group)


def dict_encode(df: DataFrame, key: str, index: str = "idx") -> DataFrame:
    """(key, idx): the rank of each distinct key from 0.

    Keys are range-partitioned; a partition's offset is the size of those before it (one row a partition), so no
    task sees more than its range.
    """
    d = df.select(key).where(F.col(key).isNotNull()).distinct().repartitionByRange(key).withColumn("_p", F.spark_partition_id())
    sizes = d.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    ranked = d.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(key)) - 1)
    return ranked.join(before, "_p").select(key, (F.col("_r") + F.col("_before")).cast("long").alias(index))


def split_train_test(df: DataFrame, is_test: Column) -> tuple[DataFrame, DataFrame]:
    return df.where(~is_test), df.where(is_test)


def partition_sizes(df: DataFrame, n: int, key: Column | None = None) -> DataFrame:
    """(partition, n) rows of a hash partitioning by key (or round robin)."""
    p = df.repartition(n, key) if key is not None else df.repartition(n)
    return p.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"))


def custom_partition_sizes(df: DataFrame, key: Column, n: int) -> DataFrame:
    """Rows in each partition if ``key mod n`` names it."""
    return df.groupBy(F.pmod(key, F.lit(n)).cast("int").alias("partition")).agg(F.count("*").alias("n"))
