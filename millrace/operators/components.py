"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u").toDF("u", "v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).where("u <> v").distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", checkpoint=None, max_rounds: int = 60) -> DataFrame:
    """(node, component) with the smallest node of each component, for nodes that have an edge to another.

    Each round is two star contractions (group minimum and join); rounds grow with the logarithm of the
    component's size. ``checkpoint`` cuts the lineage of a round's edges (default: ``DataFrame.checkpoint``,
    which needs a shared checkpoint folder). Null ends and self-loops are dropped.
    """
    cut = checkpoint or (lambda df: df.checkpoint())
    e = cut(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct())
    mark = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    state = mark(e)
    for _ in range(max_rounds):
        if not state[0]:
            break
        e = cut(_small_star(_large_star(e)))
        last, state = state, mark(e)
        if last == state:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
