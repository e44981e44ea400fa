"""The inputs of the named queries, as DataFrames and as SQL views of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import text_id
from ..operators import baskets as B
from ..operators import graph as G
from ..operators import sketches as K
from ..operators.cluster import points
from ..sources.tables import parquet
from .registry import WITH

SUPPORT = 0.0054
LEAST_EDGES = 100
BATCH = 100


def reviews(spark: SparkSession, d: str) -> DataFrame:
    """(u, i, q, d): customers' purchases of parts stand for reviews."""
    o = parquet(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("u"), F.col("o_orderdate").alias("d"))
    x = parquet(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("i"), F.col("l_quantity").alias("q"))
    return x.join(o, "o_orderkey").select("u", "i", "q", "d")


def ratings(spark, d) -> DataFrame:
    return reviews(spark, d).groupBy("u", "i").agg(F.max(1 + F.col("q").cast("long") % 5).cast("double").alias("s"))


def is_test():
    return (F.col("u") * 31 + F.col("i")) % 20 == 0


def train(spark, d) -> DataFrame:
    """Without the test pairs, and without all ratings of some users, who are cold."""
    return ratings(spark, d).where(~is_test() & (F.col("u") % 50 != 0))


def test(spark, d) -> DataFrame:
    return ratings(spark, d).where(is_test())


def basket_rows(spark, d) -> DataFrame:
    x = parquet(spark, d, "lineitem").select(F.col("l_orderkey").alias("basket"), "l_partkey")
    p = parquet(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("item"))
    return x.join(p, "l_partkey").select("basket", "item")


def baskets(spark, d, min_size: int = 0) -> DataFrame:
    return B.baskets(basket_rows(spark, d), "basket", "item", min_size)


def support(b: DataFrame) -> int:
    """A share of the number of baskets, so that every scale has frequent sets."""
    import math

    return math.ceil(round(SUPPORT * b.count(), 9))


def pairs(spark, d) -> DataFrame:
    return G.copairs(ratings(spark, d), "u", "i")


def edges(spark, d) -> DataFrame:
    """Co-purchase graph; materialised, as its queries are iterative."""
    return G._cut(G.top_edges(ratings(spark, d), "u", "i", LEAST_EDGES))


def stream(spark, d) -> DataFrame:
    return parquet(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("item"))


def batches(spark, d) -> DataFrame:
    return K.batches(stream(spark, d), "seq", "item", BATCH)


def doc_sets(spark, d) -> DataFrame:
    """(set_id, element): the distinct words of whole documents, as numbers."""
    w = parquet(spark, d, "documents").select(F.col("doc_id").alias("set_id"), F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).where("w <> ''")
    return w.select("set_id", text_id(F.col("w")).alias("element")).distinct()


def vectors(spark, d) -> DataFrame:
    return points(parquet(spark, d, "embeddings"), "vec_id", "embedding", "label")


WITH |= {
    "rv": "SELECT o_custkey AS u, l_partkey AS i, l_quantity AS q, o_orderdate AS d FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "r": "SELECT u, i, CAST(max(1 + CAST(floor(q) AS BIGINT) % 5) AS DOUBLE) AS s FROM rv GROUP BY u, i",
    "tr": "SELECT * FROM r WHERE (u * 31 + i) % 20 <> 0 AND u % 50 <> 0",
    "te": "SELECT * FROM r WHERE (u * 31 + i) % 20 = 0",
    "b": "SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey",
    "sup": f"SELECT CAST(ceil(round({SUPPORT} * count(DISTINCT basket), 9)) AS BIGINT) AS k FROM b",
    "f1": "SELECT item, count(*) AS n FROM b GROUP BY item HAVING count(*) >= (SELECT k FROM sup)",
    "fb": "SELECT b.* FROM b JOIN f1 USING (item)",
    "cp": "SELECT a.u AS u, c.u AS v, count(*) AS n FROM r a JOIN r c ON a.i = c.i AND a.u < c.u GROUP BY 1, 2",
    "th": f"SELECT max(n) AS t FROM (SELECT n, sum(count(*)) OVER (ORDER BY n DESC) AS c FROM cp GROUP BY n) WHERE c >= {LEAST_EDGES}",
    "e": "SELECT u, v FROM cp, th WHERE n >= t",
    "sy": "SELECT u, v FROM e UNION ALL SELECT v, u FROM e",
    "st": f"SELECT o_orderkey AS seq, o_custkey AS item, o_orderkey // {BATCH} AS batch FROM orders",
    "ds": r"SELECT DISTINCT set_id, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS element FROM (SELECT doc_id AS set_id, unnest(string_split_regex(lower(text), '\s+')) AS w FROM documents) WHERE w <> ''",
    "dn": "SELECT set_id, count(*) AS n FROM ds GROUP BY set_id",
    "pt": "SELECT vec_id AS id, label, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings",
    "cs": "SELECT label, dim, count(*) AS n, avg(x) AS m, stddev_pop(x) AS sd FROM pt GROUP BY label, dim",
}
