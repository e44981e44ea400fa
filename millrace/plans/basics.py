"""Exploration, scans, scalar functions, filters, joins, partitions, baskets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as X
from ..operators import baskets as B
from ..operators import explore as E
from ..operators import recommend as R
from ..session import shared_dir
from ..sources import tables as S
from . import views as V
from .registry import SQL, query, sql


@query("SELECT count(*) AS n_rows, count(*) FILTER (year(d) = 1998) AS n_year, count(DISTINCT u) AS n_user, count(DISTINCT i) AS n_item FROM rv", "rv")
def explore_summary(spark, d):
    return E.summary(V.reviews(spark, d), "u", "i", "d", 1998)


@query("SELECT count(*) AS n FROM orders WHERE year(o_orderdate) = 1998")
def filter_year_count(spark, d):
    return S.parquet(spark, d, "orders").where((F.col("o_orderdate") >= "1998-01-01") & (F.col("o_orderdate") < "1999-01-01")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey AS u, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 ORDER BY n DESC, u LIMIT 10")
def top10_users(spark, d):
    return E.top_k(V.reviews(spark, d), "u")


@query("SELECT l_partkey AS i, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1 ORDER BY n DESC, i LIMIT 10")
def top10_items(spark, d):
    return E.top_k(V.reviews(spark, d), "i")


@query("SELECT p_brand AS city, round(sum(l_quantity) / count(l_quantity), 6) AS average, count(l_quantity) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def avg_by_city_join(spark, d):
    fact = S.parquet(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_quantity").alias("stars"))
    dim = S.parquet(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("city"))
    return E.average_by(fact, dim, "k", "city", "stars")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def scan_json_field(spark, d):
    return S.parquet(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_csv_roundtrip(spark, d):
    """Written as CSV with header to the shared folder and read again with its schema."""
    t = S.parquet(spark, d, "customer")
    path = f"{shared_dir(spark)}/csv-{abs(hash(d))}"
    S.write_csv(t, path)
    return S.read_csv(spark, path, t.schema)


@query("SELECT vec_id AS id, label, len(embedding) AS dims, round(list_sum([CAST(x AS DOUBLE) for x in embedding]), 4) AS total FROM embeddings")
def points_scan(spark, d):
    return V.vectors(spark, d).select("id", "label", F.size("point").alias("dims"), F.round(F.aggregate("point", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT c_custkey, substr(c_name, 1, 4) AS prefix, string_split(c_name, '#')[2] AS tail, regexp_replace(string_split(c_name, '#')[2], '^0+', '') AS stripped, c_name LIKE 'Cust%' AS starts, replace(c_name, '#', '-') AS replaced, concat_ws(',', c_name, c_mktsegment) AS joined, ascii(c_mktsegment) AS code, trim(c_mktsegment, 'A') AS trimmed, hex(c_mktsegment) AS hexed FROM customer")
def str_functions(spark, d):
    name, seg = F.col("c_name"), F.col("c_mktsegment")
    tail = F.get(F.split(name, "#"), 1)
    return S.parquet(spark, d, "customer").select("c_custkey", F.substring(name, 1, 4).alias("prefix"), tail.alias("tail"), X.strip_zeros(tail).alias("stripped"), F.startswith(name, F.lit("Cust")).alias("starts"), F.replace(name, F.lit("#"), F.lit("-")).alias("replaced"), F.concat_ws(",", name, seg).alias("joined"), F.ascii(seg).alias("code"), F.btrim(seg, F.lit("A")).alias("trimmed"), F.hex(seg).alias("hexed"))


@query("SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS dev, round(sqrt(l_extendedprice), 5) AS root, power(l_quantity, 2) AS sq, round(l_discount * 100, 0) AS pct, least(l_quantity, 10) AS low, greatest(l_quantity, 10) AS high, ((31 * l_partkey + 7) % 1009) % 97 AS h, bin(l_partkey) AS bits FROM lineitem")
def math_functions(spark, d):
    q = F.col("l_quantity")
    return S.parquet(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.abs(q - 25).alias("dev"), F.round(F.sqrt("l_extendedprice"), 5).alias("root"), F.pow(q, F.lit(2)).alias("sq"), F.round(F.col("l_discount") * 100, 0).alias("pct"), F.least(q, F.lit(10.0)).alias("low"), F.greatest(q, F.lit(10.0)).alias("high"), X.linear_hash(F.col("l_partkey"), 31, 7, 1009, 97).alias("h"), F.bin("l_partkey").alias("bits"))


@query("SELECT o_orderkey, year(o_orderdate) AS y, strftime(o_orderdate, '%-m/%-d/%y') AS short, date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS days FROM orders")
def date_functions(spark, d):
    t = F.col("o_orderdate")
    return S.parquet(spark, d, "orders").select("o_orderkey", F.year(t).cast("long").alias("y"), X.short_date(t).alias("short"), F.datediff(F.lit("1999-01-01").cast("date"), t).cast("long").alias("days"))


@query("SELECT c_custkey, CAST(coalesce(n, 0) AS BIGINT) * coalesce(n, 0) AS fans_sq, CAST(coalesce(k, 0) AS BIGINT) * coalesce(k, 0) AS n_friends_sq, date_diff('day', f, DATE '1999-01-01') AS days_member FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS k, CAST(min(o_orderdate) AS DATE) AS f FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def derived_features(spark, d):
    o = S.parquet(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("fans"), F.array_join(F.collect_set("o_orderpriority"), ",").alias("friends"), F.date_format(F.min("o_orderdate"), "yyyy-MM-dd").alias("yelping_since"))
    t = S.parquet(spark, d, "customer").select("c_custkey").join(o, "c_custkey", "left").fillna({"fans": 0, "friends": "None"})
    return R.user_features(t, "1999-01-01").select("c_custkey", "fans_sq", "n_friends_sq", F.col("days_member").cast("long").alias("days_member"))


@query("SELECT l_orderkey, l_linenumber, least(5.0, greatest(1.0, l_quantity / 8)) AS stars FROM lineitem")
def clip_prediction(spark, d):
    return S.parquet(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.clip(F.col("l_quantity") / 8, 1, 5).alias("stars"))


@query("SELECT strftime(o_orderdate, '%-m/%-d/%y') || '-' || regexp_replace(lpad(CAST(o_custkey AS VARCHAR), 8, '0'), '^0+', '') AS basket, regexp_replace(lpad(CAST(l_partkey AS VARCHAR), 10, '0'), '^0+', '') AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def basket_preprocess(spark, d):
    t = V.reviews(spark, d).select("d", F.lpad(F.col("u").cast("string"), 8, "0").alias("c"), F.lpad(F.col("i").cast("string"), 10, "0").alias("p"))
    return B.retail_rows(t, "d", "c", "p")


_H = V.K.COEFFICIENTS


@query("SELECT c_custkey, " + ", ".join(f"(({a} * c_custkey + {b}) % 2333333) % 69997 AS h{k}" for k, (a, b) in enumerate(_H)) + " FROM customer")
def hash_values(spark, d):
    t = S.parquet(spark, d, "customer").select("c_custkey", X.hash_values(F.col("c_custkey"), _H, 2333333, 69997).alias("h"))
    return t.select("c_custkey", *[F.col("h")[k].alias(f"h{k}") for k in range(len(_H))])


_DAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


@query("SELECT o_custkey, " + ", ".join(f"max(CASE WHEN dayname(o_orderdate) = '{x}' THEN 1 ELSE 0 END) AS open_{x[:3].lower()}" for x in _DAYS) + " FROM orders GROUP BY 1")
def weekday_flags(spark, d):
    t = S.parquet(spark, d, "orders").select("o_custkey", F.date_format("o_orderdate", "EEEE").alias("day")).distinct()
    hours = t.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("day", F.lit("0:0-0:0")))).alias("hours"))
    return R.weekday_flags(hours, "hours").drop("hours")


@query("SELECT u, row_number() OVER (ORDER BY u) - 1 AS idx FROM (SELECT DISTINCT o_custkey AS u FROM orders)")
def dict_encode(spark, d):
    return E.dict_encode(S.parquet(spark, d, "orders").select(F.col("o_custkey").alias("u")), "u")


@query("SELECT * FROM te WHERE u IN (SELECT u FROM tr)", "rv", "r", "tr", "te")
def semi_join_known_users(spark, d):
    return V.test(spark, d).join(V.train(spark, d).select("u"), "u", "left_semi").select("u", "i", "s")


@query("SELECT * FROM te WHERE u NOT IN (SELECT u FROM tr)", "rv", "r", "tr", "te")
def anti_join_cold(spark, d):
    return V.test(spark, d).join(V.train(spark, d).select("u"), "u", "left_anti").select("u", "i", "s")


@query("SELECT u, i, c_acctbal, p_size FROM te LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON u = c_custkey LEFT JOIN (SELECT * FROM part WHERE p_size > 10) ON i = p_partkey", "rv", "r", "te")
def left_join_features(spark, d):
    c = S.parquet(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("u"), "c_acctbal")
    p = S.parquet(spark, d, "part").where("p_size > 10").select(F.col("p_partkey").alias("i"), "p_size")
    return V.test(spark, d).join(c, "u", "left").join(p, "i", "left").select("u", "i", "c_acctbal", "p_size")


@query("SELECT i, count(*) AS n FROM r GROUP BY i HAVING count(*) >= 25", "rv", "r")
def having_support(spark, d):
    return V.ratings(spark, d).groupBy("i").agg(F.count("*").alias("n")).where("n >= 25")


@query("SELECT basket, count(*) AS n FROM b GROUP BY basket HAVING count(*) > 3", "b")
def basket_size_filter(spark, d):
    return V.baskets(spark, d, 3).select("basket", F.size("items").cast("long").alias("n"))


@query("SELECT basket, item FROM b", "b")
def explode_items(spark, d):
    return V.baskets(spark, d).select("basket", F.explode("items").alias("item"))


@query("SELECT u FROM tr UNION SELECT u FROM te", "rv", "r", "tr", "te")
def all_user_ids(spark, d):
    return V.train(spark, d).select("u").union(V.test(spark, d).select("u")).distinct()


@query("SELECT u, i FROM r EXCEPT SELECT u, i FROM te", "rv", "r", "te")
def known_minus_test(spark, d):
    return V.ratings(spark, d).select("u", "i").exceptAll(V.test(spark, d).select("u", "i"))


_SETS = "SELECT o_custkey AS u, list_sort(list_distinct(list(year(o_orderdate)))) AS a, list_sort(list_distinct(list(1990 + month(o_orderdate)))) AS c FROM orders GROUP BY 1"


@query(f"SELECT u, array_to_string(list_sort(list_intersect(a, c)), ',') AS both, array_to_string(list_sort(list_distinct(list_concat(a, c))), ',') AS any, array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(c, x))), ',') AS only_a, list_contains(a, 1995) AS has_1995, len(a) AS n FROM ({_SETS})")
def array_set_ops(spark, d):
    o = S.parquet(spark, d, "orders").groupBy(F.col("o_custkey").alias("u")).agg(F.collect_set(F.year("o_orderdate")).alias("a"), F.collect_set(F.month("o_orderdate") + 1990).alias("c"))
    text = lambda x: F.array_join(F.array_sort(x), ",")
    return o.select("u", text(F.array_intersect("a", "c")).alias("both"), text(F.array_union("a", "c")).alias("any"), text(F.array_except("a", "c")).alias("only_a"), F.array_contains("a", 1995).alias("has_1995"), F.size("a").cast("long").alias("n"))


@query()
def partition_sizes(spark, d):
    return E.partition_sizes(V.reviews(spark, d), 8, F.col("i"))


@query("SELECT CAST(ascii(p_name) % 8 AS INTEGER) AS partition, count(*) AS n FROM part GROUP BY 1")
def custom_partition_sizes(spark, d):
    return E.custom_partition_sizes(S.parquet(spark, d, "part"), F.ascii("p_name"), 8)


@query("SELECT basket, array_to_string(list_sort(list(item)), ',') AS items FROM b GROUP BY basket", "b")
def baskets(spark, d):
    return V.baskets(spark, d).select("basket", F.array_join("items", ",").alias("items"))


def _shown(t):
    return t.select(F.array_join("items", ",").alias("items"), "n")


@query("SELECT item AS items, n FROM f1", "b", "sup", "f1")
def frequent_items(spark, d):
    b = V.baskets(spark, d)
    return _shown(B.frequent_items(b, V.support(b)))


_F2 = "SELECT x.item || ',' || y.item AS items, count(*) AS n FROM fb x JOIN fb y ON x.basket = y.basket AND x.item < y.item GROUP BY 1 HAVING count(*) >= (SELECT k FROM sup)"
_F3 = "SELECT x.item || ',' || y.item || ',' || z.item AS items, count(*) AS n FROM fb x JOIN fb y ON x.basket = y.basket AND x.item < y.item JOIN fb z ON y.basket = z.basket AND y.item < z.item GROUP BY 1 HAVING count(*) >= (SELECT k FROM sup)"
_F4 = "SELECT x.item || ',' || y.item || ',' || z.item || ',' || w.item AS items, count(*) AS n FROM fb x JOIN fb y ON x.basket = y.basket AND x.item < y.item JOIN fb z ON y.basket = z.basket AND y.item < z.item JOIN fb w ON z.basket = w.basket AND z.item < w.item GROUP BY 1 HAVING count(*) >= (SELECT k FROM sup)"
_FB = ("b", "sup", "f1", "fb")


@query(_F2, *_FB)
def frequent_pairs(spark, d):
    b = V.baskets(spark, d)
    return _shown(B.frequent_pairs(b, V.support(b)))


@query(_F3, *_FB)
def frequent_triples(spark, d):
    b = V.baskets(spark, d)
    k = V.support(b)
    return _shown(B.next_level(b, B.frequent_pairs(b, k), k, 3))


_ALL = f"SELECT 1 AS size, item AS items, n FROM f1 UNION ALL SELECT 2, * FROM ({_F2}) UNION ALL SELECT 3, * FROM ({_F3}) UNION ALL SELECT 4, * FROM ({_F4})"


@query(_ALL, *_FB)
def frequent_itemsets(spark, d):
    b = V.baskets(spark, d)
    return B.frequent_itemsets(b, V.support(b)).select("size", F.array_join("items", ",").alias("items"), "n")


@query()
def frequent_itemsets_filtered(spark, d):
    b = V.baskets(spark, d, 3)
    return B.frequent_itemsets(b, V.support(b)).select("size", F.array_join("items", ",").alias("items"), "n")


_B3 = "b3 AS MATERIALIZED (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey), b AS MATERIALIZED (SELECT * FROM b3 WHERE basket IN (SELECT basket FROM b3 GROUP BY basket HAVING count(*) > 3))"
SQL["frequent_itemsets_filtered"] = sql(_ALL, *_FB).replace(sql("", "b")[len("WITH RECURSIVE ") : -1], _B3)


_SON = """SELECT items, count(*) AS locals FROM (
SELECT basket % 4 AS part, item AS items, count(*) AS n FROM b GROUP BY 1, 2
UNION ALL SELECT x.basket % 4, x.item || ',' || y.item, count(*) FROM b x JOIN b y ON x.basket = y.basket AND x.item < y.item GROUP BY 1, 2)
JOIN (SELECT basket % 4 AS part, count(DISTINCT basket) AS own FROM b GROUP BY 1) USING (part)
WHERE n * (SELECT count(DISTINCT basket) FROM b) >= (SELECT k FROM sup) * own GROUP BY items"""


@query(_SON, "b", "sup")
def son_candidates(spark, d):
    """All candidates of one and two items, with the number of parts that propose each."""
    b = V.baskets(spark, d)
    cand = B.son_candidates(b, V.support(b), 4, F.pmod(F.col("basket"), F.lit(4)), max_size=2)
    return cand.select(F.array_join("items", ",").alias("items"), "locals")
