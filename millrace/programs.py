"""Batch programs over files: ``python -m millrace.programs NAME ARGUMENTS`` (``--help`` lists them)."""

from __future__ import annotations

import inspect
import sys
import time

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expr import clip
from .operators import baskets as B
from .operators import cluster as C
from .operators import explore as E
from .operators import graph as G
from .operators import recommend as R
from .operators import similarity as L
from .operators import sketches as K
from .session import build_session, shared_dir
from .sources import tables as S

_COMPLIMENTS = [f"compliment_{c}" for c in "hot more profile cute list note plain cool funny writer photos".split()]
USER_SCHEMA = "user_id string, average_stars double, review_count int, fans int, friends string, yelping_since string, useful int, funny int, cool int, " + ", ".join(f"{c} int" for c in _COMPLIMENTS)


def explore(spark: SparkSession, input: str, output: str) -> None:
    """Counts, distinct counts and top-10 lists of a review file, as one JSON object."""
    r = S.read_json_lines(spark, input, S.REVIEW_SCHEMA).where("user_id is not null")
    one = r.agg(F.count("*").alias("n_review"), F.count_if(F.substring("date", 1, 4) == "2018").alias("n_review_2018"), F.count_distinct("user_id").alias("n_user"), F.count_distinct("business_id").alias("n_business"))
    top = {f"top10_{k}": E.top_k(r, c) for k, c in (("user", "user_id"), ("business", "business_id"))}
    lists = None
    for name, t in top.items():  # ten rows each
        packed = t.agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(t.columns[0]).alias("k")))), lambda x: F.array(x["k"], (-x["m"]).cast("string"))).alias(name))
        lists = packed if lists is None else lists.join(packed, F.lit(True))
    S.write_json_document(one.join(lists, F.lit(True)), output)


def partitions(spark: SparkSession, input: str, output: str, n_partition: str) -> None:
    """The top-10 businesses under the default and under a first-letter partitioning: sizes and times."""
    r = S.read_json_lines(spark, input, "business_id string").where("business_id is not null")
    rows = []
    for name, df in (("default", r), ("customized", r.repartition(int(n_partition), F.ascii("business_id")))):
        sizes = [x["n"] for x in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).orderBy("p").collect()]
        began = time.time()
        E.top_k(df, "business_id").collect()
        rows.append((name, len(sizes), sizes, time.time() - began))
    S.write_json_document(spark.createDataFrame([tuple(x[1:] for x in rows)], ", ".join(f"{n} struct<n_partition: int, n_items: array<bigint>, exe_time: double>" for n, *_ in rows)), output)


def city_stars(spark: SparkSession, review: str, business: str, out_csv: str, out_json: str) -> None:
    """Average stars by city, highest first, and the time of a driver's against Spark's sort."""
    fact = S.read_json_lines(spark, review, "business_id string, stars double")
    dim = S.read_json_lines(spark, business, "business_id string, city string")
    avg = E.average_by(fact, dim, "business_id", "city", "stars").select("city", F.col("average").alias("stars"))
    S.write_csv(avg, out_csv, one_file=True)
    took = []
    for run in (lambda: sorted(avg.collect(), key=lambda x: (-x["stars"], x["city"]))[:10], lambda: avg.limit(10).collect()):
        began = time.time()
        run()
        took.append(time.time() - began)
    S.write_json_document(spark.createDataFrame([tuple(took)], "m1 double, m2 double"), out_json)


def _itemsets(b: DataFrame, support: int, output: str) -> None:
    found = B.frequent_itemsets(b, support).cache()
    cand = B.son_candidates(b, support, 8).select("items")
    lines = [("1", "Candidates:")] + [("2", x["line"]) for x in B.report_lines(cand.union(found.where("size > 1").select("items"))).collect()]
    lines += [("3", "Frequent Itemsets:")] + [("4", x["line"]) for x in B.report_lines(found).collect()]
    spark = b.sparkSession
    df = spark.createDataFrame([(f"{k}{i:06d}", v) for i, (k, v) in enumerate(lines)], "k string, value string")
    S.write_lines(df, F.col("value"), output, [F.col("k")])


def itemsets(spark: SparkSession, case: str, support: str, input: str, output: str) -> None:
    """Frequent itemsets of users' businesses (case 1) or businesses' users (case 2)."""
    key, item = ("user_id", "business_id") if case == "1" else ("business_id", "user_id")
    _itemsets(B.baskets(S.read_csv(spark, input, "user_id string, business_id string"), key, item), int(support), output)


def retail_itemsets(spark: SparkSession, threshold: str, support: str, input: str, output: str) -> None:
    """Frequent itemsets of customers' days with more than ``threshold`` products, from a quoted retail file."""
    cols = "d string, c string, x2 string, x3 string, x4 string, p string, x6 string, x7 string, x8 string"
    raw = S.read_csv(spark, input, cols).withColumn("d", F.to_date("d", "M/d/yyyy"))
    _itemsets(B.baskets(B.retail_rows(raw, "d", "c", "p"), "basket", "item", int(threshold)), int(support), output)


def similar(spark: SparkSession, input: str, output: str) -> None:
    """Pairs of businesses whose users' sets have Jaccard similarity of 0.5 or more."""
    r = S.read_csv(spark, input, "user_id string, business_id string").select(F.col("business_id").alias("set_id"), F.pmod(F.xxhash64("user_id"), F.lit(1 << 31)).alias("element")).distinct()
    S.write_csv(L.similar_pairs(r).select(F.col("a").alias("business_id_1"), F.col("b").alias("business_id_2"), "similarity").orderBy("business_id_1", "business_id_2"), output)


def _ratings(spark: SparkSession, path: str) -> DataFrame:
    return S.read_csv(spark, path, S.RATING_SCHEMA).select(F.col("user_id").alias("u"), F.col("business_id").alias("i"), F.col("stars").alias("s"))


def _out(p: DataFrame, output: str, column: str = "prediction") -> None:
    S.write_csv(p.select(F.col("u").alias("user_id"), F.col("i").alias("business_id"), F.col("prediction").alias(column)), output)


def item_cf(spark: SparkSession, train: str, test: str, output: str) -> None:
    """Item-based predictions for user and business pairs."""
    _out(R.predict(_ratings(spark, train), _ratings(spark, test).select("u", "i")), output)


_MODEL = ["average_stars", "review_count", "b_stars", "b_count"]
_FULL = [*_MODEL, "fans_sq", "n_friends_sq", "days_member", "useful", "funny", "cool", "item_avg", "user_avg", "cf", "latitude", "longitude", *(f"open_{d}" for d in "mon tue wed thu fri sat sun".split())]
_VECTORS = {"state_hot": 0, "city_pca": 10, "category_pca": 10, "compliment_pca": 5}  # and their components


def _users(spark: SparkSession, folder: str) -> DataFrame:
    u = R.user_features(S.read_json_lines(spark, f"{folder}/user.json", USER_SCHEMA), "2019-01-01").where("user_id is not null")
    return u.fillna(0, _COMPLIMENTS).withColumnRenamed("user_id", "u")


def _businesses(spark: SparkSession, folder: str) -> DataFrame:
    b = R.weekday_flags(S.read_json_lines(spark, f"{folder}/business.json", S.BUSINESS_SCHEMA), "hours").where("business_id is not null")
    b = b.withColumns({"cities": F.array(F.coalesce("city", F.lit(""))), "words": F.split(F.coalesce("categories", F.lit("")), ", "), "state": F.coalesce("state", F.lit(""))})
    return b.select(F.col("business_id").alias("i"), F.col("stars").alias("b_stars"), F.col("review_count").alias("b_count"), "latitude", "longitude", "state", "cities", "words", *[c for c in _FULL if c.startswith("open_")])


def _encoders(spark: SparkSession, folder: str) -> dict[str, PipelineModel]:
    """State as one-hot columns without the last, cities and categories as components of 0/1 vectors, compliments as components."""
    b, u = _businesses(spark, folder), _users(spark, folder)
    k = {n: v for n, v in _VECTORS.items() if v}
    state = Pipeline(stages=[StringIndexer(inputCol="state", outputCol="state_n", handleInvalid="keep", stringOrderType="alphabetAsc"), OneHotEncoder(inputCols=["state_n"], outputCols=["state_hot"], dropLast=True)]).fit(b)
    thanks = Pipeline(stages=[VectorAssembler(inputCols=_COMPLIMENTS, outputCol="thanks", handleInvalid="keep"), PCA(k=k["compliment_pca"], inputCol="thanks", outputCol="compliment_pca")]).fit(u)
    return {"state": state, "city": R.components(b, "cities", "city_pca", k["city_pca"]), "category": R.components(b, "words", "category_pca", k["category_pca"]), "compliment": thanks}


def _features(spark: SparkSession, folder: str, pairs: DataFrame, train: DataFrame, encoders: dict[str, PipelineModel] | None = None) -> DataFrame:
    u, b = _users(spark, folder), _businesses(spark, folder)
    full = encoders is not None
    if full:
        for name, e in encoders.items():
            u, b = (e.transform(u), b) if name == "compliment" else (u, e.transform(b))
        flat = lambda t: [vector_to_array(c).alias(c) for c in _VECTORS if c in t.columns]
        u, b = (t.select(k, *[c for c in _FULL if c in t.columns], *flat(t)) for k, t in (("u", u), ("i", b)))
    known = "s" in pairs.columns  # a rating isn't a feature of itself
    f = pairs.join(u, "u", "left").join(b, "i", "left")
    if full:
        f = f.join(R.predict(train, pairs, leave_out=known).select("u", "i", F.col("prediction").alias("cf")), ["u", "i"], "left")
    if known:
        return f.join(R.leave_one_out(train).drop("s"), ["u", "i"], "left")
    ia, ua = (train.groupBy(k).agg(F.avg("s").alias(n)) for k, n in (("i", "item_avg"), ("u", "user_avg")))
    return f.join(ia, "i", "left").join(ua, "u", "left")


def _filled(f: DataFrame, encoders: dict[str, PipelineModel]) -> DataFrame:
    """Vectors; those of unknown users and businesses are all -1, as missing numbers are."""
    size = {"state_hot": encoders["state"].stages[-1].categorySizes[0] - 1, **{f"{n}_pca": encoders[n].stages[-1].getK() for n in ("city", "category", "compliment")}}
    return f.withColumns({c: array_to_vector(F.coalesce(c, F.array_repeat(F.lit(-1.0), n))) for c, n in size.items()})


def _model(spark: SparkSession, folder: str, test: str, columns: list[str], trees: int, rate: float) -> DataFrame:
    train = _ratings(spark, f"{folder}/yelp_train.csv")
    fitted = R.fit_gbt(_features(spark, folder, train, train), columns, "s", trees, 7, rate)
    out = fitted.transform(_features(spark, folder, _ratings(spark, test).select("u", "i"), train).fillna(-1.0, columns))
    return out.withColumn("prediction", clip(F.col("prediction"), 1, 5))


def model_cf(spark: SparkSession, folder: str, test: str, output: str) -> None:
    """Boosted trees on user and business features."""
    _out(_model(spark, folder, test, _MODEL, 30, 0.1), output)


def train_switch(spark: SparkSession, train: str, truth: str, item_predictions: str, model_predictions: str, model: str) -> None:
    """Fits and stores the classifier that picks the better of two predictions."""
    t = _ratings(spark, truth)
    p = [S.read_csv(spark, x, "user_id string, business_id string, prediction double").toDF("u", "i", n) for x, n in ((item_predictions, "item"), (model_predictions, "model"))]
    both = R.rating_stddev(_ratings(spark, train), t.join(p[0], ["u", "i"]).join(p[1], ["u", "i"]))
    R.fit_switch(R.switch_labels(both), ["u_std", "i_std"]).write().overwrite().save(model)


def hybrid(spark: SparkSession, folder: str, test: str, output: str, model: str) -> None:
    """The stored classifier picks the item-based or the model's prediction for each pair."""
    train = _ratings(spark, f"{folder}/yelp_train.csv")
    pairs = _ratings(spark, test).select("u", "i")
    m = _model(spark, folder, test, _MODEL, 50, 0.1).select("u", "i", F.col("prediction").alias("m"))
    c = R.predict(train, pairs).select("u", "i", F.col("prediction").alias("c"))
    x = PipelineModel.load(model).transform(R.rating_stddev(train, m.join(c, ["u", "i"])))
    _out(x.withColumn("prediction", F.when(F.col("prediction") == 1, F.col("m")).otherwise(F.col("c"))), output)


def train_recommender(spark: SparkSession, folder: str, model: str, trees: str = "220") -> None:
    """Fits and stores the final recommender: its feature encoders and the boosted trees on all features."""
    train = _ratings(spark, f"{folder}/yelp_train.csv")
    encoders = _encoders(spark, folder)
    for name, e in encoders.items():
        e.write().overwrite().save(f"{model}/{name}")
    f = _filled(_features(spark, folder, train, train, encoders), encoders).select("s", *_FULL, *_VECTORS).fillna(-1.0, _FULL).checkpoint()
    stages = [VectorAssembler(inputCols=[*_FULL, *_VECTORS], outputCol="features"), GBTRegressor(labelCol="s", maxIter=int(trees), maxDepth=7, stepSize=0.05, seed=1, maxMemoryInMB=512)]
    Pipeline(stages=stages).fit(f).write().overwrite().save(f"{model}/trees")


def recommend(spark: SparkSession, folder: str, test: str, output: str, model: str) -> None:
    """The final recommender, as ``train_recommender`` stored it; predictions are clipped to [1, 5]."""
    train = _ratings(spark, f"{folder}/yelp_train.csv")
    encoders = {n: PipelineModel.load(f"{model}/{n}") for n in ("state", "city", "category", "compliment")}
    f = _filled(_features(spark, folder, _ratings(spark, test).select("u", "i"), train, encoders), encoders).fillna(-1.0, _FULL)
    out = PipelineModel.load(f"{model}/trees").transform(f)
    _out(out.withColumn("prediction", clip(F.col("prediction"), 1, 5)), output, "stars")


def rmse(spark: SparkSession, predictions: str, truth: str, output: str) -> None:
    """RMSE, error histogram, means and deviations of a prediction file."""
    p = S.read_csv(spark, predictions, "user_id string, business_id string, prediction double").toDF("u", "i", "prediction").join(_ratings(spark, truth), ["u", "i"])
    hist = R.error_histogram(p).agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("histogram"))
    S.write_json_document(R.rmse_metrics(p).join(hist, F.lit(True)), output)


def _edges(spark: SparkSession, threshold: str, input: str) -> DataFrame:
    r = S.read_csv(spark, input, "user_id string, business_id string")
    return G._cut(G.copairs(r, "user_id", "business_id").where(F.col("n") >= int(threshold)).select("u", "v"))


def _communities(labels: DataFrame, label: str, output: str) -> None:
    c = labels.groupBy(label).agg(F.array_sort(F.collect_list("node")).alias("m"))
    S.write_lines(c, F.concat(F.lit("'"), F.array_join("m", "', '"), F.lit("'")), output, [F.size("m"), F.col("m")])


def communities(spark: SparkSession, threshold: str, input: str, output: str) -> None:
    """Label-propagation communities of users who share ``threshold`` businesses."""
    _communities(G.label_propagation(_edges(spark, threshold, input)), "label", output)


def girvan_newman(spark: SparkSession, threshold: str, input: str, out_betweenness: str, out_community: str) -> None:
    """Edge betweenness and the communities of greatest modularity."""
    e = _edges(spark, threshold, input)
    b = G.edge_betweenness(e)
    S.write_lines(b, F.format_string("('%s', '%s'),%.5f", "u", "v", "betweenness"), out_betweenness, [F.desc(F.round("betweenness", 5)), F.col("u"), F.col("v")])
    _communities(G.girvan_newman(e), "component", out_community)


def _asked(spark: SparkSession, input: str, size: str, asks: str, seed: int) -> DataFrame:
    """(seq, item): ``asks`` batches of ``size`` lines, drawn with replacement."""
    ids = E.dict_encode(spark.read.schema("user_id string").csv(input).withColumn("k", F.monotonically_increasing_id()).withColumn("key", F.struct("k", "user_id")), "key")
    n = ids.count()
    draws = spark.range(int(size) * int(asks)).select(F.col("id").alias("seq"), F.pmod(F.xxhash64(F.col("id"), F.lit(seed)), F.lit(n)).alias("idx"))
    return draws.join(ids, "idx").select("seq", F.col("key.user_id").alias("user_id"), F.pmod(F.xxhash64("key.user_id"), F.lit(1 << 31)).alias("item"))


def bloom(spark: SparkSession, input: str, stream_size: str, num_of_asks: str, output: str) -> None:
    """False-positive rate of a Bloom filter for each batch of a stream."""
    b = K.batches(_asked(spark, input, stream_size, num_of_asks, 553), "seq", "item", int(stream_size))
    S.write_csv(K.bloom_fpr(b, 69997).select(F.col("batch").alias("Time"), F.col("fpr").alias("FPR")).orderBy("Time"), output, one_file=True)


def flajolet_martin(spark: SparkSession, input: str, stream_size: str, num_of_asks: str, output: str) -> None:
    """Estimated and true distinct counts for each batch of a stream."""
    b = K.batches(_asked(spark, input, stream_size, num_of_asks, 553), "seq", "item", int(stream_size))
    S.write_csv(K.flajolet_martin(b, 1 << 16).select(F.col("batch").alias("Time"), F.col("truth").alias("Ground Truth"), F.col("estimate").alias("Estimation")).orderBy("Time"), output, one_file=True)


def reservoir(spark: SparkSession, input: str, stream_size: str, num_of_asks: str, output: str) -> None:
    """Some slots of a 100-item sample after each batch of a stream."""
    s = _asked(spark, input, stream_size, num_of_asks, 553)
    t = K.reservoir_trace(s, "seq", "user_id", 100, int(stream_size), [0, 20, 40, 60, 80])
    S.write_csv(t.select(F.col("n").alias("seqnum"), *[F.col(f"s_{k}").alias(f"{k}_id") for k in (0, 20, 40, 60, 80)]).orderBy("seqnum"), output, one_file=True)


def bfr(spark: SparkSession, input: str, n_cluster: str, output: str) -> None:
    """BFR clustering of points: a line for each round, then a cluster for each id."""
    width = len(spark.read.text(input).first()[0].split(",")) - 2
    p = S.read_points(spark, input, width).select("id", "point")
    rounds, labels = C.bfr(p, int(n_cluster), width)
    head = rounds.select(F.format_string("%09d", F.col("round")).alias("k"), F.concat_ws(",", F.concat(F.lit("Round "), F.col("round"), F.lit(": "), F.col("ds_points")), "cs_clusters", "cs_points", "rs_points").alias("value"))
    rest = labels.select(F.format_string("x%020d", F.col("id")).alias("k"), F.concat_ws(",", "id", "cluster").alias("value"))
    S.write_lines(head.union(rest), F.col("value"), output, [F.col("k")])


PROGRAMS = {f.__name__: f for f in (explore, partitions, city_stars, itemsets, retail_itemsets, similar, item_cf, model_cf, train_switch, hybrid, train_recommender, recommend, rmse, communities, girvan_newman, bloom, flajolet_martin, reservoir, bfr)}


def main(args: list[str]) -> int:
    f = PROGRAMS.get(args[0]) if args else None
    names = list(inspect.signature(f).parameters)[1:] if f else []
    if f is None or len(args) - 1 != len(names):
        for name, g in PROGRAMS.items():
            print(name, *list(inspect.signature(g).parameters)[1:], "-", g.__doc__.strip().splitlines()[0])
        return 2
    spark = build_session(f"millrace-{args[0]}")
    shared_dir(spark)
    f(spark, *args[1:])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
