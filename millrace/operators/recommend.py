"""Item-based and model-based collaborative filtering on ratings (u, i, s)."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import PCA, Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import release, stored
from .cooccur import co_counts

DEFAULT = 3.75


def mean_centered(r: DataFrame) -> DataFrame:
    """(u, i, s, d): each rating less its item's mean."""
    return r.withColumn("d", F.col("s") - F.avg("s").over(Window.partitionBy("i")))


def item_similarity(r: DataFrame, min_corated: int = 3, only: DataFrame | None = None) -> DataFrame:
    """(i, j, n, sim, adj) in both directions, for items with ``min_corated`` common users and a non-zero norm.

    Common users are counted first; ratings are joined only for the pairs that have enough of them, by the item with
    fewer ratings. ``only`` (i) keeps pairs with such an item as i. adj damps negative similarities to a tenth and
    raises others by a tenth.
    """
    r = r.select("u", "i", "s")
    pair = stored(co_counts(r, "u", "i", min_corated, repeats=True).toDF("i", "j", "n"), "pairs")
    release(r.sparkSession)
    items = pair.select("i").union(pair.select("j")).distinct()
    mine = r.join(items, "i", "left_semi")
    per = mine.groupBy("i").agg(F.avg("s").alias("m"), F.count("*").alias("c"))
    c = mine.join(per, "i").select("u", "i", (F.col("s") - F.col("m")).alias("d"))
    size = per.select("i", "c")
    sized = pair.join(size, "i").join(size.toDF("j", "cj"), "j")
    few = F.col("c") <= F.col("cj")
    sized = sized.select(F.when(few, F.col("i")).otherwise(F.col("j")).alias("i"), F.when(few, F.col("j")).otherwise(F.col("i")).alias("j"))
    both = sized.join(c, "i").join(c.select("u", F.col("i").alias("j"), F.col("d").alias("e")), ["u", "j"])
    t = both.groupBy("i", "j").agg(F.count("*").alias("n"), F.sum(F.col("d") * F.col("e")).alias("de"), F.sum(F.col("d") * F.col("d")).alias("dd"), F.sum(F.col("e") * F.col("e")).alias("ee"))
    t = t.where((F.col("dd") > 1e-12) & (F.col("ee") > 1e-12)).withColumn("sim", F.col("de") / (F.sqrt("dd") * F.sqrt("ee")))
    t = stored(t.select("i", "j", "n", "sim", F.when(F.col("sim") < 0, 0.1 * F.col("sim")).otherwise(1.1 * F.col("sim")).alias("adj")), "similar")
    release(r.sparkSession)
    t = t.unionByName(t.select(F.col("j").alias("i"), F.col("i").alias("j"), "n", "sim", "adj"))
    return t if only is None else t.join(only.select("i").distinct(), "i", "left_semi")


def predict(train: DataFrame, pairs: DataFrame, n_neighbors: int = 5, order: str = "desc", min_neighbors: int = 5, min_numerator: float = 0.0, default: float = DEFAULT, cascade: str = "v1", min_corated: int = 3, leave_out: bool = False) -> DataFrame:
    """(u, i, prediction, source) for each (u, i) of ``pairs``.

    The user's ``n_neighbors`` most (``desc``) or least (``asc``) similar rated items give a weighted mean, if there
    are ``min_neighbors`` and its numerator exceeds ``min_numerator``; otherwise: v1 - unknown user: default, unknown
    item: the user's mean, else the item's mean; v2 - the item's mean if only the user is unknown, default otherwise.
    With ``leave_out`` a rating that ``train`` has for the pair counts neither as a neighbour (an item is none of its
    own) nor in the means; similarities are those of all ratings.
    """
    spark = train.sparkSession
    train, pairs = stored(train.select("u", "i", "s"), "train"), stored(pairs.select("u", "i").distinct(), "asked")
    release(spark)
    sim = item_similarity(train, min_corated, only=pairs)
    near = pairs.join(sim, "i").join(train.select("u", F.col("i").alias("j"), "s"), ["u", "j"])
    rank = Window.partitionBy("u", "i").orderBy(F.desc(F.round("adj", 9)) if order == "desc" else F.asc(F.round("adj", 9)), "j")
    top = near.withColumn("k", F.row_number().over(rank)).where(F.col("k") <= n_neighbors)
    w = top.groupBy("u", "i").agg(F.count("*").alias("k"), F.sum(F.col("adj") * F.col("s")).alias("num"), F.sum(F.abs("adj")).alias("den"))
    w = w.where((F.col("k") >= min_neighbors) & (F.col("num") > min_numerator)).select("u", "i", (F.col("num") / F.col("den")).alias("p"))
    w = stored(w, "near")
    release(spark)
    if leave_out:
        x = pairs.join(_without_own(train).drop("s"), ["u", "i"], "left").join(w, ["u", "i"], "left")
    else:
        um = train.groupBy("u").agg(F.avg("s").alias("um"))
        im = train.groupBy("i").agg(F.avg("s").alias("im"))
        x = pairs.join(um, "u", "left").join(im, "i", "left").join(w, ["u", "i"], "left")
    cold_u, cold_i = F.col("um").isNull(), F.col("im").isNull()
    if cascade == "v1":
        p = F.when(cold_u, F.lit(default)).when(cold_i, F.col("um")).otherwise(F.coalesce("p", "im"))
    else:
        p = F.when(cold_u & ~cold_i, F.col("im")).when(cold_u | cold_i, F.lit(default)).otherwise(F.coalesce("p", "im"))
    source = F.when(cold_u | cold_i, "cold").when(F.col("p").isNotNull(), "neighbours").otherwise("item")
    return x.select("u", "i", p.alias("prediction"), source.alias("source"))


def _without_own(r: DataFrame) -> DataFrame:
    """(u, i, s, im, um): the item's and the user's mean without the rating itself; null where nothing else is left."""
    def without(key):
        w = Window.partitionBy(key)
        return F.try_divide(F.sum("s").over(w) - F.col("s"), F.count("*").over(w) - 1)

    return r.select("u", "i", "s", without("i").alias("im"), without("u").alias("um"))


def leave_one_out(r: DataFrame, default: float = DEFAULT) -> DataFrame:
    """(u, i, s, item_avg, user_avg) without the rating itself; the default where nothing else is left."""
    return _without_own(r).select("u", "i", "s", *[F.coalesce(c, F.lit(default)).alias(n) for c, n in (("im", "item_avg"), ("um", "user_avg"))])


def rating_stddev(r: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs with the population deviation of their user's and their item's ratings (0 where unknown)."""
    su = r.groupBy("u").agg(F.stddev_pop("s").alias("u_std"))
    si = r.groupBy("i").agg(F.stddev_pop("s").alias("i_std"))
    return pairs.join(su, "u", "left").join(si, "i", "left").fillna(0.0, ["u_std", "i_std"])


def rmse_metrics(p: DataFrame, truth: str = "s", prediction: str = "prediction") -> DataFrame:
    e = F.col(prediction) - F.col(truth)
    return p.agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(prediction).alias("mean_pred"), F.stddev_pop(prediction).alias("std_pred"), F.avg(truth).alias("mean_truth"), F.stddev_pop(truth).alias("std_truth"))


def error_histogram(p: DataFrame, truth: str = "s", prediction: str = "prediction") -> DataFrame:
    """(bucket, n): absolute errors in [0,1), [1,2), [2,3), [3,4) and 4 or more."""
    return p.groupBy(F.least(F.floor(F.abs(F.round(F.col(prediction) - F.col(truth), 9))), F.lit(4)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def switch_labels(p: DataFrame, truth: str = "s", model: str = "model", item: str = "item") -> DataFrame:
    """Adds ``switch``: 1 where the model's absolute error is less than the item-based one's."""
    return p.withColumn("switch", (F.abs(F.round(F.col(model) - F.col(truth), 9)) < F.abs(F.round(F.col(item) - F.col(truth), 9))).cast("int"))


def fit_gbt(train: DataFrame, features: list[str], label: str, trees: int, depth: int, rate: float = 0.1, seed: int = 1):
    """A boosted-tree pipeline; null features are replaced by -1 with the caller's knowledge."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), GBTRegressor(labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed, cacheNodeIds=False, maxMemoryInMB=512)]).fit(train.fillna(-1.0, features))


def fit_cells(train: DataFrame, features: list[str], label: str, trees: int, depth: int, rate: float = 0.1, seed: int = 1, bins: int = 32):
    """:func:`fit_gbt` for few features: rows that fall into the same bins are one row with their mean label and number as weight.

    Trees only ask for bins, and squared loss only for means and weights, so whole rows would give the same trees. Bins
    are quantiles of all rows; there are at most ``bins`` to the power of the features rows, however many are learned from.
    """
    known = train.fillna(-1.0, features)
    cuts = known.approxQuantile(features, [k / bins for k in range(1, bins)], 0.1 / bins)
    splits = [[float("-inf"), *sorted(set(c)), float("inf")] for c in cuts]
    cut = Bucketizer(splitsArray=splits, inputCols=features, outputCols=[f"_{c}" for c in features], handleInvalid="keep")
    ordered = {c: F.col(c) + 0.0 for c in cut.getOutputCols()}  # as a sum it is no longer marked as a category
    cells = cut.transform(known).withColumns(ordered).groupBy(cut.getOutputCols()).agg(F.avg(label).alias(label), F.count("*").cast("double").alias("_n"))
    rest = Pipeline(stages=[VectorAssembler(inputCols=cut.getOutputCols(), outputCol="features", handleInvalid="keep"), GBTRegressor(labelCol=label, weightCol="_n", maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed, maxBins=bins + 1, cacheNodeIds=False)])
    return PipelineModel(stages=[cut, rest.fit(stored(cells, "cells"))])


def fit_switch(train: DataFrame, features: list[str], trees: int = 10, depth: int = 4, seed: int = 1):
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), GBTClassifier(labelCol="switch", maxIter=trees, maxDepth=depth, seed=seed)]).fit(train.fillna(-1.0, features))


def accuracy(p: DataFrame, label: str, prediction: str) -> DataFrame:
    """(n, correct, accuracy) of a classifier's predictions."""
    hit = F.count_if(F.col(label) == F.col(prediction))
    return p.agg(F.count("*").alias("n"), hit.alias("correct"), F.try_divide(hit, F.count("*")).alias("accuracy"))


def components(df: DataFrame, column: str, out: str, k: int, vocabulary: int = 1000, least: int = 1):
    """A stored-pipeline part: an array column as a 0/1 vector of its ``vocabulary`` most frequent words, then ``k`` components."""
    from pyspark.ml.feature import CountVectorizer

    words = CountVectorizer(inputCol=column, outputCol=f"{out}_hot", vocabSize=vocabulary, minDF=float(least), binary=True).fit(df)
    size = len(words.vocabulary)
    return Pipeline(stages=[words, PCA(k=min(k, size), inputCol=f"{out}_hot", outputCol=out)]).fit(df)


def weighted_hybrid(a, b, share: float):
    """share * a + (1 - share) * b, as a column."""
    return a * share + b * (1 - share)


def pca(df: DataFrame, features: list[str], k: int, out: str = "pca") -> DataFrame:
    """Adds the first k principal components of the (centred) columns as an array."""
    from pyspark.ml.functions import vector_to_array

    p = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False), PCA(k=k, inputCol="_c", outputCol="_p")])
    return p.fit(df).transform(df).withColumn(out, vector_to_array("_p")).drop("_v", "_c", "_p")


def one_hot(df: DataFrame, column: str, values: list, drop_last: bool = True, prefix: str | None = None) -> DataFrame:
    """Adds 0/1 columns for the listed values (the last one is implied by the others)."""
    use = values[:-1] if drop_last else values
    return df.withColumns({f"{prefix or column}_{k}": F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for k, v in enumerate(use)})


def multi_hot(df: DataFrame, key: str, values: str, separator: str, least: int) -> DataFrame:
    """(key, hot): sorted distinct words of a delimited column that at least ``least`` rows have."""
    words = df.select(key, F.explode(F.array_distinct(F.split(values, separator))).alias("w")).where("w <> ''")
    common = words.groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("w")
    return words.join(common, "w", "left_semi").groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("w")), ",").alias("hot"))


def weekday_flags(df: DataFrame, hours: str) -> DataFrame:
    """Adds open_mon .. open_sun: whether a map has the day as a key."""
    days = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
    return df.withColumns({f"open_{d[:3].lower()}": F.coalesce(F.map_contains_key(hours, F.lit(d)), F.lit(False)).cast("int") for d in days})


def user_features(df: DataFrame, as_of: str) -> DataFrame:
    """Adds fans_sq, n_friends_sq and days_member to user rows (fans, friends, yelping_since)."""
    n = F.when(F.col("friends") == "None", 0).otherwise(F.size(F.split("friends", ",")))
    return df.withColumns({"fans_sq": F.col("fans").cast("long") * F.col("fans"), "n_friends_sq": n.cast("long") * n, "days_member": F.datediff(F.lit(as_of).cast("date"), F.to_date("yelping_since"))})
