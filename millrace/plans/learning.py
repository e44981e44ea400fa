"""Similarity joins, recommenders, clustering and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cluster as C
from ..operators import explore as E
from ..operators import recommend as R
from ..operators import similarity as L
from ..session import release, stored
from ..sources import tables as S
from . import views as V
from .registry import query

BANDS, ROWS, THRESHOLD = 15, 2, 0.5
_RANGE = 1 << 30


def _mh(k: int) -> str:
    a, b = L.COEFFICIENTS[k]
    return f"min((({a} * element + {b}) % {L.PRIME}) % {_RANGE}) AS h{k}"


_SIG = "SELECT set_id, " + ", ".join(_mh(k) for k in range(30)) + " FROM ds GROUP BY set_id"
_BUCKETS = " UNION ALL ".join(f"SELECT set_id, {k} AS band, " + " || '_' || ".join(f"CAST(h{k * ROWS + j} AS VARCHAR)" for j in range(ROWS)) + " AS bucket FROM sg" for k in range(BANDS))
_CAND = "SELECT DISTINCT x.set_id AS a, y.set_id AS b FROM bu x JOIN bu y ON x.band = y.band AND x.bucket = y.bucket AND x.set_id < y.set_id"
_JACC = f"SELECT a, b, c / (p.n + q.n - c) AS similarity FROM (SELECT x.set_id AS a, y.set_id AS b, count(*) AS c FROM ds x JOIN ds y ON x.element = y.element AND x.set_id < y.set_id GROUP BY 1, 2) JOIN dn p ON p.set_id = a JOIN dn q ON q.set_id = b WHERE c / (p.n + q.n - c) >= {THRESHOLD}"


def _lsh(select: str) -> str:
    w = V.WITH
    return f"WITH ds AS MATERIALIZED ({w['ds']}), dn AS MATERIALIZED ({w['dn']}), sg AS MATERIALIZED ({_SIG}), bu AS MATERIALIZED ({_BUCKETS}), ca AS MATERIALIZED ({_CAND}), ja AS MATERIALIZED ({_JACC}) {select}"


def _rounded(t):
    return t.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(_lsh("SELECT * FROM sg"))
def minhash_signature(spark, d):
    return L.signatures(V.doc_sets(spark, d))


@query(_lsh("SELECT * FROM bu"))
def lsh_buckets(spark, d):
    return L.bands(L.signatures(V.doc_sets(spark, d)), BANDS, ROWS)


@query(_lsh("SELECT * FROM ca"))
def lsh_candidates(spark, d):
    return L.candidates(L.bands(L.signatures(V.doc_sets(spark, d)), BANDS, ROWS))


@query(_lsh("SELECT a, b, round(similarity, 6) AS similarity FROM ja SEMI JOIN ca USING (a, b)"))
def lsh_similar_pairs(spark, d):
    return _rounded(L.similar_pairs(V.doc_sets(spark, d), BANDS, ROWS, THRESHOLD))


@query(_lsh("SELECT a, b, round(similarity, 6) AS similarity FROM ja"))
def jaccard_pairs(spark, d):
    return _rounded(L.jaccard_pairs(V.doc_sets(spark, d), THRESHOLD))


@query(_lsh("SELECT f AS n_found, t AS n_truth, f AS n_both, CAST(1 AS DOUBLE) AS precision, round(f / t, 6) AS recall FROM (SELECT count(*) AS f FROM ja SEMI JOIN ca USING (a, b)), (SELECT count(*) AS t FROM ja)"))
def lsh_precision_recall(spark, d):
    sets = V.doc_sets(spark, d)
    truth = stored(L.jaccard_pairs(sets, THRESHOLD), "truth")
    return L.precision_recall(L.in_a_bucket(truth, L.signatures(sets), BANDS, ROWS), truth)


_MC = "SELECT u, i, s, s - avg(s) OVER (PARTITION BY i) AS d FROM {0}"
_SIM = "SELECT i, j, n, de / (sqrt(dd) * sqrt(ee)) AS sim FROM (SELECT x.i AS i, y.i AS j, count(*) AS n, sum(x.d * y.d) AS de, sum(x.d * x.d) AS dd, sum(y.d * y.d) AS ee FROM mc x JOIN mc y ON x.u = y.u AND x.i <> y.i GROUP BY 1, 2) WHERE n >= 3 AND dd > 1e-12 AND ee > 1e-12"
_ADJ = "CASE WHEN sim < 0 THEN 0.1 * sim ELSE 1.1 * sim END"


@query("SELECT u, i, s, round(s - avg(s) OVER (PARTITION BY i), 6) AS d FROM r", "rv", "r")
def mean_centered(spark, d):
    return R.mean_centered(V.ratings(spark, d)).withColumn("d", F.round("d", 6))


V.WITH["mc"] = _MC.format("r")
V.WITH["mt"] = _MC.format("tr")


@query(f"SELECT i, j, n, round(sim, 6) AS sim, round({_ADJ}, 6) AS adj FROM ({_SIM})", "rv", "r", "mc")
def item_similarity(spark, d):
    return R.item_similarity(V.ratings(spark, d)).select("i", "j", "n", F.round("sim", 6).alias("sim"), F.round("adj", 6).alias("adj"))


def _predict(cascade: str, order: str, neighbours: int = 2, least: float = 0.0) -> str:
    w = V.WITH
    views = ", ".join(f"{k} AS MATERIALIZED ({w[k]})" for k in ("rv", "r", "tr", "te", "mt"))
    rest = "CASE WHEN um IS NULL THEN 3.75 WHEN im IS NULL THEN um ELSE coalesce(p, im) END" if cascade == "v1" else "CASE WHEN um IS NULL AND im IS NOT NULL THEN im WHEN um IS NULL OR im IS NULL THEN 3.75 ELSE coalesce(p, im) END"
    return f"""WITH {views}, sm AS MATERIALIZED (SELECT i, j, {_ADJ} AS adj FROM ({_SIM.replace('mc', 'mt')}) WHERE i IN (SELECT i FROM te)),
nb AS (SELECT te.u, te.i, adj, tr.s, row_number() OVER (PARTITION BY te.u, te.i ORDER BY round(adj, 9) {order}, j) AS k FROM te JOIN sm ON sm.i = te.i JOIN tr ON tr.u = te.u AND tr.i = sm.j),
ww AS (SELECT u, i, sum(adj * s) / sum(abs(adj)) AS p FROM nb WHERE k <= 5 GROUP BY u, i HAVING count(*) >= {neighbours} AND sum(adj * s) > {least}),
um AS (SELECT u, avg(s) AS um FROM tr GROUP BY u), im AS (SELECT i, avg(s) AS im FROM tr GROUP BY i),
pp AS MATERIALIZED (SELECT te.u, te.i, te.s, {rest} AS prediction, CASE WHEN um IS NULL OR im IS NULL THEN 'cold' WHEN p IS NOT NULL THEN 'neighbours' ELSE 'item' END AS source
FROM te LEFT JOIN um USING (u) LEFT JOIN im USING (i) LEFT JOIN ww USING (u, i)) """


_SHOW = "SELECT u, i, round(prediction, 6) AS prediction, source FROM pp"


def _predicted(spark, d, **how):
    return R.predict(V.train(spark, d), V.test(spark, d), **({"min_neighbors": 2} | how))


def _show(p):
    return p.select("u", "i", F.round("prediction", 6).alias("prediction"), "source")


@query(_predict("v1", "DESC") + _SHOW)
def cf_predict(spark, d):
    return _show(_predicted(spark, d))


@query(_predict("v2", "DESC") + _SHOW)
def cf_predict_v2(spark, d):
    return _show(_predicted(spark, d, cascade="v2"))


@query(_predict("v1", "ASC", 5, 25.0) + _SHOW)
def cf_predict_compat(spark, d):
    """The least similar neighbours first, five of them, and a numerator over 25."""
    return _show(_predicted(spark, d, order="asc", min_neighbors=5, min_numerator=25.0))


_LOO = f"""SELECT r.u, r.i, round(CASE WHEN um IS NULL THEN 3.75 WHEN im IS NULL THEN um ELSE coalesce(p, im) END, 6) AS prediction,
CASE WHEN um IS NULL OR im IS NULL THEN 'cold' WHEN p IS NOT NULL THEN 'neighbours' ELSE 'item' END AS source
FROM (SELECT u, i, (sum(s) OVER a - s) / nullif(count(*) OVER a - 1, 0) AS im, (sum(s) OVER b - s) / nullif(count(*) OVER b - 1, 0) AS um FROM r WINDOW a AS (PARTITION BY i), b AS (PARTITION BY u)) r
LEFT JOIN (SELECT u, i, sum(adj * s) / sum(abs(adj)) AS p FROM (
SELECT t.u, t.i, adj, r.s, row_number() OVER (PARTITION BY t.u, t.i ORDER BY round(adj, 9) DESC, j) AS k
FROM r t JOIN (SELECT i, j, {_ADJ} AS adj FROM ({_SIM})) sm ON sm.i = t.i JOIN r ON r.u = t.u AND r.i = sm.j)
WHERE k <= 5 GROUP BY u, i HAVING count(*) >= 2 AND sum(adj * s) > 0) w ON w.u = r.u AND w.i = r.i"""


@query(_LOO, "rv", "r", "mc")
def loo_cf_predict(spark, d):
    """Item-based predictions of known ratings without themselves: what trains the models that take them as a feature."""
    r = V.ratings(spark, d)
    return _show(R.predict(r, r, min_neighbors=2, leave_out=True))


@query("SELECT u, i, s, round(coalesce((sum(s) OVER a - s) / nullif(count(*) OVER a - 1, 0), 3.75), 6) AS item_avg, round(coalesce((sum(s) OVER b - s) / nullif(count(*) OVER b - 1, 0), 3.75), 6) AS user_avg FROM r WINDOW a AS (PARTITION BY i), b AS (PARTITION BY u)", "rv", "r")
def loo_averages(spark, d):
    return R.leave_one_out(V.ratings(spark, d)).select("u", "i", "s", F.round("item_avg", 6).alias("item_avg"), F.round("user_avg", 6).alias("user_avg"))


@query("SELECT te.u, te.i, round(coalesce(a, 0), 4) AS u_std, round(coalesce(b, 0), 4) AS i_std FROM te LEFT JOIN (SELECT u, stddev_pop(s) AS a FROM tr GROUP BY u) USING (u) LEFT JOIN (SELECT i, stddev_pop(s) AS b FROM tr GROUP BY i) USING (i)", "rv", "r", "tr", "te")
def rating_stddev(spark, d):
    return R.rating_stddev(V.train(spark, d), V.test(spark, d).select("u", "i")).select("u", "i", F.round("u_std", 4).alias("u_std"), F.round("i_std", 4).alias("i_std"))


_LABELS = f"SELECT u, i, s, CASE WHEN abs(round(m - s, 9)) < abs(round(prediction - s, 9)) THEN 1 ELSE 0 END AS switch FROM pp JOIN (SELECT te.u, te.i, (coalesce(ua, 3.75) + coalesce(ia, 3.75)) / 2 AS m FROM te LEFT JOIN (SELECT u, avg(s) AS ua FROM tr GROUP BY u) USING (u) LEFT JOIN (SELECT i, avg(s) AS ia FROM tr GROUP BY i) USING (i)) USING (u, i)"


def _two(spark, d):
    """Test pairs with a simple model's (mean of user's and item's mean) and the item-based prediction."""
    r = V.train(spark, d)
    ua, ia = (r.groupBy(k).agg(F.avg("s").alias(k + "a")) for k in "ui")
    m = (F.coalesce("ua", F.lit(3.75)) + F.coalesce("ia", F.lit(3.75))) / 2
    return _judged(spark, d).withColumnRenamed("prediction", "item").join(ua, "u", "left").join(ia, "i", "left").withColumn("model", m)


@query(_predict("v1", "DESC") + "SELECT u, i, switch FROM (" + _LABELS + ")")
def switch_labels(spark, d):
    """Whether a model's error is less than the item-based prediction's."""
    return R.switch_labels(_two(spark, d)).select("u", "i", "switch")


@query(_predict("v1", "DESC") + f"SELECT count(*) AS n, sum(CAST((abs(switch - coalesce(su < si, false)::INT) = 0) AS BIGINT))::BIGINT AS correct, round(avg(CASE WHEN switch = coalesce(su < si, false)::INT THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM ({_LABELS}) x LEFT JOIN (SELECT u, round(stddev_pop(s), 9) AS su FROM tr GROUP BY u) USING (u) LEFT JOIN (SELECT i, round(stddev_pop(s), 9) AS si FROM tr GROUP BY i) USING (i)")
def switch_accuracy(spark, d):
    """Accuracy of a rule that picks the model where the user's ratings differ less than the item's."""
    r = V.train(spark, d)
    su, si = (r.groupBy(k).agg(F.round(F.stddev_pop("s"), 9).alias("s" + k)) for k in "ui")
    t = R.switch_labels(_two(spark, d)).join(su, "u", "left").join(si, "i", "left").withColumn("guess", F.coalesce(F.col("su") < F.col("si"), F.lit(False)).cast("int"))
    return R.accuracy(t, "switch", "guess").withColumn("accuracy", F.round("accuracy", 6))


_M = "SELECT count(*) AS n, round(sqrt(avg((prediction - s) * (prediction - s))), 6) AS rmse, round(avg(prediction), 6) AS mean_pred, round(stddev_pop(prediction), 6) AS std_pred, round(avg(s), 6) AS mean_truth, round(stddev_pop(s), 6) AS std_truth FROM pp"


def _judged(spark, d):
    return _predicted(spark, d).join(V.test(spark, d), ["u", "i"])


@query(_predict("v1", "DESC") + _M)
def rmse_metrics(spark, d):
    m = R.rmse_metrics(_judged(spark, d))
    return m.select("n", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


@query(_predict("v1", "DESC") + "SELECT CAST(least(floor(abs(round(prediction - s, 9))), 4) AS INTEGER) AS bucket, count(*) AS n FROM pp GROUP BY 1")
def error_histogram(spark, d):
    return R.error_histogram(_judged(spark, d))


def _features(spark, d, pairs, r):
    """User, item and leave-one-out features of pairs; null where one side is unknown."""
    c = S.parquet(spark, d, "customer").select(F.col("c_custkey").alias("u"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").cast("double").alias("nation"))
    p = S.parquet(spark, d, "part").select(F.col("p_partkey").alias("i"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    ua = r.groupBy("u").agg(F.avg("s").alias("user_avg"), F.count("*").cast("double").alias("user_n"))
    ia = r.groupBy("i").agg(F.avg("s").alias("item_avg"), F.count("*").cast("double").alias("item_n"))
    return pairs.join(c, "u", "left").join(p, "i", "left").join(ua, "u", "left").join(ia, "i", "left")


FEATURES = ["balance", "nation", "size", "price", "user_avg", "user_n", "item_avg", "item_n"]


@query("SELECT te.u, te.i, c_acctbal AS balance, CAST(c_nationkey AS DOUBLE) AS nation, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price, round(ua, 6) AS user_avg, CAST(un AS DOUBLE) AS user_n, round(ia, 6) AS item_avg, CAST(im AS DOUBLE) AS item_n FROM te LEFT JOIN customer ON u = c_custkey LEFT JOIN part ON i = p_partkey LEFT JOIN (SELECT u, avg(s) AS ua, count(*) AS un FROM tr GROUP BY u) x ON te.u = x.u LEFT JOIN (SELECT i, avg(s) AS ia, count(*) AS im FROM tr GROUP BY i) y ON te.i = y.i", "rv", "r", "tr", "te")
def cf_features(spark, d):
    f = _features(spark, d, V.test(spark, d).select("u", "i"), V.train(spark, d))
    return f.withColumns({k: F.round(k, 6) for k in ("user_avg", "item_avg")}).select("u", "i", *FEATURES)


_SEG = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{s}' AS INTEGER) AS seg_{k}" for k, s in enumerate(_SEG[:-1])) + " FROM customer")
def one_hot_pivot(spark, d):
    t = S.parquet(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return R.one_hot(t, "c_mktsegment", _SEG, prefix="seg").drop("c_mktsegment")


@query("SELECT p_partkey, array_to_string(list_sort(list(w)), ',') AS hot FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_type, ' ')) AS w FROM part) JOIN (SELECT w FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_type, ' ')) AS w FROM part) WHERE w <> '' GROUP BY w HAVING count(*) >= 10) USING (w) GROUP BY 1")
def multi_hot(spark, d):
    return R.multi_hot(S.parquet(spark, d, "part"), "p_partkey", "p_type", " ", 10)


def _learning_features(spark, d, r, columns):
    """Features of ratings to learn from: a rating has no part in its own means and item-based prediction."""
    loo = R._without_own(r).select("u", "i", F.col("um").alias("_u"), F.col("im").alias("_i"))
    f = _features(spark, d, r, r).join(loo, ["u", "i"], "left")
    f = f.withColumns({"user_avg": F.col("_u"), "item_avg": F.col("_i"), "user_n": F.col("user_n") - 1, "item_n": F.col("item_n") - 1}).drop("_u", "_i")
    if "cf" not in columns:
        return f
    cf = R.predict(r, r, min_neighbors=2, leave_out=True).select("u", "i", F.col("prediction").alias("cf"))
    return f.join(cf, ["u", "i"], "left")


def _model(spark, d, trees: int, depth: int, rate: float, columns: list[str], train=None, test=None):
    r, pairs = (V.train(spark, d) if train is None else train), (V.test(spark, d) if test is None else test)
    f = stored(_learning_features(spark, d, r, columns).select("s", *columns), "features")
    release(spark)
    m = (R.fit_cells if len(columns) <= 4 else R.fit_gbt)(f, columns, "s", trees, depth, rate)
    asked = _features(spark, d, pairs, r)
    if "cf" in columns:
        asked = asked.join(R.predict(r, pairs, min_neighbors=2).select("u", "i", F.col("prediction").alias("cf")), ["u", "i"], "left")
    out = m.transform(asked.fillna(-1.0, columns))
    return out.select("u", "i", "s", F.least(F.lit(5.0), F.greatest(F.lit(1.0), F.col("prediction"))).alias("prediction"))


_FOUR = ["user_avg", "user_n", "item_avg", "item_n"]


@query()
def model_cf(spark, d):
    """Boosted trees on four features."""
    return _model(spark, d, 30, 7, 0.1, _FOUR)


@query()
def model_cf_full(spark, d):
    """Boosted trees on all features and the item-based prediction, with a lower rate."""
    return _model(spark, d, 220, 7, 0.05, [*FEATURES, "cf"])


def _both(spark, d, train, test, trees=15, depth=5):
    """Both predictions of ``test`` from ``train``, with the deviations that the switch goes by."""
    model = _model(spark, d, trees, depth, 0.1, _FOUR, train, test).withColumnRenamed("prediction", "model")
    item = R.predict(train, test, min_neighbors=2).select("u", "i", F.col("prediction").alias("item"))
    return R.rating_stddev(train, model.join(item, ["u", "i"])).checkpoint()


@query()
def hybrid_switch(spark, d):
    """A classifier picks the model's or the item-based prediction for each pair, by keys.

    It is fitted on a part of the training ratings that both predictions were made for without knowing it.
    """
    r = V.train(spark, d)
    held = F.pmod(F.col("u") * 31 + F.col("i"), F.lit(4)) == 0
    fitted = R.fit_switch(R.switch_labels(_both(spark, d, r.where(~held), r.where(held))), ["u_std", "i_std"], trees=5, depth=3)
    out = fitted.transform(_both(spark, d, r, V.test(spark, d)))
    return out.select("u", "i", "s", F.col("prediction").cast("int").alias("switch"), F.when(F.col("prediction") == 1, F.col("model")).otherwise(F.col("item")).alias("final"))


@query()
def pca_features(spark, d):
    """Nation and segment of customers as one-hot columns, then their principal components."""
    t = S.parquet(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    t = R.one_hot(R.one_hot(t, "c_mktsegment", _SEG, prefix="seg"), "c_nationkey", list(range(25)), prefix="nat")
    cols = [c for c in t.columns if c.startswith(("seg_", "nat_"))]
    p = R.pca(t, cols, 10)
    return p.select("c_custkey", *[F.col("pca")[k].alias(f"p{k}") for k in range(10)])


@query("SELECT label, count(*) AS n FROM embeddings GROUP BY label")
def cluster_sizes(spark, d):
    return C.cluster_sizes(S.parquet(spark, d, "embeddings"))


@query("SELECT label, CAST(dim AS INTEGER) AS dim, n, round(m, 6) AS mean, round(sd, 6) AS sigma FROM cs", "pt", "cs")
def cluster_stats(spark, d):
    return C.component_stats(V.vectors(spark, d)).select("label", "dim", "n", F.round("mean", 6).alias("mean"), F.round("sigma", 6).alias("sigma"))


_DISTS = "SELECT pt.id, cs.label, round(sqrt(sum((x - m) * (x - m))), 9) AS e, round(sqrt(sum(power((x - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 2))), 9) AS g FROM pt JOIN cs ON pt.dim = cs.dim GROUP BY 1, 2"


@query(f"SELECT id, min_by(label, struct_pack(a := e, b := label)) AS label, round(min(e), 5) AS dist FROM ({_DISTS}) GROUP BY id", "pt", "cs")
def nearest_centroid(spark, d):
    p = V.vectors(spark, d)
    return C.nearest_centroid(p, C.cluster_stats(p)).select("id", "label", F.round("dist", 5).alias("dist"))


@query(f"SELECT id, CASE WHEN min(g) < 16 THEN min_by(label, struct_pack(a := g, b := label)) ELSE -1 END AS cluster, round(min(g), 5) AS dist FROM ({_DISTS}) GROUP BY id", "pt", "cs")
def mahalanobis_assign(spark, d):
    p = V.vectors(spark, d)
    return C.mahalanobis_assign(p, C.cluster_stats(p), 64).select("id", "cluster", F.round("dist", 5).alias("dist"))


@query("SELECT x.label AS a, y.label AS b, round(least(sqrt(sum(power((x.m - y.m) / CASE WHEN y.sd > 0 THEN y.sd ELSE 1 END, 2))), sqrt(sum(power((x.m - y.m) / CASE WHEN x.sd > 0 THEN x.sd ELSE 1 END, 2)))), 5) AS dist FROM cs x JOIN cs y ON x.dim = y.dim AND x.label < y.label GROUP BY 1, 2", "pt", "cs")
def cluster_distance(spark, d):
    return C.cluster_distances(C.cluster_stats(V.vectors(spark, d))).select("a", "b", F.round("dist", 5).alias("dist"))


@query("SELECT id, round(g, 5) AS dist FROM (SELECT id, sqrt(sum(power((x - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 2))) AS g FROM pt JOIN (SELECT dim, avg(x) AS m, stddev_pop(x) AS sd FROM pt GROUP BY dim) USING (dim) GROUP BY id) WHERE g >= 1.01 * sqrt(64)", "pt")
def outlier_points(spark, d):
    return C.outliers(V.vectors(spark, d), 64, 1.01).select("id", F.round("dist", 5).alias("dist"))


@query("SELECT CAST(((vec_id * 7919 + 13) % 1000003) % 5 AS INTEGER) AS chunk, count(*) AS n FROM embeddings GROUP BY 1")
def bfr_chunks(spark, d):
    return C.chunks(V.vectors(spark, d)).groupBy("chunk").agg(F.count("*").alias("n"))


@query()
def kmeans_sizes(spark, d):
    return C.cluster_sizes(C.kmeans(V.vectors(spark, d), 10))


@query()
def bfr_rounds(spark, d):
    return C.bfr(V.vectors(spark, d).select("id", "point"), 10, 64, wide=2, small=3)[0]


@query()
def bfr_labels(spark, d):
    return C.bfr(V.vectors(spark, d).select("id", "point"), 10, 64, wide=2, small=3)[1]
