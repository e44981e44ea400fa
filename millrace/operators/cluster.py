"""Summary-based clustering on points (id, point): statistics, Mahalanobis assignment, BFR rounds."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import mahalanobis, squared_distance

#: Clusters that a summary may have to be broadcast to all points; more are joined in blocks of so many.
MAX_CLUSTERS = 10_000


def points(df: DataFrame, id_: str, vector: str, label: str | None = None) -> DataFrame:
    cols = [F.col(id_).alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("point")]
    return df.select(*cols, *([F.col(label).alias("label")] if label else []))


def component_stats(p: DataFrame, label: str = "label") -> DataFrame:
    """(label, dim, n, mean, sigma), with partial sums before the shuffle."""
    flat = p.select(label, F.posexplode("point").alias("dim", "x"))
    return flat.groupBy(label, "dim").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sigma"))


def cluster_stats(p: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, mean, sigma) with arrays: a cluster's summary (N, SUM, SUMSQ in another form)."""
    s = component_stats(p, label).groupBy(label).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "mean", "sigma"))).alias("_d"))
    return s.select(label, "n", F.col("_d.mean").alias("mean"), F.col("_d.sigma").alias("sigma"))


def _each(p: DataFrame, clusters: DataFrame, distance, keep: int | None = None) -> DataFrame:
    """(id, label, dist): each point's nearest cluster, the least label of equals.

    Clusters go to the points as one array a row, if there are at most MAX_CLUSTERS; beyond, in blocks whose
    results are reduced again. All points are never paired with all clusters as rows.
    """
    n = clusters.count()
    blocks = [clusters] if n <= MAX_CLUSTERS else [clusters.where(F.pmod(F.xxhash64("label"), F.lit(-(-n // MAX_CLUSTERS))) == k) for k in range(-(-n // MAX_CLUSTERS))]
    out = None
    for b in blocks:
        packed = b.agg(F.sort_array(F.collect_list(F.struct("label", "mean", "sigma"))).alias("_c"))
        near = p.join(F.broadcast(packed), F.lit(True)).withColumn("_n", F.array_min(F.transform("_c", lambda c: F.struct(F.round(distance(F.col("point"), c["mean"], c["sigma"]), 9).alias("dist"), c["label"].alias("label")))))
        near = near.select("id", F.col("_n.label").alias("label"), F.col("_n.dist").alias("dist"))
        out = near if out is None else out.union(near)
    return out if len(blocks) == 1 else out.groupBy("id").agg(F.min(F.struct("dist", "label")).alias("_m")).select("id", "_m.label", "_m.dist")


def nearest_centroid(p: DataFrame, clusters: DataFrame) -> DataFrame:
    return _each(p, clusters, lambda x, m, s: F.sqrt(squared_distance(x, m)))


def mahalanobis_assign(p: DataFrame, clusters: DataFrame, dims: int) -> DataFrame:
    """(id, cluster, dist): the nearest cluster by normalised distance if it is nearer than 2 sqrt(dims), else -1."""
    near = _each(p, clusters, mahalanobis)
    return near.select("id", F.when(F.col("dist") < 2 * dims**0.5, F.col("label")).otherwise(-1).alias("cluster"), "dist")


def cluster_distances(clusters: DataFrame) -> DataFrame:
    """(a, b, dist), a < b: the lesser of the two normalised distances between centroids. For summaries, not points."""
    a = clusters.select(F.col("label").alias("a"), F.col("mean").alias("ma"), F.col("sigma").alias("sa"))
    b = clusters.select(F.col("label").alias("b"), F.col("mean").alias("mb"), F.col("sigma").alias("sb"))
    d = F.least(mahalanobis(F.col("ma"), F.col("mb"), F.col("sb")), mahalanobis(F.col("mb"), F.col("ma"), F.col("sa")))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", d.alias("dist"))


def outliers(p: DataFrame, dims: int, factor: float = 2.0) -> DataFrame:
    """(id, dist) of points farther than factor * sqrt(dims) from the mean of all."""
    one = p.select("id", "point", F.lit(0).alias("label"))
    near = _each(one, cluster_stats(one), mahalanobis)
    return near.where(F.col("dist") >= factor * dims**0.5).select("id", "dist")


def chunks(p: DataFrame, n: int = 5, prime: int = 7919) -> DataFrame:
    """Adds ``chunk`` from 0 to n - 1 by an arithmetic hash of the id: equal shares without a sort."""
    return p.withColumn("chunk", F.pmod(F.pmod(F.col("id") * prime + 13, F.lit(1000003)), F.lit(n)).cast("int"))


def kmeans(p: DataFrame, k: int, seed: int = 1, iterations: int = 20, init: str = "k-means||") -> DataFrame:
    """(id, point, label); ``init`` "random" starts from exactly k points, for a k near the number of points."""
    x = p.select("id", "point", array_to_vector("point").alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=iterations, initMode=init, solver="row").fit(x)
    return model.transform(x).select("id", "point", F.col("prediction").alias("label"))


def balanced(p: DataFrame, k: int, seed: int, uneven: float, retries: int, cut) -> DataFrame:
    """(id, point, label) of k clusters, the greatest of at most ``uneven`` times the mean size if some start gives that."""
    best, least = None, None
    for turn in range(retries + 1):
        made = cut(kmeans(p, k, seed + turn).select("id", "point", "label"))
        n = [r["n"] for r in made.groupBy("label").agg(F.count("*").alias("n")).collect()]  # k rows
        most = max(n, default=0) * k / max(1, sum(n))
        if least is None or most < least:
            best, least = made, most
        if least <= uneven:
            break
    return best


class _Summary:
    """N, SUM and SUMSQ of some clusters, kept in the driver: a row for each, whatever they hold."""

    def __init__(self, rows=()):
        self.n = {r["label"]: r["n"] for r in rows}
        self.s = {r["label"]: np.array(r["s"]) for r in rows}
        self.q = {r["label"]: np.array(r["q"]) for r in rows}

    @staticmethod
    def of(p: DataFrame) -> "_Summary":
        flat = p.select("label", F.posexplode("point").alias("dim", "x")).groupBy("label", "dim").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
        rows = flat.groupBy("label").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("dim", "s", "q"))).alias("d")).select("label", "n", "d.s", "d.q")
        return _Summary(rows.collect())

    def add(self, other: "_Summary") -> None:
        for k in other.n:
            if k in self.n:
                self.n[k], self.s[k], self.q[k] = self.n[k] + other.n[k], self.s[k] + other.s[k], self.q[k] + other.q[k]
            else:
                self.n[k], self.s[k], self.q[k] = other.n[k], other.s[k], other.q[k]

    def mean_sigma(self, k):
        m = self.s[k] / self.n[k]
        return m, np.sqrt(np.maximum(self.q[k] / self.n[k] - m * m, 0))

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(int(k), *[x.tolist() for x in self.mean_sigma(k)]) for k in self.n], "label int, mean array<double>, sigma array<double>")

    def distance(self, a, b) -> float:
        (ma, sa), (mb, sb) = self.mean_sigma(a), self.mean_sigma(b)
        return min(float(np.sqrt((((ma - mb) / np.where(s > 0, s, 1)) ** 2).sum())) for s in (sa, sb))


def bfr(p: DataFrame, k: int, dims: int, n_chunks: int = 5, seed: int = 1, wide: int = 5, small: int = 20, uneven: float = 1.8, retries: int = 5, cut=None) -> tuple[DataFrame, DataFrame]:
    """BFR clustering: (rounds, labels).

    rounds: (round, ds_points, cs_clusters, cs_points, rs_points) after each chunk; labels: (id, cluster), -1 for
    outliers. The first chunk is clustered finely; clusters under ``small`` points are the retained set (RS), the
    rest gives k discard-set (DS) clusters; while the greatest has over ``uneven`` times the mean size, they are made
    again from another start, ``retries`` times at most, and the most even ones stay. Points of later chunks go to the nearest DS cluster, else to the nearest
    compression-set (CS) cluster within 2 sqrt(dims), else to RS, which is clustered again; close CS clusters merge.
    Points stay in DataFrames (materialised by ``cut``); only summaries are in the driver.
    """
    spark, limit = p.sparkSession, 2 * dims**0.5
    cut = cut or (lambda df: df.checkpoint())
    p = cut(chunks(p, n_chunks))
    first = p.where("chunk = 0")
    fine = cut(kmeans(first, max(2, min(k * wide, first.count() // 2)), seed, init="random"))
    big = fine.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= small).select("label")
    main = fine.join(big, "label", "left_semi")
    rs = cut(fine.join(big, "label", "left_anti").select("id", "point"))
    if main.isEmpty():
        main, rs = fine, rs.limit(0)
    assigned = balanced(main.select("id", "point"), k, seed, uneven, retries, cut)
    ds, cs, next_id, placed = _Summary.of(assigned), _Summary(), k, [assigned.select("id", F.col("label").alias("cluster"))]

    def compress(rs):
        nonlocal next_id
        n = rs.count()
        if n < 3:
            return rs
        own = cut(kmeans(rs, max(2, min(k * wide, n - 1)), seed, init="random"))
        grouped = own.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
        new = cut(own.join(grouped, "label", "left_semi").withColumn("label", F.col("label") + next_id))
        next_id += k * wide
        cs.add(_Summary.of(new))
        placed.append(new.select("id", F.col("label").alias("cluster")))
        return cut(own.join(grouped, "label", "left_anti").select("id", "point"))

    alias: dict[int, int] = {}

    def merge(a, b, into):
        alias[b] = a
        other = _Summary()
        other.n, other.s, other.q = {a: cs.n.pop(b)}, {a: cs.s.pop(b)}, {a: cs.q.pop(b)}
        into.add(other)

    rs = compress(rs)
    rounds = [(1, sum(ds.n.values()), len(cs.n), sum(cs.n.values()), rs.count())]
    for c in range(1, n_chunks):
        rest = p.where(F.col("chunk") == c).select("id", "point")
        for summary in (ds, cs):
            if not summary.n:
                continue
            near = cut(mahalanobis_assign(rest, summary.frame(spark), dims).join(rest, "id"))
            hit = near.where("cluster >= 0").select("id", "point", F.col("cluster").alias("label"))
            summary.add(_Summary.of(hit))
            placed.append(hit.select("id", F.col("label").alias("cluster")))
            rest = near.where("cluster < 0").select("id", "point")
        rs = compress(cut(rs.unionByName(rest)))
        todo = sorted(cs.n)
        while todo:  # a cluster is compared with all others again only after it has grown
            a = todo.pop(0)
            while a in cs.n and (near_ := [b for b in sorted(cs.n) if b != a and cs.distance(a, b) < limit]):
                a, b = min(a, near_[0]), max(a, near_[0])
                merge(a, b, cs)
        if c == n_chunks - 1:
            for b in sorted(cs.n):
                both = _Summary()
                both.add(ds)
                both.n[b], both.s[b], both.q[b] = cs.n[b], cs.s[b], cs.q[b]
                a = min(ds.n, key=lambda x: (both.distance(x, b), x))
                if both.distance(a, b) < limit:
                    merge(a, b, ds)
        rounds.append((c + 1, sum(ds.n.values()), len(cs.n), sum(cs.n.values()), rs.count()))

    def root(x):
        while x in alias:
            x = alias[x]
        return x

    labels = placed[0]
    for x in placed[1:]:
        labels = labels.unionByName(x)
    if alias:
        names = spark.createDataFrame([(b, root(b)) for b in alias], "cluster int, to int")
        labels = labels.join(F.broadcast(names), "cluster", "left").select("id", F.coalesce("to", "cluster").alias("cluster"))
    labels = p.select("id").join(labels, "id", "left").select("id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return spark.createDataFrame(rounds, "round int, ds_points long, cs_clusters long, cs_points long, rs_points long"), labels


def cluster_sizes(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))
