"""The learning programs and operators on made-up files, with known answers or invariants."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace import programs as P
from millrace.operators import cluster as C
from millrace.operators import recommend as R
from millrace.operators.explore import split_train_test


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Ratings that follow the user's and the item's taste, with files as the programs read them."""
    d, r = tmp_path_factory.mktemp("files"), random.Random(3)
    taste = {u: r.choice([-1, 1]) for u in range(60)}
    kind = {i: r.choice([-1, 1]) for i in range(40)}
    with open(d / "user.json", "w") as f:
        for u in range(55):  # some are unknown
            f.write(json.dumps({"user_id": f"u{u}", "average_stars": 3.0, "review_count": u, "fans": u % 5, "friends": "None" if u % 3 else "a, b", "yelping_since": "2015-01-02", "useful": 1, "funny": 0, "cool": 2, **{c: r.randint(0, 9) for c in P._COMPLIMENTS}}) + "\n")
    with open(d / "business.json", "w") as f:
        for i in range(38):
            f.write(json.dumps({"business_id": f"b{i}", "city": f"c{i % 7}", "state": "AZ NV OH".split()[i % 3], "stars": 3.0, "review_count": i, "latitude": 1.0, "longitude": 2.0, "categories": ", ".join(["Food", f"k{kind[i]}", f"x{i % 5}"]) if i % 6 else None, "hours": {"Monday": "9-5"} if i % 2 else None}) + "\n")
    rows = {(u, i): min(5, max(1, 3 + taste[u] * kind[i] * 1.5 + r.choice([-0.5, 0.5]))) for u in range(60) for i in r.sample(range(40), 14)}
    cut = list(rows.items())
    r.shuffle(cut)
    for name, some in (("yelp_train.csv", cut[:700]), ("val.csv", cut[700:])):
        with open(d / name, "w") as f:
            f.write("user_id,business_id,stars\n" + "".join(f"u{u},b{i},{s}\n" for (u, i), s in some))
    return d


def rmse(spark, folder, path, column="prediction"):
    p = spark.read.csv(str(path), header=True, inferSchema=True).withColumnRenamed(column, "p")
    t = spark.read.csv(f"{folder}/val.csv", header=True, inferSchema=True)
    assert p.count() == t.count()
    x = p.join(t.withColumnRenamed("stars", "t"), ["user_id", "business_id"])
    return x.agg(F.sqrt(F.avg((F.col("p") - F.col("t")) ** 2))).first()[0]


def test_recommender_is_stored_and_loaded(spark, folder):
    spark.sparkContext.setCheckpointDir(str(folder / "ck"))
    P.train_recommender(spark, str(folder), str(folder / "model"), "15")
    P.recommend(spark, str(folder), str(folder / "val.csv"), str(folder / "out"), str(folder / "model"))
    assert rmse(spark, folder, folder / "out", "stars") < 1.3  # the mean alone gives about 1.6


def test_switch_and_hybrid(spark, folder):
    P.item_cf(spark, str(folder / "yelp_train.csv"), str(folder / "val.csv"), str(folder / "item"))
    spark.read.csv(str(folder / "val.csv"), header=True).selectExpr("user_id", "business_id", "3.0 AS prediction").write.csv(str(folder / "flat"), header=True)
    P.train_switch(spark, str(folder / "yelp_train.csv"), str(folder / "val.csv"), str(folder / "item"), str(folder / "flat"), str(folder / "switch"))
    P.rmse(spark, str(folder / "item"), str(folder / "val.csv"), str(folder / "rmse.json"))
    got = rmse(spark, folder, folder / "item")
    assert got < 1.5


def test_leave_one_out_by_brute_force(spark):
    r = random.Random(5)
    rows = [(u, i, float(r.randint(1, 5))) for u in range(12) for i in r.sample(range(8), 5)] + [(50, 1, 2.0), (51, 90, 4.0)]
    df = spark.createDataFrame(rows, "u int, i int, s double")
    got = {(x.u, x.i): (x.prediction, x.source) for x in R.predict(df, df, min_neighbors=2, leave_out=True).collect()}
    assert got[(51, 90)] == (3.75, "cold") and got[(50, 1)][1] == "cold"
    sim = {(x.i, x.j): x.adj for x in R.item_similarity(df).collect()}
    for u, i, s in rows[:-2]:
        near = sorted(((-round(sim[i, j], 9), j, t) for v, j, t in rows if v == u and j != i and (i, j) in sim))[:5]
        num, den = sum(-a * t for a, _, t in near), sum(abs(a) for a, _, _ in near)
        others = [t for v, j, t in rows if j == i and v != u]
        want = num / den if len(near) >= 2 and num > 0 else sum(others) / len(others)
        assert abs(got[u, i][0] - want) < 1e-6


def test_trees_pca_kmeans_and_accuracy(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(float(x), float(r.random()), 2.0 * (x > 10) + 1) for x in range(40)], "a double, b double, s double")
    fitted = R.fit_gbt(df, ["a", "b"], "s", 10, 3, 0.5)
    assert fitted.transform(df).agg(F.max(F.abs(F.col("prediction") - F.col("s")))).first()[0] < 0.2
    line = spark.createDataFrame([(float(x), 2.0 * x, 0.5) for x in range(20)], "a double, b double, c double")
    p = R.pca(line, ["a", "b", "c"], 2).select(F.stddev(F.col("pca")[0]).alias("x"), F.stddev(F.col("pca")[1]).alias("y")).first()
    assert p.x > 10 and p.y < 1e-6
    points = spark.createDataFrame([(k, [50.0 * (k % 3) + r.random(), r.random()]) for k in range(60)], "id int, point array<double>")
    k = C.kmeans(points, 3)
    assert sorted(x.n for x in C.cluster_sizes(k).collect()) == [20, 20, 20]
    even = C.balanced(points, 3, 1, 1.8, 5, lambda d: d.checkpoint())
    assert max(x.n for x in C.cluster_sizes(even).collect()) <= 36
    t = spark.createDataFrame([(1, 1), (0, 1), (1, 1), (0, 0)], "y int, p int")
    assert tuple(R.accuracy(t, "y", "p").first()) == (4, 3, 0.75)
    a, b = split_train_test(df, F.col("a") % 4 == 0)
    assert (a.count(), b.count()) == (30, 10)
    assert spark.range(1).select(R.weighted_hybrid(F.lit(2.0), F.lit(4.0), 0.25)).first()[0] == 3.5


def test_trees_on_cells_are_those_on_rows(spark):
    r = random.Random(7)
    rows = [(float(a), float(b), a * (b > 3) + r.random()) for a, b in ((r.randint(0, 5), r.randint(0, 6)) for _ in range(3000))]
    df = spark.createDataFrame(rows, "a double, b double, s double")
    x = R.fit_gbt(df, ["a", "b"], "s", 5, 4, 0.3).transform(df).select("a", "b", F.col("prediction").alias("x")).distinct()
    y = R.fit_cells(df, ["a", "b"], "s", 5, 4, 0.3).transform(df).select("a", "b", F.col("prediction").alias("y")).distinct()
    assert x.join(y, ["a", "b"]).agg(F.count("*"), F.max(F.abs(F.col("x") - F.col("y")))).first()[1] < 1e-6
    assert R.fit_cells(df, ["a", "b"], "s", 5, 4).stages[-1].stages[-1].trees[0].depth == 4
    sizes = []
    R.stored, kept = (lambda t, name: sizes.append(t.count()) or kept(t, name)), R.stored
    try:
        R.fit_cells(df, ["a", "b"], "s", 2, 2)
    finally:
        R.stored = kept
    assert sizes == [42]


def test_full_model_has_the_reference_size(spark, monkeypatch):
    from millrace.plans import learning as Q

    asked = []
    monkeypatch.setattr(Q, "_model", lambda spark, d, trees, depth, rate, columns: asked.append((trees, depth, rate, len(columns))))
    Q.model_cf_full(spark, "")
    assert asked == [(220, 7, 0.05, 9)]
