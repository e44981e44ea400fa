"""Micro fixtures with known results, and streaming twins against their batch forms."""

import json
import random

import pytest

from millrace import programs
from millrace.operators import baskets as B
from millrace.operators import cluster as C
from millrace.operators import graph as G
from millrace.operators import recommend as R
from millrace.operators import similarity as L
from millrace.operators import sketches as K
from millrace.sources import tables as S
from millrace.streaming import sketches as T


def edges(spark, *pairs):
    return spark.createDataFrame(pairs, "u long, v long")


TRIANGLES = [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6)]


def test_two_triangles(spark):
    e = edges(spark, *TRIANGLES)
    b = {(r.u, r.v): r.betweenness for r in G.edge_betweenness(e).collect()}
    assert b[3, 4] == 9 and max(b.values()) == 9
    found = {}
    for r in G.girvan_newman(e).collect():
        found.setdefault(r.component, set()).add(r.node)
    assert sorted(map(sorted, found.values())) == [[1, 2, 3], [4, 5, 6]]


def test_path_and_isolated(spark):
    b = {(r.u, r.v): r.betweenness for r in G.edge_betweenness(edges(spark, (1, 2), (2, 3), (3, 4))).collect()}
    assert b == {(1, 2): 3, (2, 3): 4, (3, 4): 3}
    one = edges(spark, (1, 2))
    assert G.girvan_newman(one).select("component").distinct().count() in (1, 2)
    assert G.components(one.limit(0), G.vertices(one)).select("component").distinct().count() == 2


def test_components_of_a_long_path(spark):
    order = list(range(120))
    random.Random(3).shuffle(order)
    e = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])], "u long, v long")
    assert {r.component for r in G.components(e).collect()} == {0}
    assert G.components(e).count() == 120


def test_small_baskets(spark):
    rows = [(k, x) for k, s in enumerate(["ab", "abc", "ac", "bc", "abc"]) for x in s]
    b = B.baskets(spark.createDataFrame(rows + [(None, "a"), (9, None)], "k int, x string"), "k", "x")
    got = {"".join(r["items"]): r["n"] for r in B.frequent_itemsets(b, 3).collect()}
    assert got == {"a": 4, "b": 4, "c": 4, "ab": 3, "ac": 3, "bc": 3}
    assert {"".join(r["items"]) for r in B.son_candidates(b, 3, 2).collect()} >= {"a", "b", "c"}


def test_small_sets(spark):
    sets = spark.createDataFrame([("A", x) for x in (1, 2, 3, 4)] + [("B", x) for x in (1, 2, 3, 5)] + [("C", 9)], "set_id string, element long")
    want = [("A", "B", 0.6)]
    assert [tuple(r) for r in L.jaccard_pairs(sets, 0.5).collect()] == want
    assert [tuple(r) for r in L.jaccard_pairs(sets, 0.7).collect()] == []
    sig = L.signatures(sets)
    assert sig.count() == 3 and len(sig.columns) == 31


def test_exact_join_against_brute_force(spark):
    r = random.Random(6)
    data = {k: {r.randint(0, 25) for _ in range(r.randint(1, 12))} for k in range(60)}
    sets = spark.createDataFrame([(k, x) for k, s in data.items() for x in s], "set_id long, element long")
    for t in (0.3, 0.5, 0.6, 1.0):
        want = {(a, b) for a in data for b in data if a < b and len(data[a] & data[b]) >= t * len(data[a] | data[b])}
        assert {(x.a, x.b) for x in L.jaccard_pairs(sets, t).collect()} == want


def test_cold_pairs(spark):
    train = spark.createDataFrame([(1, 1, 4.0), (1, 2, 2.0), (2, 1, 5.0)], "u long, i long, s double")
    pairs = spark.createDataFrame([(9, 1), (1, 9), (9, 9), (2, 2)], "u long, i long")
    v1 = {(r.u, r.i): r.prediction for r in R.predict(train, pairs).collect()}
    assert v1 == {(9, 1): 3.75, (1, 9): 3.0, (9, 9): 3.75, (2, 2): 2.0}
    v2 = {(r.u, r.i): r.prediction for r in R.predict(train, pairs, cascade="v2").collect()}
    assert v2 == {(9, 1): 4.5, (1, 9): 3.75, (9, 9): 3.75, (2, 2): 2.0}


def test_repeated_stream(spark):
    b = K.batches(spark.createDataFrame([(k, 1 + k % 4) for k in range(8)], "seq long, item long"), "seq", "item", 4)
    rows = {r.batch: r for r in K.bloom_fpr(b, 69997).collect()}
    assert (rows[1].positives, rows[1].false_positives, rows[1].fpr) == (4, 0, None)


def test_bloom_against_a_loop(spark):
    r = random.Random(2)
    items = [r.randint(0, 90) for _ in range(300)]
    b = K.batches(spark.createDataFrame(list(enumerate(items)), "seq long, item long"), "seq", "item", 20)
    got = {x.batch: (x.n, x.positives, x.false_positives) for x in K.bloom_fpr(b, 97).collect()}
    bits, seen = set(), set()
    for t in range(15):
        batch = items[20 * t : 20 * t + 20]
        h = {x: {((a * x + c) % K.PRIME) % 97 for a, c in K.COEFFICIENTS} for x in batch}
        pos = [x for x in batch if h[x] <= bits]
        assert got[t] == (20, len(pos), sum(x not in seen for x in pos))
        bits |= set().union(*h.values())
        seen |= set(batch)


def test_reservoir_against_a_loop(spark):
    items = [1000 + k for k in range(500)]
    got = {x.slot: x.item for x in K.reservoir(spark.createDataFrame(list(enumerate(items)), "seq long, item long"), "seq", "item", 10).collect()}
    slots = {}
    for n, x in enumerate(items, 1):
        if n <= 10:
            slots[n - 1] = x
        elif ((48271 * n + 11) % 2147483647 % 1000003) * n < 10 * 1000003:
            slots[((69621 * n + 7) % 2147483647) % 10] = x
    assert got == slots


def test_trailing_zeros(spark):
    from millrace.functions.expr import trailing_zeros

    df = spark.createDataFrame([(0,), (1,), (4,), (12,)], "x long")
    assert [r[0] for r in df.select(trailing_zeros(df.x)).collect()] == [0, 0, 2, 2]


def test_constant_dimension(spark):
    p = spark.createDataFrame([(k, [float(k % 3), 5.0], 0) for k in range(9)], "id long, point array<double>, label int")
    assert C.mahalanobis_assign(p, C.cluster_stats(p), 2).where("cluster = 0").count() == 9


def test_bfr_accounts_for_all_points(spark):
    r = random.Random(1)
    pts = [(k, [10.0 * (k % 3) + r.gauss(0, 0.5), r.gauss(0, 0.5)]) for k in range(300)]
    rounds, labels = C.bfr(spark.createDataFrame(pts, "id long, point array<double>"), 3, 2, wide=2, small=5)
    assert labels.count() == labels.select("id").distinct().count() == 300
    last = rounds.orderBy("round").collect()[-1]
    assert last.ds_points + last.cs_points + last.rs_points == 300


def test_streams_equal_batches(spark, tmp_path):
    r = random.Random(5)
    folder = tmp_path / "in"
    folder.mkdir()
    items = [r.randint(0, 60) for _ in range(60)]
    for t in range(3):
        (folder / f"{t}.csv").write_text("".join(f"{x}\n" for x in items[20 * t : 20 * t + 20]))
        import os

        os.utime(folder / f"{t}.csv", (1000 + t, 1000 + t))
    b = K.batches(spark.createDataFrame(list(enumerate(items)), "seq long, item long"), "seq", "item", 20)
    bloom, fm = T.BloomStream(spark, 97, name=f"bloom-{tmp_path.name}"), T.FmStream(spark, 1 << 16)
    T.run_batches(S.read_text_stream(spark, str(folder)), lambda x, n: (bloom.add(x, n), fm.add(x, n)), str(tmp_path / "ck"))
    assert sorted(map(tuple, bloom.result().collect())) == sorted((x.batch, x.n, x.positives, x.false_positives, x.fpr) for x in K.bloom_fpr(b, 97).collect())
    assert sorted(map(tuple, fm.result().collect())) == sorted(map(tuple, K.flajolet_martin(b, 1 << 16).collect()))


def test_event_time_windows(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 01:00:00", "a"), ("2024-01-01 05:00:00", "a"), ("2024-01-02 05:00:00", "b")], "ts string, k string").write.parquet(str(tmp_path / "ev"))
    s = spark.readStream.schema("ts string, k string").parquet(str(tmp_path / "ev"))
    q = T.windowed_counts(s, "ts", "k").writeStream.format("memory").queryName("ev").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.n for r in spark.table("ev").collect()) == [1, 2]


def _text(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*")))


def test_programs(spark, tmp_path):
    review = tmp_path / "review.json"
    review.write_text("\n".join(json.dumps({"user_id": f"u{k % 3}", "business_id": f"b{k % 2}", "stars": k % 5 + 1.0, "date": f"201{7 + k % 2}-01-01"}) for k in range(12)))
    programs.explore(spark, str(review), str(tmp_path / "o1"))
    got = json.loads(_text(tmp_path / "o1"))
    assert (got["n_review"], got["n_review_2018"], got["n_user"], got["n_business"]) == (12, 6, 3, 2) and got["top10_user"][0] == ["u0", "4"]
    csv = tmp_path / "pairs.csv"
    csv.write_text("user_id,business_id\n" + "".join(f"u{u},b{b}\n" for u in range(4) for b in range(3) if (u, b) != (3, 2)))
    programs.itemsets(spark, "1", "3", str(csv), str(tmp_path / "o2"))
    assert "('b0', 'b1', 'b2')" in _text(tmp_path / "o2")
    programs.communities(spark, "2", str(csv), str(tmp_path / "o3"))
    assert _text(tmp_path / "o3").strip() == "'u0', 'u1', 'u2', 'u3'"
    programs.similar(spark, str(csv), str(tmp_path / "o4"))
    assert "b0,b1,1.0" in _text(tmp_path / "o4")
    users = tmp_path / "users.txt"
    users.write_text("".join(f"user{k}\n" for k in range(50)))
    for f in (programs.bloom, programs.flajolet_martin, programs.reservoir):
        f(spark, str(users), "100", "3", str(tmp_path / f.__name__))
        assert len(_text(tmp_path / f.__name__).split()) >= 4
    assert programs.main([]) == 2


def test_loops_have_no_silent_ends(spark):
    b = spark.createDataFrame([(k, [chr(97 + i) for i in range(13)]) for k in range(2)], "basket long, items array<string>")
    assert sorted(r["size"] for r in B.frequent_itemsets(b, 2).groupBy("size").count().collect()) == list(range(1, 14))
    path = spark.createDataFrame([(i, i + 1) for i in range(4)], "u long, v long")
    assert G.shortest_paths(path, max_depth=4).agg({"dist": "max"}).first()[0] == 4
    with pytest.raises(RuntimeError):
        G.shortest_paths(path, max_depth=3)
    with pytest.raises(RuntimeError):
        G.girvan_newman(path, max_cuts=0)
