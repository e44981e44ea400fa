"""The exact join of sets of all sizes against brute force, and what goes through shuffles for it."""

import random

from test_cooccur import shuffled

from millrace.operators import similarity as L


def test_sets_of_all_sizes(spark):
    r = random.Random(11)
    data = {k: {r.randint(-(10**9), 1 << 33) for _ in range(r.choice([1, 7, 8, 15, 16, 17, 60, 200, 700]))} for k in range(120)}
    for k in range(120, 240):
        old = sorted(data[r.randrange(120)])
        data[k] = set(r.sample(old, max(1, int(len(old) * r.choice([0.5, 0.51, 0.7, 1])))) + [r.randint(0, 1 << 33) for _ in range(r.choice([0, 0, 3, len(old) // 3]))])
    sets = spark.createDataFrame([(f"d{k}", x) for k, s in data.items() for x in s], "set_id string, element long")
    for t in (0.5, 0.2):
        want = {tuple(sorted((f"d{a}", f"d{b}"))) for a in data for b in data if a < b and len(data[a] & data[b]) >= t * len(data[a] | data[b])}
        assert {(x.a, x.b) for x in L.jaccard_pairs(sets, t).collect()} == want
    sig = L.signatures(sets)
    found = {(x.a, x.b) for x in L.candidates(L.bands(sig, 4, 5)).collect()} & {(x.a, x.b) for x in L.jaccard_pairs(sets, 0.5).collect()}
    assert {(x.a, x.b) for x in L.similar_pairs(sets, 4, 5, 0.5).collect()} == found


def test_join_shuffles_no_row_for_each_shared_element(spark):
    r = random.Random(12)
    sets = spark.createDataFrame([(k, x) for k in range(1500) for x in r.sample(range(300), 40)], "set_id long, element long").repartition(4)
    assert shuffled(spark, lambda: L.jaccard_pairs(sets, 0.5).count()) < 2_000_000  # the heads share an element 2.5 million times


def test_candidates_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(L, "SPLIT", 16)
    r = random.Random(13)
    of = {k: [r.choice("xyz" if b < 2 else "abcdefghijklmnop") + str(b) for b in range(6)] for k in range(400)}
    banded = spark.createDataFrame([(f"d{k}", b, v) for k, vs in of.items() for b, v in enumerate(vs)], "set_id string, band int, bucket string")
    want = sorted(tuple(sorted((f"d{a}", f"d{b}"))) for a in of for b in of if a < b and any(x == y for x, y in zip(of[a], of[b])))
    assert sorted(map(tuple, L.candidates(banded).collect())) == want
    one = spark.createDataFrame([(k, 0, "x") for k in range(2000)], "set_id long, band int, bucket string")
    monkeypatch.undo()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        assert shuffled(spark, lambda: L.candidates(one).write.format("noop").mode("overwrite").save()) < 2_000_000  # 2 million pairs
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
