"""Pairs that share groups against brute force, and what goes through shuffles for them."""

import random
from collections import Counter
from itertools import combinations

import pytest

from millrace.operators import cooccur as O
from millrace.operators import graph as G
from millrace.operators import recommend as R


def shuffled(spark, run):
    """Bytes written to shuffles while ``run`` runs."""
    sc = spark.sparkContext
    java, none = sc._jvm.java.util.ArrayList, sc._gateway.new_array(sc._jvm.double, 0)
    total = lambda: sum(s.shuffleWriteBytes() for s in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(java(), False, False, none, java())))
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    before = total()
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before


@pytest.mark.parametrize("kind", ["int", "long", "far", "string"])
@pytest.mark.parametrize("repeats", [False, True])
def test_against_brute_force(spark, monkeypatch, kind, repeats):
    monkeypatch.setattr(O, "_TASK", 100)
    r = random.Random(2)
    lists = {g: [r.randint(0, 30) for _ in range(r.choice([0, 1, 2, 9, 40]))] for g in range(40)}
    of = {"int": int, "long": int, "far": lambda k: k * 10**10 - 7, "string": lambda k: f"k{k:02d}"}[kind]
    rows = [(g, of(k)) for g, ks in lists.items() for k in ks] + [(None, of(1)), (3, None)]
    df = spark.createDataFrame(rows, f"g int, k {({'int': 'int', 'string': 'string'}).get(kind, 'long')}")
    want = Counter()
    for ks in lists.values():
        want.update((of(a), of(b)) for a, b in combinations(sorted(ks if repeats else set(ks)), 2) if a != b)
    for least in (1, 4):
        out = O.co_counts(df, "g", "k", least, repeats=repeats)
        assert out.schema["k"].dataType == df.schema["k"].dataType
        assert {(x.k, x.other): x.n for x in out.collect()} == {p: n for p, n in want.items() if n >= least}
    assert O.co_counts(df.limit(0), "g", "k").count() == 0


def test_counts_are_added_up_in_parts(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(O, "_HELD", 50)
    r = random.Random(4)
    lists = [sorted(r.sample(range(60), 30)) for _ in range(20)]
    want = Counter(p for x in lists for p in combinations(x, 2))
    tails = list(O._tails(iter([pa.RecordBatch.from_arrays([pa.array(lists[k : k + 7], pa.list_(pa.int32()))], ["all"]) for k in range(0, 20, 7)])))
    assert len(tails) > 20
    got = {(k.as_py(), o.as_py()): n.as_py() for b in O._counter(1, None)(iter(tails)) for k, o, n in zip(*b.columns)}
    assert got == want
    best = {(k.as_py(), o.as_py()): n.as_py() for b in O._counter(1, 10)(iter(tails)) for k, o, n in zip(*b.columns)}
    tenth = sorted(want.values())[-10]
    assert best == {p: n for p, n in want.items() if n >= tenth}


def test_similarity_shuffles_no_row_for_each_pair(spark):
    rows = [(u, i, float(1 + (u * i) % 5)) for u in range(8) for i in range(u * 1000, u * 1000 + 1000)]  # no common users: 4 million pairs
    df = spark.createDataFrame(rows, "u long, i long, s double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with large tables
    try:
        assert shuffled(spark, lambda: R.item_similarity(df).count()) < 2 * 8 * 1000 * 500
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_top_edges_keep_no_row_for_each_pair(spark, monkeypatch):
    monkeypatch.setattr(O, "_TASK", 5000)
    r = random.Random(8)
    rows = [(u, i) for i in range(60) for u in r.sample(range(150), 25)]
    df = spark.createDataFrame(rows, "u long, i long")
    for least in (5, 100_000):
        edges = G.edges_with(G.copairs(df, "u", "i"), least)
        assert sorted(map(tuple, G.top_edges(df, "u", "i", least).collect())) == sorted(map(tuple, edges.collect()))
    monkeypatch.undo()
    apart = spark.createDataFrame([(u, u // 1000) for u in range(8000)], "u long, i long")  # 4 million pairs
    assert shuffled(spark, lambda: G.copairs(apart, "u", "i").where("n > 1").count()) < 2 * 8 * 1000 * 500
