import collections
import hashlib
import random

import numpy as np
import pytest

from millrace.llm.suffix_repeats import Repeats, suffix_repeats


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    words = ["ab", "c", "déf", "x\x00y", "\n", "zz "]
    text = lambda n: "".join(r.choice(words) for _ in range(n))
    passages = [text(20) for _ in range(5)]
    out = [None, "", "a", "q" * 500, "q" * 30, "\x00" * 60, "\x00" * 59]
    for _ in range(60):
        out.append(text(r.randint(0, 30)) + r.choice(passages)[r.randint(0, 5) :] + text(r.randint(0, 30)) + r.choice(passages))
    return out + out[10:14] + [text(3000)]


@pytest.mark.parametrize("hot", [4096, 0])
def test_against_brute_force(spark, hot):
    texts = corpus(3)
    rows = [(None if i == 5 else i, t, "extra") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk string").repartition(3)
    got = suffix_repeats(df, length=20, seed=10, hot=hot, spans=True)
    by = {r.doc_id: r for r in got.collect()}
    assert len(by) == len(texts)
    for (i, t, _), want in zip(rows, brute(texts, 20)):
        g = by[i]
        assert (g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) == want
        assert hashlib.sha256(g.kept).hexdigest() == g.kept_sha256 and len(g.removed) == g.n_spans


def test_empty_and_repeated(spark):
    schema = "doc_id long, text string"
    assert suffix_repeats(spark.createDataFrame([], schema)).count() == 0
    twice = spark.createDataFrame([(1, "ab " * 100), (1, "ab " * 100), (2, "short")], schema)
    assert sorted((r.doc_id, r.n_removed, r.n_spans) for r in suffix_repeats(twice).collect()) == [(1, 300, 1), (1, 300, 1), (2, 0, 0)]


def test_maximal_repeats_against_brute_force():
    """Strings left|right about an anchor: a set of contexts is a maximal repeat if it is all that share o bytes before and t after, and no more bytes."""
    r = np.random.default_rng(6)
    for length in (5, 7):
        ctx = {(bytes(r.integers(0, 2, r.integers(0, 4)).astype(np.uint8)), b"xyz" + bytes(r.integers(0, 2, r.integers(0, 5)).astype(np.uint8))) for _ in range(60)}
        ctx = sorted(ctx)
        w, n = 3, len(ctx)
        left, right, nl, nr = np.zeros((n, w), np.uint8), np.zeros((n, 7), np.uint8), np.array([len(a) for a, _ in ctx]), np.array([len(b) for _, b in ctx])
        for i, (a, b) in enumerate(ctx):
            left[i, : len(a)], right[i, : len(b)] = list(a[::-1]), list(b)
        weight = r.integers(1, 3, n)
        rep = Repeats(left, right, nl, nr, weight, length)
        share = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        want = {(int(nl[i]), int(nr[i]), (i,)) for i in range(n) if weight[i] > 1 and nl[i] + nr[i] >= length}
        for i in range(n):
            for j in range(i):
                o, t = share(ctx[i][0][::-1], ctx[j][0][::-1]), share(ctx[i][1], ctx[j][1])
                if o + t >= length:
                    want.add((o, t, tuple(k for k in range(n) if share(ctx[k][0][::-1], ctx[i][0][::-1]) >= o and share(ctx[k][1], ctx[i][1]) >= t)))
        got = [(o, t, tuple(sorted(some.tolist()))) for o, t, some in rep.groups()]
        assert len(got) == len(set(got)) and set(got) == want
        before, after = rep.cover()
        for i in range(n):
            mine = [g for g in want if i in g[2]]
            assert (before[i], after[i]) == (max([g[0] for g in mine], default=0), max([g[1] for g in mine], default=0))


@pytest.mark.parametrize("hot", [4096, 0])
def test_groups_cover_what_is_removed(spark, hot):
    texts = corpus(5)
    raw = [(t or "").encode() for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = suffix_repeats(df, length=20, seed=10, hot=hot, groups=True).collect()
    by = collections.defaultdict(set)
    gone = {i: set() for i in range(len(texts))}
    for x in rows:
        by[x.group].add(raw[x.doc_id][x.start : x.end])
        gone[x.doc_id] |= set(range(x.start, x.end))
    assert all(len(v) == 1 and len(next(iter(v))) >= 20 for v in by.values())
    assert all(n > 1 for n in collections.Counter(x.group for x in rows).values())
    assert [len(gone[i]) for i in range(len(texts))] == [w[1] for w in brute(texts, 20)]


def test_bounds_of_length(spark):
    with pytest.raises(ValueError):
        suffix_repeats(spark.createDataFrame([(1, "a")], "doc_id long, text string"), length=300)


def test_shuffle_files_go_with_their_step(spark):
    """Before the texts are cut only the last step's shuffle files may be left on disk: those of its three exchanges."""
    import time

    from millrace.llm._store import release

    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return {x for x in (files.apply(i).getName() for i in range(files.size())) if x.startswith("shuffle")}

    release(spark)
    time.sleep(2)
    before = shuffled()
    out = suffix_repeats(spark.createDataFrame([(i, f"{i} " * 20 + "ab " * 100) for i in range(20)], "doc_id long, text string"))
    time.sleep(2)
    left = {x.split("_")[1] for x in shuffled() - before}
    assert len(left) <= 3, left
    assert out.count() == 20


def test_steps_leave_little_memory_and_disk(spark, monkeypatch):
    """After each step's table the heap is given back, the matches are a few files, and in the end not all files of the last three shuffles are left."""
    import time
    from pathlib import Path

    from millrace.llm import suffix_repeats as module
    from millrace.llm._store import release, settle, table

    did, files = [], {}

    def noted_table(df, name, *rest, **more):
        made, path = table(df, name, *rest, **more)
        did.append(name)
        files[name] = len(list(Path(path.removeprefix("file:")).glob("*.parquet")))
        return made, path

    monkeypatch.setattr(module, "table", noted_table)
    monkeypatch.setattr(module, "settle", lambda s: (did.append("settle"), settle(s)), raising=False)
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        found = disk.getAllFiles()
        return {x for x in (found.apply(i).getName() for i in range(found.size())) if x.startswith("shuffle")}

    release(spark)
    time.sleep(2)
    before = shuffled()
    out = suffix_repeats(spark.createDataFrame([(i, f"{i} " * 20 + " ".join(str(j * j) for j in range(i, i + 400))) for i in range(40)], "doc_id long, text string"), length=40, seed=20, buckets=64)
    for _ in range(20):
        if left := {x.split("_")[1] for x in shuffled() - before}:
            time.sleep(0.5)
    assert did == ["chunks", "settle", "anchors", "settle", "repeats", "settle"]
    assert files["repeats"] <= 2, files  # of 16 tasks
    assert len(left) < 3, left
    assert out.count() == 40
