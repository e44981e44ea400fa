import itertools
import random

import numpy as np

from millrace.llm import near_dedup as N


def brute(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        sets[i] = s
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 70 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def corpus(n=60):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 5)))
    rows = [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one  TWO\n"), (905, "one"), (906, "É a b c d e"), (907, "é a b c d e")]
    for k in range(n):
        text = [word() for _ in range(r.randint(5, 120))]
        rows.append((10 * k + 3, " ".join(text)))
        for j in range(r.randint(0, 6)):  # chains of near copies, of all similarities about the threshold
            for _ in range(r.randint(0, 1 + len(text) // 40)):
                text[r.randrange(len(text))] = word()
            rows.append((10 * k + (3 + 5 * j + 1) % 10, " ".join(text)))
    return list({i: (i, t) for i, t in rows}.values())


def test_against_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, keys string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_dedup(df).collect()}
    assert got == brute(rows)


def test_nulls_repeats_and_empty(spark):
    schema = "doc_id long, text string"
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, None)], schema)
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in N.near_dedup(df).collect()), key=str) == [(4, 4, True), (4, 4, True), (5, 4, False), (None, None, True), (None, None, True)]
    assert N.near_dedup(df.limit(0)).count() == 0


def test_groups_across_components(spark):
    """A chain whose ends the smallest id doesn't reach is closed by the second comparison."""
    r = random.Random(2)
    base = [str(r.random()) for _ in range(400)]
    rows = []
    for k in range(12):
        rows.append((k, " ".join(base)))
        at = 30 * k
        base = base[:at] + [str(r.random()) for _ in range(12)] + base[at + 12 :]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id: (x.n_shingles, x.component_id, x.kept) for x in N.near_dedup(df).collect()} == brute(rows)


def test_estimate_is_close():
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.8):
        a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
        b = np.concatenate([a[: int(2000 * share / (1 + share))], rng.integers(0, 1 << 63, 1000 - int(2000 * share / (1 + share))).astype(np.uint64)])
        x, y = (N.registers(N.sketch(v))[None] for v in (a, b))
        assert abs(N.estimate(x, y, np.array([1000]), np.array([1000]))[0] - share) < 0.2
    merged = np.maximum(N.registers(N.sketch(a)), N.registers(N.sketch(b)))
    assert (merged == N.registers(N.sketch(np.concatenate([a, b])))).all()


def test_blocks_of_a_group(spark, monkeypatch):
    """Groups that are split into many pairs of blocks give the same result."""
    monkeypatch.setattr(N, "GROUP_BLOCK", 2)
    rows = corpus(25)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_dedup(df).collect()} == brute(rows)


def test_many_unlike_texts_share_a_key(spark):
    """6,000 texts with one band in common and else unlike, but for two pairs: all blocks are compared, in bounded time."""
    import time

    rng = np.random.default_rng(4)
    n = 6000
    regs = rng.integers(0, 60_000, (n, N.REGISTERS)).astype(np.uint16)
    regs[:, :3] = 7
    regs[5000], regs[17] = regs[1], regs[3]
    block = rng.integers(0, 2, n)
    rows = []
    for k in range(n):
        b = int(block[k])
        for at, side in ((b, 2), (2, b)):  # its own block, and the two blocks against each other
            rows.append((1, 0, at, k, k, regs[k].tobytes(), 300, side))
    df = spark.createDataFrame(rows, "key long, band int, block long, doc_id long, comp long, sketch binary, n_shingles long, side int")
    began = time.time()
    assert {(r.a, r.b) for r in N._across(df, 0.53).collect()} == {(1, 5000), (3, 17)}
    assert time.time() - began < 120
