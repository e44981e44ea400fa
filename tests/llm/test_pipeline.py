import collections
import hashlib
import itertools
import random

import pytest

import corpus_pipeline
from millrace.llm.decontaminate import align, decontaminate
from millrace.llm.line_dedup import line_dedup


def brute_lines(rows, min_words):
    """rows: (id, text), ids distinct. Compares all places with all earlier ones: lines of maximal equal runs with min_words words go."""
    at = []  # (text, line, content, words)
    texts = {}
    for i, t in sorted(rows):
        texts[i] = (t or "").split("\n")
        at += [(i, k, x.strip(" \t\n\r\v\f"), len(x.split())) for k, x in enumerate(texts[i]) if x.split()]
    total = list(itertools.accumulate((x[3] for x in at), initial=0))
    gone = collections.defaultdict(set)
    for shift in range(1, len(at)):  # each place with the one `shift` before it
        p = shift
        while p < len(at):
            n = 0
            q = p - shift
            while p + n < len(at) and at[p + n][2] == at[q + n][2] and at[p + n][0] == at[p][0] and at[q + n][0] == at[q][0]:
                n += 1
            most = n if at[p][0] != at[q][0] else min(n, shift)  # runs of one text that don't overlap
            for k in range(n):
                m = min(most, n - k)
                if total[p + k + m] - total[p + k] >= min_words:
                    gone[at[p][0]].update(range(at[p + k][1], at[p + k + m - 1][1] + 1))
            p += max(1, n)
    return {i: "\n".join(x for k, x in enumerate(lines) if k not in gone[i]) for i, lines in texts.items()}


def test_lines_against_brute_force(spark):
    r = random.Random(8)
    line = lambda: " ".join(r.choice("abcdefghij") for _ in range(r.randint(0, 6)))
    runs = [[line() for _ in range(r.randint(1, 6))] for _ in range(6)]
    rows = [(i, "\n".join(sum([r.choice(runs) if r.random() < 0.5 else [line()] for _ in range(r.randint(0, 8))], []))) for i in range(80)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "q " * 20_000 + "\n" + "q " * 20_000), (104, "a b c\n" * 40), (105, "x y\nz w\n" * 9)]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, _h string, _gone int").repartition(3)
    got = {x.doc_id: x.text for x in line_dedup(df, min_words=8, drop_empty=False).collect()}
    want = brute_lines(rows, 8)
    assert got == {i: None if t is None else want[i] for i, t in rows}
    assert line_dedup(df.limit(0)).count() == 0
    assert line_dedup(df, min_words=8).columns == df.columns


def slow_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
    return max(map(max, h))


def test_alignment_against_brute_force():
    import numpy as np

    r = np.random.default_rng(2)
    pairs = [(r.integers(0, 6, r.integers(1, 12)).astype(np.uint64) << np.uint64(3), r.integers(0, 6, r.integers(0, 20)).astype(np.uint64) << np.uint64(3)) for _ in range(60)]
    assert align([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [slow_align(a.tolist(), b.tolist()) for a, b in pairs]


def test_decontamination(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    items = [[word() for _ in range(r.randint(16, 50))] for _ in range(12)]
    rows = [(i, " ".join(word() for _ in range(200))) for i in range(40)] + [(41, None), (42, "")]
    for k, it in enumerate(items):
        edited = [w if r.random() > 0.12 else word() for w in it]
        del edited[r.randrange(len(edited))]
        rows.append((100 + k, " ".join([word() for _ in range(100)] + [w.upper() + "," for w in (it if k % 2 else edited)] + [word() for _ in range(500)])))
    docs = spark.createDataFrame([(i, t, "m") for i, t in rows], "doc_id long, text string, _match string").repartition(2)
    bench = spark.createDataFrame([(k, " ".join(it)) for k, it in enumerate(items)] + [(90, None), (91, ""), (92, "...")], "item_id long, text string")
    left = {x.doc_id for x in decontaminate(docs, bench).collect()}
    assert left == {i for i, _ in rows if i < 100}
    assert decontaminate(docs.limit(0), bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).count() == len(rows)


def test_decontamination_of_edited_copies(spark):
    r = random.Random(10)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    items, rows = [], []
    for k in range(48):
        it = [word() for _ in range(r.randint(15, 50))]
        if k % 6 == 4:  # every third word
            edited = [word() if j % 3 == 2 else w for j, w in enumerate(it)]
        elif k % 6 == 5:  # a word after each
            edited = [x for w in it for x in (w, word())]
        else:
            gone = set(r.sample(range(len(it)), round(len(it) * (0.2, 0.25, 0.3, 0.33)[k % 6])))
            edited = [word() if j in gone else w for j, w in enumerate(it)]
        items.append(it)
        rows.append((k, [word() for _ in range(60)] + edited + [word() for _ in range(60)]))
        if k % 12 < 6:  # beside an exact copy
            rows.append((100 + k, [word() for _ in range(20)] + it))
    docs = spark.createDataFrame([(i, " ".join(x)) for i, x in rows], "doc_id long, text string").repartition(2)
    bench = spark.createDataFrame([(k, " ".join(it)) for k, it in enumerate(items)], "item_id long, text string")
    got = {x.doc_id: x for x in decontaminate(docs, bench, keep_all=True).collect()}
    want = {i: slow_align(items[i % 100], x) / (2 * len(items[i % 100])) for i, x in rows}
    assert sum(v >= 0.5 for i, v in want.items() if i < 100) > 30
    for i, v in want.items():
        assert got[i].contaminated == (v >= 0.5), (i, v)
        assert got[i].match == v or v < 0.5


def test_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, n = docs.columns, docs.count()
    odd = spark.createDataFrame([(None, None, None, None, None), (5000, "", "en", "s", 0), (5001, "word " * 40_000, None, None, 200_000)], docs.schema)
    at = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, folder).checkpoint()
        assert at.columns == columns, name
        assert 0 < at.count() <= n + 3
        assert stage(spark, docs.limit(0), folder).count() == 0, name
    last = corpus_pipeline.STAGES[-1][1](spark, at, folder)
    assert last.count() == at.count()
    assert corpus_pipeline.run(spark, folder).count() > 0


def test_queries_cover_all_documents(spark):
    from millrace.llm.queries import queries

    folder = "/root/testdata/sf0.001"
    names = {f"op{n}_": [k for k in queries() if k.startswith(f"op{n}_")] for n in range(1, 11)}
    assert all(len(v) == 1 for v in names.values())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id: r.kept_sha256 for r in queries()["op6_line_dedup"](spark, folder).collect()}
    want = brute_lines([(r.doc_id, r.text) for r in docs.collect()], 25)
    assert kept == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}
    found = {r.doc_id: r for r in queries()["op5_decontaminate"](spark, folder).collect()}
    assert len(found) == docs.count()
    items = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for r in docs.collect():
        if any(x in " ".join(r.text.lower().split()) for x in items):
            assert found[r.doc_id].contaminated and not found[r.doc_id].kept


def test_winnowing_selects_few_lines():
    import numpy as np

    from millrace.llm.line_dedup import winnow

    r = np.random.default_rng(1)
    h, words = r.integers(0, 1 << 63, 4000).astype(np.uint64), r.integers(1, 9, 4000)
    doc = np.sort(r.integers(0, 30, 4000))
    a, z, least = winnow(h, words, doc, 25)
    assert len(np.unique(least)) < 0.5 * len(h)
    assert (doc[a] == doc[z]).all() and all(words[p : q + 1].sum() >= 25 and h[k] == h[p : q + 1].min() for p, q, k in zip(a, z, least))


def test_stages_begin_with_a_small_heap(spark):
    """What a stage has grown isn't kept beside the next one's Python: driver and executors (here one JVM) collect first."""
    folder, jvm = "/root/testdata/sf0.001", spark.sparkContext._jvm
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    full = lambda: sum(b.getCollectionCount() for b in jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    before = full()
    corpus_pipeline.STAGES[3][1](spark, docs, folder)
    assert full() >= before + 2
