import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from millrace.llm.class_lm import class_lm, exchange
from millrace.llm.language_id import language_id
from millrace.llm.piece_bpe import Cache, encode_texts, load, piece_bpe
from millrace.llm.toxicity import toxicity

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def test_language(spark, docs):
    import pyspark.sql.functions as F

    odd = spark.createDataFrame([(None, None), (100_001, ""), (100_002, "12 !?\n"), (100_003, "the of and the of " * 5000), (100_003, "der die das und nicht")], "doc_id long, text string")
    got = language_id(docs.select("doc_id", "text", "lang", F.lit(1.5).alias("score")).unionByName(odd, allowMissingColumns=True)).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id", "left").collect()
    assert len(got) == docs.count() + 5
    held = [r for r in got if r.truth and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert sum(r.lang_pred == r.truth for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in got if r.doc_id in (None, 100_001, 100_002)} == {"und"}
    assert sorted(r.lang_pred for r in got if r.doc_id == 100_003) == ["de", "en"]
    assert language_id(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id(docs.limit(5).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity(spark, docs):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    odd = spark.createDataFrame([(None, None), (100_001, ""), (100_002, "so " * 40_000)], "doc_id long, text string")
    rows = toxicity(docs.select("doc_id", "text").unionByName(odd), labels.union(labels.limit(2)).union(spark.createDataFrame([(1, None, None)], labels.schema))).collect()
    assert len(rows) == docs.count() + 3
    y = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [r for r in rows if r.held_out and y.get(r.doc_id) is not None]
    pos, neg = [r.score for r in held if y[r.doc_id]], [r.score for r in held if not y[r.doc_id]]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]) > 0.75
    assert np.mean([r.predicted for r in held if not y[r.doc_id]]) < 0.05
    assert {r.score for r in toxicity(docs.limit(3), labels.limit(0)).collect()} == {0.5}
    assert toxicity(docs.limit(0), labels).count() == 0


def test_class_lm(spark):
    r = random.Random(5)
    langs = [[["the", "a"], ["cat", "dog", "cow"], ["sees", "eats"]], [["le", "un"], ["chat", "chien"], ["voit", "mange"]]]
    texts = {}
    for i in range(120):
        g = r.choice(langs)
        texts[i] = " ".join(r.choice(g[k % 3]) if r.random() > 0.1 else f"w{r.randint(0, 60)}" for k in range(r.randint(0, 40)))
    texts |= {200: None, 201: "", 202: "The CAT " * 3000, 203: "neverseen"}
    df = spark.createDataFrame([(i, t, 1.0) for i, t in texts.items()], "doc_id long, text string, score double").repartition(3)
    got = {x.doc_id: x for x in class_lm(df).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    words = {i: [*(t or "").encode().lower().split(), None] for i, t in texts.items()}
    c = collections.Counter(w for i in texts if not held[i] for w in words[i])
    n, v = sum(c.values()), len(c)
    for i, w in words.items():
        x = got[i]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[i], len(w), sum(c[k] > 0 for k in w), n)
        assert math.isclose(x.base_score, sum(math.log10((c[k] + 1) / (n + v + 1)) for k in w), rel_tol=1e-9)
        assert x.score < 0
    assert sum(x.score for x in got.values() if x.held_out) > sum(x.base_score for x in got.values() if x.held_out)
    assert class_lm(df.limit(0)).count() == 0


def test_exchange_ends_where_no_move_helps():
    """Brute force over all single moves, on counts with two languages that don't mix."""
    r = np.random.default_rng(1)
    n = np.zeros((14, 14))
    n[:6, :6] = r.integers(0, 9, (6, 6))
    n[6:12, 6:12] = r.integers(0, 9, (6, 6))
    n[12:, :] = n[:, 12:] = 1

    def likelihood(g):
        full = np.concatenate([g, [3, 4]])
        one = np.eye(5)[full]
        c = one.T @ n @ one
        f = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0).sum()
        return f(c) - f(c.sum(0)) - f(c.sum(1))

    g = exchange(n, 3, rounds=50)
    assert likelihood(g) > likelihood(np.arange(12) % 3)
    for w in range(12):
        for k in range(3):
            assert likelihood(np.where(np.arange(12) == w, k, g)) <= likelihood(g) + 1e-6


def test_pieces_like_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    tokenizers = pytest.importorskip("public_tokenizers")
    path = tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(1)
    parts = ["▁", " ", "  ", "a", "t", "h", "e", "in", "é", "ß", "中", "\n", "\t", "\x00", "😀", "1", "=", "----", "▁ ", "<s>", "<0x0A>", "...", "\u0301", "\u200b", "\ufeff", "\r\n", "\ufffd", "    "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["", " " * 50 + "a" + " " * 33, "a" * 400, "=" * 77] + [" " * i for i in range(40)]
    got = encode_texts(load(path), [t.encode() for t in texts], Cache())
    for t, (ids, back) in zip(texts, got):
        want = sp.encode(t)
        assert ids == ",".join(map(str, want)) and back == sp.decode(want).encode()
    df = spark.createDataFrame([(None, None, 1), (1, "", 1), (2, "a b", 1), (2, "a b", 1), (3, "x " * 50_000, 1)], "doc_id long, text string, n_tokens int")
    rows = piece_bpe(df, path, ids=True).collect()
    assert len(rows) == 5
    for x, t in zip(sorted(rows, key=lambda x: (x.doc_id or 0)), [None, "", "a b", "a b", "x " * 50_000]):
        want = sp.encode(t or "")
        assert x.ids == want and x.n_tokens == len(want) and x.decoded_sha256 == hashlib.sha256(sp.decode(want).encode()).hexdigest()
    assert piece_bpe(df.limit(0), path).count() == 0


def test_long_words_like_the_library():
    import time

    sentencepiece = pytest.importorskip("sentencepiece")
    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(2)
    texts = ["".join(r.choice(letters) for _ in range(n)) for letters in ("a", "ab", "etaoinshrdlu", "éa中=", "0123456789abcdef") for n in (255, 256, 257, 300, 3000)]
    for t, (ids, back) in zip(texts, encode_texts(load(path), [t.encode() for t in texts], Cache())):
        want = sp.encode(t)
        assert ids == ",".join(map(str, want)) and back == sp.decode(want).encode()
    t = "".join(r.choice("etaoinshrdlu") for _ in range(1_000_000))
    began = time.time()
    ((ids, _),) = encode_texts(load(path), [t.encode()], Cache())
    assert time.time() - began < 120 and ids.count(",") > 100_000


def test_contexts_and_gains_by_brute_force():
    """Counts of the states around words, and the gain of a word in each class as the change of mutual information."""
    from millrace.llm.class_lm import bucket_of, contexts, gains

    r = np.random.default_rng(2)
    words, states, end = 9, 5, 4
    flat = r.integers(0, words + 1, 200)  # the last number is a text's end
    flat[-1] = words
    state = np.append(r.integers(0, 4, words), end)[flat]
    mine = (flat < words) & (r.random(200) < 0.8)
    want = collections.Counter()
    for i in np.flatnonzero(mine).tolist():
        want[flat[i], state[i - 1] if i else end] += 1
        want[flat[i], states + state[i + 1]] += 1
    k, code, times = contexts(flat, mine, state, states, end, words)
    who = np.repeat(np.arange(words), k)
    assert dict(zip(zip(who.tolist(), code.tolist()), times.tolist())) == want
    table = r.normal(size=(2 * states, 4)).astype(np.float32)
    twice = gains(np.append(who, who), np.append(code, code), np.append(times, times), words, table)
    for w in range(words):
        assert np.allclose(twice[w], 2 * sum(n * table[c] for (v, c), n in want.items() if v == w), atol=1e-3)
    h = np.sort(r.integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    b = bucket_of(h, 7)
    assert (np.diff(b) >= 0).all() and b.min() == 0 and b.max() == 6


def test_class_lm_steps_leave_little_memory(spark, monkeypatch):
    """After each step's table the heap is given back, and classes and contexts are a few files."""
    from pathlib import Path

    from millrace.llm import class_lm as module
    from millrace.llm._store import settle, table

    did, files = [], {}

    def noted_table(df, name, *rest, **more):
        made, path = table(df, name, *rest, **more)
        did.append(name)
        files[name] = max(files.get(name, 0), len(list(Path(path.removeprefix("file:")).glob("*.parquet"))))
        return made, path

    monkeypatch.setattr(module, "table", noted_table)
    monkeypatch.setattr(module, "settle", lambda s: (did.append("settle"), settle(s)), raising=False)
    r = random.Random(7)
    df = spark.createDataFrame([(i, " ".join(f"w{r.randint(0, 300)}" for _ in range(60))) for i in range(80)], "doc_id long, text string").repartition(3)
    out = class_lm(df, buckets=64)
    assert files["classes"] <= 2 and files["contexts"] <= 2, files  # of 16 tasks
    steps = [k for k in did if k != "settle"]
    assert all(did[i + 1] == "settle" for i, k in enumerate(did) if k != "settle") and steps[:3] == ["tokens", "counts", "classes"], did
    assert out.count() == 80
