"""Scores texts by a Brown class-based bigram model, and by a smoothed unigram base.

Words fall into classes by exchange clustering: a word moves to the class where
the likelihood of the class bigrams gains most. It starts with the ``TOP`` most
frequent words, one at a time in the driver until nothing moves (their bigram
counts have a proven bound of (TOP + 2) ** 2, whatever the corpus), by whose
classes all others are placed. Then the whole vocabulary takes part, in parallel
rounds: each chunk of texts counts the classes before and after each of its
words, each bucket of the vocabulary adds up its words' counts and moves them
by the gain under the class bigrams of the round, which are counted anew over
all words; frequent words move every other round, so that they don't chase each
other. It ends when under ``STILL`` of all tokens are in words that moved, or
after ``rounds`` rounds. A text's score adds up class transitions and word
emissions; absolute discounting leaves mass in each class for words that
training hasn't seen, which count as one type, as in the base.

The vocabulary grows with the corpus and is never broadcast. Chunks of texts
ask for their distinct words, buckets of the vocabulary (by hash) gather counts
and contexts from all chunks and answer each chunk; both ways carry flat
arrays. A word that all texts share costs one entry a chunk.

Defined results: a null text is empty and has its end token only; a null id is
a training row; repeated rows are texts of their own; an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from inspect import getfullargspec

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ._blobs import chunked, columns, pack, split, unpack
from ._store import drop_table, release, settle, table
from ._text import U64, doc_of, prefix_hash, span_hash, trim

TOP, CLASSES = 1024, 64  # classes of the most frequent words at first, and as many of others; then all are open to all
STILL = 0.01
CHUNK_BYTES = (1 << 22) - 16
END, STATES, UNSEEN = 2 * CLASSES, 2 * CLASSES + 1, 255


def exchange(n: np.ndarray, classes: int, rounds: int = 12) -> np.ndarray:
    """Class of each word from bigram counts ``n`` (the last two rows and columns are other words and the end, fixed classes)."""
    m = len(n) - 2
    k = min(classes, max(m, 1))
    g = np.concatenate([np.arange(m) % k, [k, k + 1]])
    s = k + 2
    xlogx = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)
    n = n.astype(np.float64)
    one = np.zeros((len(n), s))
    one[np.arange(len(n)), g] = 1
    c = one.T @ n @ one
    for _ in range(rounds):
        moved = 0
        for w in range(m):
            a, own = g[w], n[w, w]
            right = np.bincount(g, n[w], s)
            left = np.bincount(g, n[:, w], s)
            right[a] -= own
            left[a] -= own
            c[a] -= right
            c[:, a] -= left
            c[a, a] -= own
            f = xlogx(c)
            gain = (xlogx(c[:k] + right) - f[:k]).sum(1) + (xlogx(c[:, :k] + left[:, None]) - f[:, :k]).sum(0)
            i = np.arange(k)
            d = c[i, i]
            gain += xlogx(d + right[:k] + left[:k] + own) + xlogx(d) - xlogx(d + right[:k]) - xlogx(d + left[:k])
            row, col = c.sum(1)[:k], c.sum(0)[:k]
            gain -= xlogx(row + right.sum() + own) - xlogx(row) + xlogx(col + left.sum() + own) - xlogx(col)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += b != a
            g[w] = b
            c[b] += right
            c[:, b] += left
            c[b, b] += own
        if not moved:
            break
    return g[:m]


def bucket_of(h: np.ndarray, nb: int) -> np.ndarray:
    """Buckets in the order of hashes, so that sorted words are sorted by bucket."""
    return (((h >> U64(32)) * U64(nb)) >> U64(32)).astype(np.int64)


def contexts(flat: np.ndarray, mine: np.ndarray, state: np.ndarray, states: int, end: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word how many (side, state) entries it has, the entries (side * states + state) and their counts, over the marked tokens."""
    before, after = np.append(end, state[:-1]), np.append(state[1:], end)
    w = flat[mine].astype(np.int64) * (2 * states)
    key, times = np.unique(np.concatenate([w + before[mine], w + states + after[mine]]), return_counts=True)
    return np.bincount(key // (2 * states), minlength=words), key % (2 * states), times


def gains(word: np.ndarray, code: np.ndarray, times: np.ndarray, n_words: int, table: np.ndarray) -> np.ndarray:
    """(words, classes): each word's sum over its entries of ``table``'s rows."""
    states2 = len(table)
    key, inv = np.unique(word * states2 + code, return_inverse=True)
    times = np.bincount(inv.ravel(), times)
    word, code = key // states2, key % states2
    out = np.zeros((n_words, table.shape[1]), np.float32)
    for a in range(0, len(key), 100_000):
        w = word[a : a + 100_000]
        cut = np.flatnonzero(np.append(True, w[1:] != w[:-1]))
        out[w[cut]] += np.add.reduceat(table[code[a : a + 100_000]] * times[a : a + 100_000, None].astype(np.float32), cut)
    return out


def _mutual(c: np.ndarray, classes: int) -> np.ndarray:
    """(2 * states, classes): log ratios of class bigrams to chance, for a class after a state and for a state after a class."""
    total = c.sum() + 1
    row, col = c.sum(1) + 0.5, c.sum(0) + 0.5
    pmi = np.log((c + 0.5 * np.outer(row, col) / total + 1e-9) / np.outer(row, col) * total)
    empty = c.sum(1)[:classes] == 0
    table = np.vstack([pmi[:, :classes], pmi[:classes].T])
    table[:, empty] = -50.0
    return table.astype(np.float32)


def _trimmed(f: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """``f`` (of one table or two), whose worker then gives its freed memory back."""

    def one(t: pa.Table) -> pa.Table:
        out = f(t)
        trim()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        trim()
        return out

    return one if len(getfullargspec(f).args) == 1 else two


def _class_bigrams(n: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Bigrams of states from those of words; states: classes, other words, end."""
    one = np.zeros((len(n), CLASSES + 2))
    one[np.arange(len(n)), np.concatenate([g, [CLASSES, CLASSES + 1]])] = 1
    return one.T @ n.astype(np.float64) @ one


def class_lm(df: DataFrame, held_out: F.Column | None = None, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None, rounds: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    ``held_out``: a boolean column, texts that aren't learned from; by default crc32 of the id's text mod 7 = 2.
    ``buckets``: shares of the vocabulary; as many as chunks of texts if None. ``rounds``: most parallel rounds of exchange.
    """
    spark = df.sparkSession
    ship(spark)
    sc = spark.sparkContext
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(df.dtypes)[doc_id]
    if held_out is None:
        held_out = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 7 == 2
    i32, i64, binary = pa.int32(), pa.int64(), pa.binary()

    def rest() -> None:
        """After a step: executors give back the heap that it has grown, and its shuffle files go, the last ones when another job, here settle's, has run."""
        settle(spark)
        release(spark)

    def few(d: DataFrame) -> DataFrame:
        """The same rows for few files: to make one, an executor starts processes, when its heap is largest."""
        return d.hint("rebalance", "chunk")

    # 1: chunks of texts as token numbers, with their distinct words
    def tokens(batches):
        for number, b, (ids, held) in chunked(batches, CHUNK_BYTES, lower=True):
            s, e, first = b.words()
            h, inv = np.unique(span_hash(prefix_hash(b.buf), s, e), return_inverse=True)
            held = held.to_numpy(zero_copy_only=False).astype(bool)
            n = np.bincount(inv[~held[doc_of(first)]], minlength=len(h))
            flat = np.insert(inv.ravel(), first[1:], len(h)).astype(np.int32)  # an end after each text
            out = columns(True, chunk=([number], i64), held=([held.tobytes()], binary), first=([pack((first + np.arange(b.n + 1)).astype(np.int32))], binary), flat=([pack(flat)], binary), hashes=([h.tobytes()], binary), n=([pack(n.astype(np.int32))], binary))
            del b, s, e, h, inv, n, flat
            trim()
            yield out.append_column("ids", pa.array([ids.to_pylist()], pa.list_(ids.type)))

    src = df.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    parts, p_parts = table(src.mapInArrow(tokens, f"chunk long, held binary, first binary, flat binary, hashes binary, n binary, ids array<{kind}>"), "tokens", codec="uncompressed")
    rest()

    nb = buckets or max(32, parts.count())
    # tasks' shares stay as they are, however many there are
    spread = lambda d, key: d.repartition(nb // 4, key) if nb // 4 > usual else d

    # 2: size of the vocabulary, and the most frequent words
    def ask_counts(batches):
        for batch in batches:
            for row in batch.to_pylist():
                h, n = np.frombuffer(row["hashes"], U64), unpack(row["n"], np.int32)
                h, n = h[n > 0], n[n > 0]
                rows = [(b, h[i].tobytes(), pack(n[i])) for b, i in split(bucket_of(h, nb))]
                yield columns(True, bucket=([r[0] for r in rows], i32), hashes=([r[1] for r in rows], binary), n=([r[2] for r in rows], binary))

    def count(t: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(x, U64) for x in t["hashes"].to_pylist()])
        u, inv = np.unique(h, return_inverse=True)
        n = np.bincount(inv, np.concatenate([unpack(x, np.int32) for x in t["n"].to_pylist()])).astype(np.int64)
        top = np.lexsort((u, -n))[:TOP]
        sums = [len(u), int(n.sum()), int((n == 1).sum()), int((n == 2).sum())]
        return columns(hash=([0] * 4 + u[top].view(np.int64).tolist(), i64), n=(sums + n[top].tolist(), i64), what=([0, 1, 2, 3] + [4] * len(top), i32))

    counted, p_counted = table(spread(parts.select("hashes", "n").mapInArrow(ask_counts, "bucket int, hashes binary, n binary"), "bucket").groupBy("bucket").applyInArrow(_trimmed(count), "hash long, n long, what int"), "counts")
    sums = {r.what: int(r.n) for r in counted.where("what < 4").groupBy("what").agg(F.sum("n").alias("n")).collect()}
    ends = int(src.where(~F.col("held_out")).count())
    types, total = sums.get(0, 0) + (ends > 0), sums.get(1, 0) + ends
    d = sums.get(2, 0) / max(1, sums.get(2, 0) + 2 * sums.get(3, 0))
    d = min(max(d, 0.05), 0.95)
    top = counted.where("what = 4").orderBy(F.desc("n"), "hash").limit(TOP).toArrow()
    drop_table(spark, p_counted)
    rest()
    top_hash, top_n = top["hash"].to_numpy().view(U64), top["n"].to_numpy()
    by = np.argsort(top_hash)
    top_hash, top_n = top_hash[by], top_n[by]
    m = len(top_hash)

    def place(h: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Index of each hash in ``known``; its length where it isn't there."""
        if not len(known):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return np.where(known[at] == h, at, len(known))

    def learned(row) -> tuple[np.ndarray, np.ndarray]:
        """A chunk's tokens, and which of them are training's."""
        flat = unpack(row["flat"], np.int32)
        held = np.frombuffer(row["held"], bool)
        return flat, np.repeat(~held, np.diff(unpack(row["first"], np.int32)))

    # 3: bigrams of the most frequent words, and their classes
    top_b = sc.broadcast(top_hash)  # TOP words at most

    def pairs(batches):
        seen = np.zeros((m + 2) ** 2, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                flat, train = learned(row)
                t = np.append(place(np.frombuffer(row["hashes"], U64), top_b.value), m + 1)[flat]
                seen += np.bincount((np.concatenate([[m + 1], t[:-1]]) * (m + 2) + t)[train], minlength=len(seen))
        k = np.flatnonzero(seen)
        for a in range(0, len(k), 200_000):
            yield columns(True, pair=(k[a : a + 200_000], i64), n=(seen[k[a : a + 200_000]], i64))

    got = parts.select("flat", "first", "held", "hashes").mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    bigrams = np.zeros((m + 2) ** 2)
    bigrams[got["pair"].to_numpy()] = got["n"].to_numpy()
    bigrams = bigrams.reshape(m + 2, m + 2)
    rest()
    cls_top = exchange(bigrams[np.ix_(*[np.concatenate([np.argsort(-top_n, kind="stable"), [m, m + 1]])] * 2)], CLASSES) if m else np.empty(0, np.int64)
    back = np.empty(m, np.int64)
    back[np.argsort(-top_n, kind="stable")] = cls_top
    cls_top = back
    model = sc.broadcast((top_hash, cls_top, _mutual(_class_bigrams(bigrams, cls_top), CLASSES)))

    # 4: counts of all words, and classes of all others, by bucket
    def entries(chunk: int, h: np.ndarray | None, n: np.ndarray | None, bucket: np.ndarray, made) -> pa.RecordBatch:
        """A chunk's words (sorted by hash) with their contexts, cut by bucket."""
        k, code, times = made
        start = np.concatenate([[0], np.cumsum(k)])
        cut = np.searchsorted(bucket, np.arange(nb + 1))
        some = np.flatnonzero(cut[1:] > cut[:-1]).tolist()
        parts_ = [(b, slice(cut[b], cut[b + 1]), slice(start[cut[b]], start[cut[b + 1]])) for b in some]
        cols = dict(bucket=(some, i32), chunk=([chunk] * len(some), i64), k=([pack(k[i].astype(np.int32)) for _, i, _ in parts_], binary), code=([pack(code[j].astype(np.uint16)) for _, _, j in parts_], binary), times=([pack(times[j].astype(np.int32)) for _, _, j in parts_], binary))
        if h is not None:
            cols |= dict(hashes=([h[i].tobytes() for _, i, _ in parts_], binary), n=([pack(n[i]) for _, i, _ in parts_], binary))
        return columns(True, **cols)

    def ask(batches):
        known, g, _ = model.value
        for batch in batches:
            for row in batch.to_pylist():
                flat, train = learned(row)
                h, n = np.frombuffer(row["hashes"], U64), unpack(row["n"], np.int32)
                at = place(h, known)
                state = np.append(np.append(g, CLASSES)[at], CLASSES + 1)[flat]
                rare = np.append(at == m, False)[flat] & train
                yield entries(row["chunk"], h, n, bucket_of(h, nb), contexts(flat, rare, state, CLASSES + 2, CLASSES + 1, len(h)))

    def gathered(rows: list[dict], inv: list[np.ndarray], n_words: int, table: np.ndarray) -> np.ndarray:
        k = [unpack(r["k"], np.int32) for r in rows]
        word = np.concatenate([np.repeat(v, x) for v, x in zip(inv, k)])
        code, times = (np.concatenate([unpack(r[c], t) for r in rows]).astype(np.int64) for c, t in (("code", np.uint16), ("times", np.int32)))
        return gains(word, code, times, n_words, table)

    def reply(rows: list[dict], inv: list[np.ndarray], n: np.ndarray, cls: np.ndarray, moved: np.ndarray) -> pa.Table:
        known = n > 0
        stat = np.concatenate([np.bincount(cls[known], minlength=STATES), np.bincount(cls, n, STATES).astype(np.int64), [n[moved].sum()]]).astype(np.int64)
        out = [(r["chunk"], pack(n[v]), pack(cls[v].astype(np.uint8)), pack(np.diff(v, prepend=0).astype(np.int32))) for r, v in zip(rows, inv)] + [(-1, stat.tobytes(), b"", b"")]
        return columns(chunk=([r[0] for r in out], i64), bucket=([rows[0]["bucket"]] * len(out), i32), n=([r[1] for r in out], binary), cls=([r[2] for r in out], binary), inv=([r[3] for r in out], binary))

    def answer(t: pa.Table) -> pa.Table:
        top, g, table_ = model.value
        rows = t.to_pylist()
        hs = [np.frombuffer(r["hashes"], U64) for r in rows]
        u, inv = np.unique(np.concatenate(hs), return_inverse=True)
        inv = np.split(inv.ravel(), np.cumsum([len(x) for x in hs])[:-1])
        n = np.bincount(np.concatenate(inv), np.concatenate([unpack(r["n"], np.int32) for r in rows]), len(u)).astype(np.int64)
        at = place(u, top)
        cls = np.where(at < m, np.append(g, 0)[at], CLASSES + gathered(rows, inv, len(u), table_).argmax(axis=1))
        return reply(rows, inv, n, cls, n > 0)

    asked = parts.select("chunk", "flat", "first", "held", "hashes", "n").mapInArrow(ask, "bucket int, chunk long, k binary, code binary, times binary, hashes binary, n binary")
    kinds = "chunk long, bucket int, n binary, cls binary, inv binary"
    told, p_told = table(few(spread(asked, "bucket").groupBy("bucket").applyInArrow(_trimmed(answer), kinds)), "classes", codec="uncompressed")
    del asked
    rest()

    def classes_of(right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Counts and classes of a chunk's words, in order."""
        rows = sorted(right.to_pylist(), key=lambda r: r["bucket"])
        return tuple(np.concatenate([unpack(r[c], t) for r in rows] or [np.empty(0, t)]).astype(np.int64) for c, t in (("n", np.int64), ("cls", np.uint8)))

    def add_stats(batches):
        s = np.zeros(2 * STATES + 1, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                s += np.frombuffer(x, np.int64)
        yield columns(True, at=(np.arange(len(s)), i64), n=(s, i64))

    def add_moves(batches):
        s = np.zeros(STATES**2, np.int64)
        for batch in batches:
            for a, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s[np.frombuffer(a, np.int32)] += np.frombuffer(n, np.int64)
        k = np.flatnonzero(s)
        yield columns(True, move=(k, i64), n=(s[k], i64))

    def transitions(rows: DataFrame) -> np.ndarray:
        """Class bigrams from (moves, times) rows."""
        c = np.zeros(STATES**2)
        for r in rows.mapInArrow(add_moves, "move long, n long").groupBy("move").agg(F.sum("n").alias("n")).toLocalIterator():  # at most STATES ** 2
            c[r["move"]] = r["n"]
        return c.reshape(STATES, STATES)

    def statistics(told: DataFrame) -> np.ndarray:
        stat = np.zeros(2 * STATES + 1, np.int64)
        for r in told.where("chunk = -1").select("n").mapInArrow(add_stats, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            stat[r["at"]] = r["n"]
        return stat

    def moves_of(seq: np.ndarray, train: np.ndarray) -> tuple[bytes, bytes]:
        two = (np.append(END, seq[:-1]) * STATES + seq)[train]
        moves, times = np.unique(two[seq[train] != UNSEEN], return_counts=True)
        return moves.astype(np.int32).tobytes(), times.astype(np.int64).tobytes()

    # 5: rounds of exchange over the whole vocabulary
    def contexts_again(left: pa.Table, right: pa.Table) -> pa.Table:
        """A chunk's contexts under the classes so far, and its class bigrams (bucket -1)."""
        row = left.to_pylist()[0]
        flat, train = learned(row)
        state = np.append(classes_of(right)[1], END)[flat]
        size = {r["bucket"]: len(unpack(r["cls"], np.uint8)) for r in right.to_pylist()}
        bucket = np.repeat(sorted(size), [size[b] for b in sorted(size)]).astype(np.int64)
        made = pa.Table.from_batches([entries(row["chunk"], None, None, bucket, contexts(flat, train & (flat < len(bucket)), state, STATES, END, len(bucket)))])
        a, n = moves_of(state, train)
        return pa.concat_tables([made, columns(bucket=([-1], i32), chunk=([row["chunk"]], i64), k=([b""], binary), code=([a], binary), times=([n], binary))])

    def exchange_round(turn: int, shared):
        def move(left: pa.Table, right: pa.Table) -> pa.Table:
            before, rows = {r["chunk"]: r for r in left.to_pylist()}, right.to_pylist()
            inv = [np.cumsum(unpack(before[r["chunk"]]["inv"], np.int32)) for r in rows]
            size = 1 + max((int(v.max()) for v in inv if len(v)), default=-1)
            n, cls = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for r, v in zip(rows, inv):
                n[v], cls[v] = unpack(before[r["chunk"]]["n"], np.int64), unpack(before[r["chunk"]]["cls"], np.uint8)
            gain = gathered(rows, inv, size, shared.value)
            best = gain.argmax(axis=1)
            at = np.arange(size)
            go = (gain[at, best] > gain[at, cls] + 1e-3) & (n > 0) & ((n * 10_000 < total) | ((at + turn) % 2 == 0))
            return reply(rows, inv, n, np.where(go, best, cls), go)

        return move

    for turn in range(rounds):
        near = spread(parts.select("chunk", "flat", "first", "held"), "chunk").groupBy("chunk").cogroup(spread(told.where("chunk >= 0"), "chunk").groupBy("chunk"))
        near, p_near = table(few(near.applyInArrow(_trimmed(contexts_again), "bucket int, chunk long, k binary, code binary, times binary")), "contexts", codec="uncompressed")
        c = transitions(near.where("bucket = -1").select(F.col("code").alias("moves"), "times"))
        rest()
        shared = sc.broadcast(_mutual(c, END))  # 2 * STATES rows of END numbers
        both = spread(told.where("chunk >= 0"), "bucket").groupBy("bucket").cogroup(spread(near.where("bucket >= 0"), "bucket").groupBy("bucket"))
        told, p_next = table(few(both.applyInArrow(_trimmed(exchange_round(turn, shared)), kinds)), "classes", codec="uncompressed")
        drop_table(spark, p_near)
        drop_table(spark, p_told)
        p_told = p_next
        rest()
        if statistics(told)[-1] < STILL * total:
            break

    stat = statistics(told)
    class_types, class_tokens = stat[:STATES], stat[STATES : 2 * STATES].astype(np.float64)
    class_tokens[END] = ends
    safe = np.where(class_tokens > 0, class_tokens, 1)
    unseen = d * class_types / safe  # mass for unseen words
    size = sc.broadcast((safe, d, total, types, ends))

    # 6: each chunk's tokens as classes; sums that need no transitions
    def apply(left: pa.Table, right: pa.Table) -> pa.Table:
        safe, d, total, types, ends = size.value
        row = left.to_pylist()[0]
        flat, train = learned(row)
        n, cls = classes_of(right)
        n, cls = np.append(n, ends), np.append(cls, END)
        cls[n == 0] = UNSEEN
        base = np.log10((n + 1) / (total + types + 1))
        less = np.where(cls < END, d, 0.0)
        with np.errstate(divide="ignore"):
            emit = np.where(n > 0, np.log10(np.maximum(n - less, 1e-9) / safe[np.minimum(cls, END)]), 0.0)
        first = unpack(row["first"], np.int32)[:-1]
        seq = cls[flat].astype(np.int64)
        moves, times = moves_of(seq, train)
        docs = lambda x: pack(np.add.reduceat(x[flat], first))
        return columns(
            ids=([row["ids"]], left.schema.field("ids").type), held=([row["held"]], binary), first=([row["first"]], binary), seq=([pack(seq.astype(np.uint8))], binary),
            known=([docs((n > 0).astype(np.int64))], binary), base=([docs(base)], binary), emit=([docs(emit)], binary), moves=([moves], binary), times=([times], binary),
        )

    final, p_final = table(spread(parts.select("chunk", "ids", "flat", "first", "held"), "chunk").groupBy("chunk").cogroup(spread(told.where("chunk >= 0"), "chunk").groupBy("chunk")).applyInArrow(_trimmed(apply), f"ids array<{kind}>, held binary, first binary, seq binary, known binary, base binary, emit binary, moves binary, times binary"), "scored", codec="uncompressed")
    drop_table(spark, p_told)
    drop_table(spark, p_parts)

    # 7: transitions between classes
    c = transitions(final.select("moves", "times"))
    rest()
    prior = (c.sum(0) + 1e-3) / (c.sum() + 1e-3 * STATES)
    p = (c + 20 * prior) / (c.sum(1, keepdims=True) + 20)
    new = unseen * class_tokens
    p = np.vstack([p, (new / new.sum() if new.sum() else prior) @ p])  # the last row: after an unseen word
    mass = p @ unseen
    logs = np.log10(np.column_stack([p, np.where(mass > 0, mass, 1 / (total + types + 1))]))
    trans = sc.broadcast(logs)

    def score(batches):
        for batch in batches:
            for i, row in enumerate(batch.select(["held", "first", "seq", "known", "base", "emit"]).to_pylist()):
                seq = unpack(row["seq"], np.uint8)
                seq = np.where(seq == UNSEEN, STATES, seq).astype(np.int64)
                first = unpack(row["first"], np.int32)
                way = np.add.reduceat(trans.value[np.concatenate([[END], seq[:-1]]), seq], first[:-1])
                n = np.diff(first)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(np.frombuffer(row["held"], bool)), pa.array(n.astype(np.int64)), pa.array(unpack(row["known"], np.int64)), pa.array(np.full(len(n), total, np.int64)), pa.array(unpack(row["base"], np.float64)), pa.array(way + unpack(row["emit"], np.float64))], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return final.mapInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
