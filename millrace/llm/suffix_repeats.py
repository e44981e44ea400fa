"""Repeated substrings of a corpus, by common-prefix interval trees over enhanced suffix arrays.

Every byte covered by a string of ``length`` bytes that also starts anywhere
else (another text or the same one) is removed; matches never cross texts.

Suffix arrays don't split over a cluster by themselves, so suffixes are aligned
first: of each window of ``length`` bytes the leftmost least hash of its
``seed``-byte strings is an anchor. Equal windows have equal anchors at equal
places, so all occurrences of a repeated window meet at one anchor, and windows
without a repeated anchor need no look at all. For each anchor that occurs
twice or more, the bytes around its occurrences go to the task that its hash
names. There, the suffixes that start at anchors are sorted, with the lengths of
the prefixes that neighbours share: an enhanced suffix array. A stack scan of
the shared lengths gives the common-prefix interval tree. An interval of depth t
holds all suffixes with t bytes in common; the bytes before them, sorted the
same way, tell how diverse its left extensions are: occurrences that share o
bytes to the left, and where o + t is ``length`` or more, are a repeat, maximal
where its occurrences differ on both sides. All occurrences are marked, not just
neighbours; with ``groups`` the maximal repeats come out with all of them.

Distinct hashes and contexts are put together for each chunk of texts before
they are shuffled, so copies and passages that many texts share cost one entry
a chunk. Anchors that more than ``hot`` chunks have, whose contexts could outgrow
a task, go another exact way: 128-bit digests of their windows, one of a kind a
chunk, are counted in tasks that the digests name.

Defined results: a null text is empty; a text shorter than ``length`` keeps all
its bytes; repeated rows are texts like any other, so both copies of a text of
``length`` bytes or more lose everything. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ._blobs import chunked, columns, pack, split, unpack
from ._store import drop_table, release, settle, table
from ._text import Block, U64, mix, prefix_hash, span_hash

CHUNK_BYTES = 4 << 20
_POS_BITS = 31


class Part:
    """Texts i to j of a block, as a view."""

    def __init__(self, b: Block, i: int, j: int):
        at = b.start[i] - 1
        self.buf, self.start, self.end = b.buf[at : b.end[j - 1] + 1], b.start[i:j] - at, b.end[i:j] - at


def anchors(b: Block | Part, length: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the buffer and hashes of the anchors of all windows."""
    w, buf = length - seed + 1, b.buf
    long = np.flatnonzero(b.end - b.start >= length)
    if not len(long):
        return np.empty(0, np.int64), np.empty(0, U64)
    m = len(buf) - seed + 1
    at = np.arange(m)
    h = span_hash(prefix_hash(buf), at, at + seed)
    key = (h >> U64(_POS_BITS)) << U64(_POS_BITS) | at.astype(U64)
    rows = -(-m // w) + 1
    pad = np.full(rows * w, np.iinfo(U64).max, U64)
    pad[:m] = key
    pad = pad.reshape(rows, w)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    behind = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    low = np.minimum(behind[: m - w + 1], ahead[w - 1 : m])
    valid = np.zeros(len(low) + 1, np.int8)
    np.add.at(valid, b.start[long], 1)
    np.add.at(valid, b.end[long] - length + 1, -1)
    place = (low[np.cumsum(valid[:-1], dtype=np.int8) > 0] & U64((1 << _POS_BITS) - 1)).astype(np.int64)
    place = place[np.concatenate([[True], place[1:] != place[:-1]])]
    return place, h[place]


def shared_prefix(m: np.ndarray) -> np.ndarray:
    """Bytes that each row of a sorted matrix shares with the row before."""
    differ = m[1:] != m[:-1]
    n = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
    return np.concatenate([[0], n])


def suffix_array(m: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows (strings of ``n`` bytes, padded with zeros) and the prefixes that neighbours share."""
    rows = np.concatenate([m, n[:, None].astype(np.uint8)], axis=1)  # of equal padded rows the shorter comes first
    order = np.argsort(rows.view(f"S{rows.shape[1]}").ravel())
    shared = shared_prefix(m[order])
    shared[1:] = np.minimum(shared[1:], np.minimum(n[order[1:]], n[order[:-1]]))
    return order, shared


def intervals(shared: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The common-prefix interval tree's nodes of depth ``least`` (over 0) or more, by a stack scan: depth, first and last place."""
    found: list[tuple[int, int, int]] = []
    stack = [(0, 0)]
    for i, x in enumerate([*np.where(shared[1:] < least, 0, shared[1:]).tolist(), 0]):
        low = i
        while stack[-1][0] > x:
            depth, low = stack.pop()
            found.append((depth, low, i))
        if stack[-1][0] < x:
            stack.append((x, low))
    return tuple(np.array(found, np.int64).reshape(-1, 3).T)


class Minima:
    """Least value of any range of an array of bytes."""

    def __init__(self, x: np.ndarray):
        self.rows = [x.astype(np.uint8)]
        while 2 << len(self.rows) - 1 <= len(x):
            k, y = 1 << len(self.rows) - 1, self.rows[-1]
            self.rows.append(np.minimum(y[:-k], y[k:]))

    def between(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Minima of x[a + 1 : z + 1], for a < z."""
        level = np.frexp((z - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            i = np.flatnonzero(level == k)
            out[i] = np.minimum(self.rows[k][a[i] + 1], self.rows[k][z[i] - (1 << k) + 1])
        return out


class Repeats:
    """Contexts of anchors: their enhanced suffix arrays to the right and (reversed) to the left.

    ``left`` has the bytes before an anchor, the nearest first; ``right`` those from the anchor on; both padded with
    zeros to fixed widths, with ``n_left`` and ``n_right`` bytes. ``weight``: occurrences of the context itself.
    """

    def __init__(self, left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, weight: np.ndarray, length: int):
        self.order, shared = suffix_array(right, n_right)
        order_l, shared_l = suffix_array(left, n_left)
        self.rank_l = np.empty(len(weight), np.int64)
        self.rank_l[order_l] = np.arange(len(weight))
        self.left, self.right = Minima(shared_l), Minima(shared)
        self.depth, self.first, self.last = intervals(shared, max(1, length - left.shape[1]))
        self.n_left, self.n_right, self.weight, self.length = n_left, n_right, weight, length

    def members(self, most: int = 1 << 20):
        """For some nodes at a time: node of each member, member, and the bytes that it shares to the left with the member before, in left order."""
        size = self.last - self.first + 1
        total = np.cumsum(size)
        a = 0
        while a < len(size):
            z = max(a + 1, int(np.searchsorted(total, total[a] - size[a] + most, "right")))
            node = np.repeat(np.arange(a, z), size[a:z])
            who = self.order[np.arange(len(node)) - np.repeat(np.cumsum(size[a:z]) - size[a:z], size[a:z]) + self.first[node]]
            by = np.lexsort((self.rank_l[who], node))
            who = who[by]
            same = np.zeros(len(who), np.int64)
            inner = np.flatnonzero(node[1:] == node[:-1]) + 1
            same[inner] = self.left.between(self.rank_l[who[inner - 1]], self.rank_l[who[inner]])
            yield node, who, same
            a = z

    def cover(self) -> tuple[np.ndarray, np.ndarray]:
        """For each context the bytes before and after its anchor's start that repeats cover (0, 0: none)."""
        twice = (self.weight >= 2) & (self.n_left + self.n_right >= self.length)
        before, after = np.where(twice, self.n_left, 0), np.where(twice, self.n_right, 0)
        for node, who, same in self.members():
            ext = np.maximum(same, np.append(same[1:], 0))  # its neighbours in left order share most
            t = self.depth[node]
            hit = np.flatnonzero(ext + t >= self.length)
            np.maximum.at(before, who[hit], ext[hit])
            np.maximum.at(after, who[hit], t[hit])
        return before, after

    def groups(self):
        """Maximal repeats: (bytes before and after the anchor's start, all contexts that have it)."""
        for c in np.flatnonzero((self.weight >= 2) & (self.n_left + self.n_right >= self.length)).tolist():
            yield int(self.n_left[c]), int(self.n_right[c]), np.array([c])
        rank_r = np.empty(len(self.order), np.int64)
        rank_r[self.order] = np.arange(len(self.order))
        for node, who, same in self.members():
            for p, q in zip(*(np.flatnonzero(x) for x in (np.append(True, node[1:] != node[:-1]), np.append(node[1:] != node[:-1], True)))):
                t = int(self.depth[node[p]])
                s = same[p : q + 1]
                nodes = zip(*(x.tolist() for x in intervals(s, max(1, self.length - t))))
                if t >= self.length and s[1:].min() == 0:  # the whole interval, if its left extensions differ at once
                    nodes = [*nodes, (0, 0, q - p)]
                for o, a, z in nodes:
                    some = who[p + a : p + z + 1]
                    r = rank_r[some]
                    if int(self.right.between(np.array([r.min()]), np.array([r.max()]))[0]) == t:  # else a deeper interval has it
                        yield o, t, some


def _spans(out: list[tuple[int, bytes, bytes, bytes]]) -> pa.Table:
    """Chunks with starts, ends and groups (or none) of repeats in them."""
    return columns(chunk=([x[0] for x in out], pa.int64()), **{k: ([x[1 + i] for x in out], pa.binary()) for i, k in enumerate("azg")})


def _windows(buf, start, end, place, length: int, seed: int, nb: int) -> list[tuple]:
    """Digests of all windows that hold the anchors at ``place``, by bucket: how frequent anchors are matched."""
    if not len(place):
        return []
    doc = np.searchsorted(start, place, "right") - 1
    at = (place[:, None] - np.arange(length - seed + 1)).ravel()
    doc = np.repeat(doc, length - seed + 1)
    at = np.unique(at[(at >= start[doc]) & (at + length <= end[doc])])
    two = [span_hash(prefix_hash(x), at, at + length) for x in (buf, mix(np.arange(256, dtype=U64)).argsort().astype(np.uint8)[buf])]
    pairs = np.stack(two, 1)
    out = []
    for b, i in split(nb + (two[0] % U64(nb)).astype(np.int64)):
        uniq, inv = np.unique(pairs[i], axis=0, return_inverse=True)
        out.append((b, pack(at[i].astype(np.int32)), uniq.tobytes(), pack(inv.ravel().astype(np.int32)), b""))
    return out


def _count_windows(rows: list[dict], length: int, groups: bool) -> pa.Table:
    seen = [np.frombuffer(r["context"], U64).reshape(-1, 2) for r in rows]
    inv = [unpack(r["rows"], np.int32) for r in rows]
    all_ = np.concatenate(seen)
    _, of = np.unique(all_, axis=0, return_inverse=True)
    of = of.ravel()
    total = np.bincount(of, np.concatenate([np.bincount(v, minlength=len(s)) for v, s in zip(inv, seen)]))[of]
    out = []
    for r, v, a in zip(rows, inv, np.cumsum([0, *map(len, seen)])):
        hit = total[a + v] >= 2
        at = unpack(r["place"], np.int32)[hit]
        if len(at):
            out.append((r["chunk"], pack(at), pack(at + np.int32(length)), pack(all_[(a + v)[hit], 0]) if groups else b""))
    return _spans(out)


def suffix_repeats(df: DataFrame, length: int = 200, seed: int = 100, doc_id: str = "doc_id", text: str = "text", spans: bool = False, groups: bool = False, buckets: int | None = None, hot: int = 4096) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``spans`` also kept (binary) and removed (array of start, end).

    With ``groups`` instead one row per occurrence of a maximal repeat: group (long), doc_id, start, end (bytes). Repeats
    are seen from their anchors: from length - ``seed`` bytes before to ``length`` bytes after one; a longer repeat is
    several groups, which overlap, and those of ``hot`` anchors are windows of ``length`` bytes.
    ``buckets``: shares of the anchors; as many as chunks of texts if None. ``length`` is at most 255.
    """
    if not 0 < seed < length <= 255:
        raise ValueError("0 < seed < length <= 255")
    spark = df.sparkSession
    ship(spark)
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(df.dtypes)[doc_id]
    i64, binary = pa.int64(), pa.binary()
    wide = length - seed

    def chunks(batches):
        for number, b, (ids,) in chunked(batches, CHUNK_BYTES):
            place, h = [], []
            i = 0
            while i < b.n:  # some texts at a time, whose work arrays stay small
                j = max(i + 1, int(np.searchsorted(b.end, b.start[i] + (1 << 19))))
                at = int(b.start[i]) - 1
                p, q = anchors(Part(b, i, j), length, seed)
                place.append(p + at)
                h.append(q)
                i = j
            out = columns(True, chunk=([number], i64), sizes=([pack((b.end - b.start).astype(np.int32))], binary), body=([zstandard.compress(b.buf.tobytes(), 6)], binary), place=([pack(np.concatenate(place).astype(np.int32))], binary), hashes=([np.concatenate(h).tobytes()], binary))
            out = out.append_column("ids", pa.array([ids.to_pylist()], pa.list_(ids.type)))
            yield out.select(["chunk", "ids", "sizes", "body", "place", "hashes"])

    src = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    parts, _ = table(src.mapInArrow(chunks, f"chunk long, ids array<{kind}>, sizes binary, body binary, place binary, hashes binary"), "chunks", codec="uncompressed")
    settle(spark)
    nb = buckets or max(32, parts.count())
    # tasks' shares stay as they are, however many there are
    spread = lambda d, key: d.repartition(nb // 4, key) if nb // 4 > usual else d

    def ask(batches):
        for batch in batches:
            for chunk, hashes in zip(batch.column("chunk").to_pylist(), batch.column("hashes").to_pylist()):
                h, n = np.unique(np.frombuffer(hashes, U64), return_counts=True)
                rows = [(b, h[i].tobytes(), np.minimum(n[i], 255).astype(np.uint8).tobytes()) for b, i in split((h % U64(nb)).astype(np.int64))]
                yield columns(True, bucket=([r[0] for r in rows], pa.int32()), chunk=([chunk] * len(rows), i64), hashes=([r[1] for r in rows], binary), n=([r[2] for r in rows], binary))

    def answer(t: pa.Table) -> pa.Table:
        hs = [np.frombuffer(x, U64) for x in t["hashes"].to_pylist()]
        h, n = np.concatenate(hs), np.concatenate([np.frombuffer(x, np.uint8) for x in t["n"].to_pylist()]).astype(np.int64)
        _, inv = np.unique(h, return_inverse=True)
        total = np.bincount(inv, n)[inv]
        crowd = np.bincount(inv)[inv]  # chunks that have it
        cut = np.cumsum([0, *map(len, hs)])
        rows = [(c, h[a:z][total[a:z] > 1].tobytes(), np.minimum(crowd[a:z][total[a:z] > 1], 1 << 30).astype(np.int32).tobytes()) for c, a, z in zip(t["chunk"].to_pylist(), cut, cut[1:]) if (total[a:z] > 1).any()]
        return columns(chunk=([r[0] for r in rows], i64), hashes=([r[1] for r in rows], binary), crowd=([r[2] for r in rows], binary))

    # shuffle files of a step that is done go before the next one writes its own: disk has one step's at a time;
    # so does the heap that it has grown
    asked = spread(parts.select("chunk", "hashes").mapInArrow(ask, "bucket int, chunk long, hashes binary, n binary"), "bucket")
    told, p2 = table(asked.groupBy("bucket").applyInArrow(answer, "chunk long, hashes binary, crowd binary"), "anchors")
    del asked
    settle(spark)

    def contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        none = dict(bucket=([], pa.int32()), chunk=([], i64), place=([], binary), context=([], binary), rows=([], binary), sizes=([], binary))
        if not left.num_rows or not right.num_rows:
            return columns(**none)
        row = left.to_pylist()[0]
        place, h = unpack(row["place"], np.int32).astype(np.int64), np.frombuffer(row["hashes"], U64)
        known = np.concatenate([np.frombuffer(x, U64) for x in right["hashes"].to_pylist()])
        by = np.argsort(known)
        known, crowd = known[by], np.concatenate([np.frombuffer(x, np.int32) for x in right["crowd"].to_pylist()])[by]
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        i = np.flatnonzero(known[at] == h)
        place, h, often = place[i], h[i], crowd[at[i]] > hot
        buf = np.frombuffer(zstandard.decompress(row["body"]), np.uint8)
        size = unpack(row["sizes"], np.int32).astype(np.int64)
        end = np.cumsum(size + 1)
        start = end - size
        out = _windows(buf, start, end, place[often], length, seed, nb)
        place, h = place[~often], h[~often]
        doc = np.searchsorted(start, place, "right") - 1
        nl, nr = np.minimum(place - start[doc], wide), np.minimum(end[doc] - place, length)
        span = np.arange(-wide, length)
        padded = np.concatenate([np.zeros(wide, np.uint8), buf, np.zeros(length, np.uint8)])
        for b, j in split((h % U64(nb)).astype(np.int64)):
            m = padded[place[j, None] + span + wide]
            m[(span < -nl[j, None]) | (span >= nr[j, None])] = 0
            full = np.concatenate([m, nl[j, None].astype(np.uint8), nr[j, None].astype(np.uint8)], axis=1)
            # a row's own length bytes end it, so that equal bytes of other lengths differ
            uniq, inv = np.unique(np.concatenate([full, np.full((len(full), 1), 1, np.uint8)], axis=1).view(f"S{full.shape[1] + 1}").ravel(), return_inverse=True)
            u = uniq.view(np.uint8).reshape(len(uniq), -1)[:, :-1]
            out.append((b, pack(place[j].astype(np.int32)), pack(u[:, : wide + length], 5), pack(inv.astype(np.int32)), u[:, wide + length :].tobytes()))
        return columns(bucket=([r[0] for r in out], pa.int32()), chunk=([row["chunk"]] * len(out), i64), place=([r[1] for r in out], binary), context=([r[2] for r in out], binary), rows=([r[3] for r in out], binary), sizes=([r[4] for r in out], binary))

    def match(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        if rows[0]["bucket"] >= nb:
            return _count_windows(rows, length, groups)
        ctx = np.concatenate([unpack(r["context"], np.uint8).reshape(-1, wide + length) for r in rows])
        sizes = np.concatenate([np.frombuffer(r["sizes"], np.uint8).reshape(-1, 2) for r in rows]).astype(np.int64)
        inv = [unpack(r["rows"], np.int32) for r in rows]
        n_ctx = [len(r["sizes"]) // 2 for r in rows]
        base = np.cumsum([0, *n_ctx])
        weight = np.concatenate([np.bincount(v, minlength=k) for v, k in zip(inv, n_ctx)])
        made = Repeats(np.ascontiguousarray(ctx[:, :wide][:, ::-1]), np.ascontiguousarray(ctx[:, wide:]), sizes[:, 0], sizes[:, 1], weight, length)
        at = [unpack(r["place"], np.int32) for r in rows]
        out = []
        if groups:
            whose = np.repeat(np.arange(len(rows)), [len(x) for x in at])
            context, place = np.concatenate([a + v for v, a in zip(inv, base)]), np.concatenate(at)
            by = np.argsort(context, kind="stable")
            cut = np.searchsorted(context[by], np.arange(len(ctx) + 1))
            all_ = [np.empty((0, 4), np.int64)]
            for k, (o, t, some) in enumerate(made.groups()):
                i = np.concatenate([by[cut[c] : cut[c + 1]] for c in some.tolist()])
                all_.append(np.stack([whose[i], place[i] - o, place[i] + t, np.full(len(i), rows[0]["bucket"] << 32 | k)], 1))
            all_ = np.concatenate(all_)
            for j, i in split(all_[:, 0]):
                out.append((rows[j]["chunk"], pack(all_[i, 1].astype(np.int32)), pack(all_[i, 2].astype(np.int32)), pack(all_[i, 3])))
            return _spans(out)
        before, after = made.cover()
        for r, v, a, place in zip(rows, inv, base, at):
            o, t = before[a + v], after[a + v]
            hit = t > 0
            if hit.any():
                out.append((r["chunk"], pack((place - o)[hit].astype(np.int32)), pack((place + t)[hit].astype(np.int32)), b""))
        return _spans(out)

    near = spread(parts.drop("ids"), "chunk").groupBy("chunk").cogroup(spread(told, "chunk").groupBy("chunk")).applyInArrow(contexts, "bucket int, chunk long, place binary, context binary, rows binary, sizes binary")
    near = spread(near, "bucket").groupBy("bucket").applyInArrow(match, "chunk long, a binary, z binary, g binary")
    found, _ = table(near.repartition("chunk"), "repeats")  # in few files: to make one, an executor starts processes, when its heap is largest
    del near
    drop_table(spark, p2)
    settle(spark)
    release(spark)  # the last step's files, which go when another job, here settle's, has run

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        body = zstandard.decompress(row["body"])
        size = unpack(row["sizes"], np.int32).astype(np.int64)
        end = np.cumsum(size + 1)
        start = end - size
        step = np.zeros(len(body) + 1, np.int32)
        for r in right.to_pylist():
            np.add.at(step, unpack(r["a"], np.int32), 1)
            np.add.at(step, unpack(r["z"], np.int32), -1)
        gone = np.cumsum(step[:-1], dtype=np.int32) > 0  # never a text's line feed
        edge = np.flatnonzero(gone[1:] != gone[:-1]) + 1
        a, z = edge[::2], edge[1::2]
        first = np.searchsorted(a, start)
        last = np.searchsorted(a, end)
        n = np.concatenate([[0], np.cumsum(z - a)])
        kept = []
        for s, e, i, j in zip(start.tolist(), end.tolist(), first.tolist(), last.tolist()):
            kept.append(body[s:e] if i == j else b"".join([body[p:q] for p, q in zip([s, *z[i:j].tolist()], [*a[i:j].tolist(), e])]))
        cols = dict(doc_id=(row["ids"], left.schema.field("ids").type.value_type), n_bytes=(size, i64), n_removed=(n[last] - n[first], i64), n_spans=(last - first, i64), kept_sha256=([hashlib.sha256(x).hexdigest() for x in kept], pa.string()))
        if spans:
            cols |= dict(kept=(kept, binary), removed=([[[int(p - s), int(q - s)] for p, q in zip(a[i:j], z[i:j])] for s, i, j in zip(start, first, last)], pa.list_(pa.list_(pa.int32()))))
        return columns(**cols)

    def occurrences(left: pa.Table, right: pa.Table) -> pa.Table:
        row, typ = left.to_pylist()[0], left.schema.field("ids").type.value_type
        size = unpack(row["sizes"], np.int32).astype(np.int64)
        start = np.cumsum(size + 1) - size
        cols = [np.concatenate([unpack(r[c], kind) for r in right.to_pylist()] or [np.empty(0, kind)]).astype(np.int64) for c, kind in (("a", np.int32), ("z", np.int32), ("g", np.int64))]
        doc = np.searchsorted(start, cols[0], "right") - 1
        return columns(group=(cols[2], i64), doc_id=([row["ids"][d] for d in doc.tolist()], typ), start=(cols[0] - start[doc], i64), end=(cols[1] - start[doc], i64))

    chunks_, spans_ = (spread(d, "chunk").groupBy("chunk") for d in (parts.select("chunk", "ids", "sizes", "body"), found))
    if groups:
        return chunks_.cogroup(spans_).applyInArrow(occurrences, f"group long, doc_id {kind}, start long, end long")
    return chunks_.cogroup(spans_).applyInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, removed array<array<int>>" * spans)
