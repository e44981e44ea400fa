"""Sets compared block by block in numpy: bit sketches whose difference bounds the Jaccard similarity from above."""

from __future__ import annotations

#: Rows of a block that are compared at once; pairs that are made at once.
_ROWS, _PAIRS = 4096, 1 << 18


def sketched(batches):
    """Rows (set_id, s: elements) become (set_id, n, class, bits): 8 bits an element of the class's least size.

    A class has sizes from 2^c to 2^(c+1) - 1. Sketches of the next class fold to this one's by or.
    """
    import numpy as np
    import pyarrow as pa

    for b in batches:
        lists, values = b.column(1), np.asarray(b.column(1).flatten()).astype(np.uint64)
        ends = np.cumsum(np.asarray(lists.value_lengths(), dtype=np.int64))
        n = np.diff(ends, prepend=0)
        h = values * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        c, bits = np.zeros(len(n), np.int32), []
        for k, (e, m) in enumerate(zip(ends, n)):
            c[k] = max(int(m).bit_length() - 1, 3)
            flags = np.zeros(8 << c[k], np.uint8)
            flags[(h[e - m : e] & np.uint64((8 << int(c[k])) - 1)).astype(np.int64)] = 1
            bits.append(np.packbits(flags, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(c, pa.int32()), pa.array(bits, pa.binary())], ["set_id", "n", "c", "bits"])


def _matrix(bits, c: int):
    """(words, rows) of sketches of one class."""
    import numpy as np

    return np.ascontiguousarray(np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), (8 << c) // 64).T)


def near(a, b, c: int, d: int, na, nb, threshold: float):
    """Index pairs of two blocks (words, rows) of classes c <= d whose similarity may reach the threshold.

    The sets' symmetric difference has at least as many elements as the sketches' has bits. Classes that aren't next to
    each other are folded as often as it takes.
    """
    import numpy as np

    for _ in range(d - c):
        half = len(b) // 2
        b = b[:half] | b[half:]
    for k in range(a.shape[1]):
        differ = np.zeros(b.shape[1], np.int32)
        for w in range(len(a)):
            differ += np.bitwise_count(b[w] ^ a[w, k])
        total = nb + na[k]
        most = (total - differ) // 2  # common elements
        hit = np.flatnonzero((most >= threshold * (total - most) - 1e-6) & (np.minimum(nb, na[k]) >= threshold * np.maximum(nb, na[k]) - 1e-6))
        if len(hit):
            yield k, hit


def compare(threshold: float):
    """A group's rows (cell, left, set_id, n, c, bits): pairs of its left and right blocks, or of one block with itself."""

    def run(key, table):
        import numpy as np
        import pyarrow as pa

        left = np.asarray(table.column("left"))
        ids, n, c = table.column("set_id"), np.asarray(table.column("n")).astype(np.int32), np.asarray(table.column("c"))
        bits = table.column("bits")
        at = [np.flatnonzero(left == v) for v in (True, False)]
        same = not len(at[1])
        x, y = [], []
        part = {}
        for side, rows in enumerate(at):
            for k in np.unique(c[rows]):
                own = rows[c[rows] == k]
                part[side, int(k)] = own, _matrix(bits.take(pa.array(own)).to_pylist(), int(k))
        for (s, k), (r, m) in part.items():
            for (t, q), (v, o) in part.items():
                if s != 0 or t != (0 if same else 1) or 2.0 ** (abs(k - q) - 1) * threshold >= 1 or (same and k > q):
                    continue
                (ra, ma, ca), (rb, mb, cb) = ((r, m, k), (v, o, q)) if k <= q else ((v, o, q), (r, m, k))
                for lo in range(0, len(rb), _ROWS):
                    inner = same and k == q
                    sa = slice(0, min(len(ra), lo + _ROWS)) if inner else slice(None)
                    for p, hit in near(ma[:, sa], mb[:, lo : lo + _ROWS], ca, cb, n[ra[sa]], n[rb[lo : lo + _ROWS]], threshold):
                        hit = hit + lo
                        hit = hit[hit > p] if inner else hit
                        if len(hit):
                            x.append(np.full(len(hit), ra[p]))
                            y.append(rb[hit])
        x, y = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (x, y))
        return pa.table({"a": ids.take(pa.array(x, pa.int64())), "b": ids.take(pa.array(y, pa.int64()))})

    return run


def first_shared(batches):
    """Rows (band, bucket, part, left, p, set_id, h, g, cell) in order: pairs of a left row and one after it in its bucket's part.

    Only if none of the bands before the p-th has equal digests.
    """
    import numpy as np
    import pyarrow as pa

    def paired(t):
        ids, left, p = t.column("set_id").combine_chunks(), np.asarray(t.column("left")), np.asarray(t.column("p"))
        h, g = (np.asarray(t.column(c).combine_chunks().flatten()).reshape(len(p), -1) for c in "hg")
        end = np.repeat(ends(t), np.diff(ends(t), prepend=0))
        x = np.flatnonzero(left)
        m = end[x] - x - 1
        total, at = np.cumsum(m), 0
        while at < len(x):
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, "right")))
            stop = np.cumsum(m[at:to])
            a = np.repeat(x[at:to], m[at:to])
            b = np.repeat(x[at:to] + 1 - (stop - m[at:to]), m[at:to]) + np.arange(len(a))
            for k in range(h.shape[1]):
                seen = (k < p[a]) & (h[a, k] == h[b, k]) & (g[a, k] == g[b, k])
                if seen.any():
                    a, b = a[~seen], b[~seen]
            if len(a):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b))], ["a", "b"])
            at = to

    def ends(t):
        """Where the groups end."""
        new = np.zeros(max(len(t) - 1, 0), bool)
        for c in ("band", "bucket", "part"):
            v = t.column(c).combine_chunks()
            new |= np.asarray(pa.compute.not_equal(v[1:], v[:-1]))
        return np.append(np.flatnonzero(new) + 1, len(t))

    import pyarrow.compute  # noqa: F401

    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += len(b)
        if rows < 4 * _ROWS:
            continue
        t = pa.Table.from_batches(held)
        e = ends(t)
        whole = int(e[-2]) if len(e) > 1 else 0  # the last group may go on
        if whole:
            yield from paired(t.slice(0, whole))
        held, rows = t.slice(whole).to_batches(), 0 if whole else rows
    if held:
        t = pa.Table.from_batches(held)
        if len(t):
            yield from paired(t)
