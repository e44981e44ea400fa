"""Near-duplicate groups by SetSketch registers.

A text's set of word shingles is sketched into registers floor(1 - log_b(x)),
x the least of exponentially distributed hashes of its elements: exponentially
spaced truncated minima, which merge by maximum and are equal for two sets
about as often as their Jaccard similarity. Bands of ``rows`` registers are
keys; texts that share a key are candidates. From the registers that are
greater, less and equal, and the sets' sizes, the similarity of a candidate
pair has a likelihood, whose maximum must come within ``margin`` of the
threshold; then the pair is confirmed on the full sets.

Texts with equal sets are one class (found by digest, counted before anything
is shuffled); only a class's smallest id goes on. In each key's group, all are
first compared with the smallest id alone. Only where that leaves a group in
several components are texts of different components compared by their
registers, a block against a block in each task, so that a task's memory is
bounded; pairs inside a component are never made.

Defined results: a null text, or one without words, has no shingles and is its
own component; a row without an id is compared with nothing, has no component
and is kept. Rows with equal ids are one node. Ties go to the smallest id. An
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import ship
from ._sieve import sieve, split
from ._store import drop_table, table
from ._text import Block, U64, blocks, combine, mix, prefix_hash, span_hash

REGISTERS, ROWS = 128, 3
BASE, RATE, TOP = 1.001, 20.0, 65535
_FACTOR = mix(np.arange(1, REGISTERS + 1, dtype=U64) * U64(0x2545F4914F6CDD1D)) | U64(1)
#: A key's group is compared across components in blocks of so many texts.
GROUP_BLOCK = 4096
SALTS = 16


def shingles(b: Block, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles of ``size`` words; a shorter text is one shingle."""
    s, e, first = b.words()
    h = span_hash(prefix_hash(b.buf), s, e)
    grams = combine(h, size)
    out = []
    for a, z in zip(first.tolist(), first[1:].tolist()):
        if z - a >= size:
            out.append(np.unique(grams[a : z - size + 1]))
        elif z > a:
            out.append(combine(h[a:z], z - a) + U64(z - a))
        else:
            out.append(np.empty(0, U64))
    return out


def sketch(elements: np.ndarray) -> np.ndarray:
    """Registers of a non-empty set."""
    low = np.full(REGISTERS, np.iinfo(U64).max, U64)
    for a in range(0, len(elements), 1024):
        np.minimum(low, (_FACTOR[:, None] * elements[a : a + 1024]).min(axis=1), out=low)
    return low


def registers(low: np.ndarray) -> np.ndarray:
    u = (low.astype(np.float64) + 1) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype(np.uint16)


def band_keys(regs: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(texts, bands) keys from (texts, registers)."""
    bands = regs.shape[1] // rows
    r = regs[:, : bands * rows].reshape(len(regs), bands, rows).astype(U64)
    key = np.broadcast_to(np.arange(bands, dtype=U64), r.shape[:2]).copy()
    for k in range(rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + r[:, :, k])
    return key


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of each pair of register rows, given the sets' sizes."""
    more, less = (a > b).sum(-1), (a < b).sum(-1)
    same = a.shape[-1] - more - less
    u = na / (na + nb)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    best, at = np.full(len(u), -np.inf), np.zeros(len(u))
    most = np.minimum(u / (1 - u), (1 - u) / u)
    for j in np.linspace(0, 1, 101):
        x, y = p(u - (1 - u) * j), p((1 - u) - u * j)
        with np.errstate(divide="ignore", invalid="ignore"):
            like = np.where(more > 0, more * np.log(x), 0) + np.where(less > 0, less * np.log(y), 0) + np.where(same > 0, same * np.log(np.maximum(1 - x - y, 1e-300)), 0)
        like = np.where((j <= most + 1e-9) & ~np.isnan(like), like, -np.inf)
        at = np.where(like > best, j, at)
        best = np.maximum(best, like)
    return at


def _sketches(df: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part, b in blocks(batch, lower=True):
                sets = shingles(b, size)
                n = np.array([len(x) for x in sets])
                some = np.flatnonzero(n)
                low = np.stack([sketch(sets[i]) for i in some]) if len(some) else np.empty((0, REGISTERS), U64)
                regs = registers(low)
                keys = np.zeros((b.n, REGISTERS // ROWS), U64)
                keys[some] = band_keys(regs)
                d1, d2 = np.zeros(b.n, U64), np.zeros(b.n, U64)
                for i in some:
                    d1[i], d2[i] = mix(sets[i]).sum(dtype=U64), mix(sets[i] ^ U64(0xA5A5A5A5A5A5A5A5)).sum(dtype=U64)
                raw = [b""] * b.n
                for i, r in zip(some.tolist(), regs):
                    raw[i] = r.tobytes()
                flat = pa.array(keys[some].view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((n > 0) * keys.shape[1])]).astype(np.int32)), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n.astype(np.int64)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)), pa.array(raw, pa.binary()), lists], ["doc_id", "n_shingles", "d1", "d2", "sketch", "keys"])

    return df.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, n_shingles long, d1 long, d2 long, sketch binary, keys array<long>")


def _likely(pairs: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """The (a, b) pairs whose estimated similarity is ``least`` or more."""

    def run(batches):
        for t in batches:
            if not t.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint16).reshape(t.num_rows, -1) for c in ("sa", "sb"))
            keep = estimate(ra, rb, t.column("na").to_numpy(), t.column("nb").to_numpy()) >= least
            yield t.select(["a", "b"]).filter(pa.array(keep))

    side = lambda k: reps.select(F.col("doc_id").alias(k), F.col("sketch").alias("s" + k), F.col("n_shingles").alias("n" + k))
    kind = dict(pairs.dtypes)["a"]
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, f"a {kind}, b {kind}")


def _confirm(pairs: DataFrame, docs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The (a, b) pairs whose full sets have den * intersection >= num * union.

    Texts are shuffled to their first member's group, split by a salt, and streamed: the first member's set
    stays in memory while the others pass.
    """
    kind = dict(pairs.dtypes)["a"]
    p = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    need = p.select(F.col("b").alias("doc_id"), "a", "salt", F.lit(1).alias("role")).union(p.select(F.col("a").alias("doc_id"), "a", "salt", F.lit(0)).distinct())
    key = F.xxhash64("doc_id")
    maybe, _ = split(docs, sieve(need, key), key)
    rows = maybe.join(need, "doc_id").select("a", "salt", "role", "doc_id", "text").repartition("a", "salt").sortWithinPartitions("a", "salt", "role")

    def run(batches):
        at, mine = None, None
        for batch in batches:
            for part, b in blocks(batch, lower=True):
                sets = shingles(b, size)
                out = []
                for (a, salt, role, doc), s in zip(zip(*[part.column(k).to_pylist() for k in range(4)]), sets):
                    if role == 0:
                        at, mine = (a, salt), s
                    elif at == (a, salt) and len(mine) and len(s):
                        x, y = (mine, s) if len(mine) < len(s) else (s, mine)
                        both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                        if den * both >= num * (len(mine) + len(s) - both):
                            out.append((a, doc))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], part.column(0).type), pa.array([x[1] for x in out], part.column(0).type)], ["a", "b"])

    return rows.mapInArrow(run, f"a {kind}, b {kind}")


def _cross_pairs(ids, comp, band: int, regs: np.ndarray, n: np.ndarray, side: np.ndarray, least: float) -> tuple[list, list]:
    """Likely pairs of different components and of different sides (side 2: all of them) in one pair of blocks."""
    a, b = [], []
    step = max(1, (8 << 20) // regs.size)
    bands = regs.shape[1] // ROWS
    for p in range(0, len(ids), step):  # some rows against all after them
        same = regs[p : p + step, None, :] == regs[None, p:, :]
        near = same.sum(2) >= (least - 0.05) * regs.shape[1]
        near &= (comp[p : p + step, None] != comp[None, p:]) & ((side[p : p + step, None] != side[None, p:]) | (side[None, p:] == 2))
        i, j = np.nonzero(np.triu(near, 1))
        # a pair belongs to the first band that both are equal in
        mine = same[i, j, : ROWS * bands].reshape(len(i), bands, ROWS).all(2).argmax(1) == band
        i, j = i[mine] + p, j[mine] + p
        if len(i):
            ok = estimate(regs[i], regs[j], n[i], n[j]) >= least
            x, y = ids[i[ok]], ids[j[ok]]
            a += np.minimum(x, y).tolist()
            b += np.maximum(x, y).tolist()
    return a, b


def _across(groups: DataFrame, least: float) -> DataFrame:
    """Likely (a, b) pairs of different components in a key's group; rows: key, band, block, doc_id, comp, sketch, n_shingles, side."""
    kind = dict(groups.dtypes)["doc_id"]

    def run(batches):
        rest, typ = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            typ = t.schema.field("doc_id").type
            t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
            rest, out = _groups(t, typ, last=False)
            yield from out
        if rest is not None:
            yield from _groups(rest, typ, last=True)[1]

    def _groups(t: pa.Table, typ, last: bool):
        """Handles the complete groups of sorted rows; returns the rows of the last one, if it may go on."""
        key, block = t["key"].to_numpy(), t["block"].to_numpy()
        cut = [0, *(np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(key)]
        end = len(cut) - 1 if last else len(cut) - 2
        ids, comp, n, side, band = np.array(t["doc_id"].to_pylist(), object), np.unique(np.array(t["comp"].to_pylist(), object), return_inverse=True)[1], t["n_shingles"].to_numpy(), t["side"].to_numpy(), t["band"].to_numpy()
        regs = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint16).reshape(t.num_rows, -1)
        a, b = [], []
        for p, q in zip(cut[:end], cut[1 : end + 1]):
            x, y = _cross_pairs(ids[p:q], comp[p:q], int(band[p]), regs[p:q], n[p:q], side[p:q], least)
            a += x
            b += y
        out = [pa.RecordBatch.from_arrays([pa.array(a, typ), pa.array(b, typ)], ["a", "b"])]
        return (None if last else t.slice(cut[end])), out

    return groups.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(run, f"a {kind}, b {kind}").distinct()


def near_dedup(df: DataFrame, num: int = 70, den: int = 100, size: int = 5, margin: float = 0.17, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, class_id (smallest id with an equal set), links_confirmed.

    Documents are linked if den * intersection >= num * union of their sets of ``size``-word shingles; components
    are named by their smallest id. ``links_confirmed``: how many links of its class were confirmed to find the components; links
    between classes that are in one component anyway aren't all looked for, so a class may have more.
    """
    ship(df.sparkSession)
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    all_, _ = table(_sketches(docs, size), "sketches")
    some = all_.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes, p_classes = table(some.groupBy("d1", "d2").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")), "classes")
    reps = some.join(classes.select("d1", "d2", F.col("class_id").alias("doc_id")), ["d1", "d2", "doc_id"]).dropDuplicates(["doc_id"])
    keyed = reps.select("doc_id", F.posexplode("keys").alias("band", "key"))
    first = keyed.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).cast("int")
    groups, p_groups = table(keyed.withColumn("salt", salt("doc_id")).join(first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "salt"]).select("key", "band", "doc_id", "first", "n"), "groups")
    least = num / den - margin
    star = groups.where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()
    likely, p1 = table(_likely(star, reps, least), "likely")
    links, p2 = table(_confirm(likely, docs, size, num, den), "links")
    cut = lambda e: table(e, "edges")[0]
    comp = connected_components(links, "a", "b", cut)

    # groups that are in several components still: compare across these
    label = lambda c, to: comp.select(F.col("node").alias(c), F.col("component").alias(to))
    named = groups.join(label("doc_id", "comp"), "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))
    named = named.join(label("first", "comp1"), "first", "left").withColumn("main", F.col("comp") == F.coalesce("comp1", "first"))
    mixed = named.groupBy("key").agg(F.count_if("main").alias("n_main"), F.count_if(~F.col("main")).alias("n_other")).where("n_other > 0")
    rest = named.join(mixed, "key").join(reps.select("doc_id", "sketch", "n_shingles"), "doc_id")
    # blocks of the first member's component against blocks of the others, and blocks of others against each other
    n_main, n_other = (F.greatest(F.ceil(F.col(c) / GROUP_BLOCK), F.lit(1)).cast("int") for c in ("n_main", "n_other"))
    own = F.pmod(F.xxhash64("doc_id"), F.when(F.col("main"), n_main).otherwise(n_other)).cast("int")
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    rest = rest.withColumns({"own": own, "nm": n_main, "no": n_other})
    me, zero, one = F.col("own"), F.lit(0), F.lit(1)
    with_main = F.transform(upto(F.col("nm")), lambda i: cell(0, i, me, one))
    others = F.transform(upto(F.col("no")), lambda j: cell(1, F.least(me, j), F.greatest(me, j), F.when(me == j, 2).when(me < j, 0).otherwise(1)))
    cells = F.when(F.col("main"), F.transform(upto(F.col("no")), lambda j: cell(0, me, j, zero))).otherwise(F.concat(with_main, others))
    rest = rest.withColumn("cell", F.explode(cells)).select("key", "band", F.struct("cell.kind", "cell.i", "cell.j").alias("at"), "doc_id", "comp", "sketch", "n_shingles", F.col("cell.side").alias("side"))
    rest = rest.withColumn("block", (F.col("at.kind").cast("long") * (1 << 60)) + F.col("at.i").cast("long") * (1 << 30) + F.col("at.j"))
    more, p3 = table(_across(rest.select("key", "band", "block", "doc_id", "comp", "sketch", "n_shingles", "side"), least), "across")
    more = more.join(likely, ["a", "b"], "left_anti")
    links2, p4 = table(_confirm(more, docs, size, num, den), "links")
    links = links.unionByName(links2)
    if not links2.isEmpty():
        comp = connected_components(links, "a", "b", cut)

    for p in (p_groups, p1, p3):
        drop_table(df.sparkSession, p)
    n_links = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("links_confirmed"))
    copies = classes.where("n > 1").select("d1", "d2", "class_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = all_.drop("sketch", "keys").withColumn("salt", salt("doc_id")).join(copies, ["d1", "d2", "salt"], "left")
    out = out.withColumn("class_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")))
    out = out.join(label("class_id", "component_id"), "class_id", "left").join(n_links, "class_id", "left")
    out = out.withColumn("component_id", F.coalesce("component_id", "class_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id", F.coalesce("links_confirmed", F.lit(0).cast("long")).alias("links_confirmed"))
