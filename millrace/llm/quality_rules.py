"""Quality rules: text statistics, and perplexity under a character n-gram model.

The model is an order-4 modified Kneser-Ney model over characters (letters of
any script; ASCII signs, digits, capitals and blanks are one symbol each, so
that noise of one sign is as unlikely as that of another), counted by Spark over all documents: n-gram counts for the
highest order, continuation counts for the lower ones, discounts from the counts
of counts. A corpus of at most ``MAX_GRAMS`` distinct n-grams has its model
broadcast, as sorted arrays of 64-bit n-gram hashes, which lookups search by
bisection. Of a larger one nothing is cut either: the orders are joined to the
probability of each n-gram, the most frequent ones (at most ``MAX_GRAMS``) are
broadcast, and chunks of texts ask for all others, once a chunk, in tasks that
the hashes name. Both ways give the same scores.
Documents whose log-perplexity lies outside the band of their language are
rejected. A band is the language's quartiles, widened by a multiple of their
distance, the more the fewer they are drawn from; quartiles come from histograms
over all documents of the language that pass the base rules, however few. A null
language is one of its own. No language is judged by another's band.

Defined results: a null text has no words; such texts and empty ones fail the
base rules; a language without a text that passes them has a null band. Repeated
rows and ties count each for itself; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ._blobs import chunked, columns, pack, split, unpack
from ._store import drop_table, table
from ._text import BLOCK_BYTES, Block, blocks, combine, doc_of, mix, prefix_hash, span_hash, sums_by, U64

ORDER = 4
#: Most n-grams of each order that are broadcast (16 bytes each, with their contexts at most twice that); the rest is asked for.
MAX_GRAMS = 1 << 20
#: Bands of n documents are (1 + SMALL / n) times as wide: of normally distributed values, under 1 % then lie outside whatever n.
SMALL = 8
#: Log-perplexity histogram: bins of this width; a character's probability is over 1e-12 (see floor), so the histogram is bounded.
BIN = 0.002
#: Any character that training hasn't seen.
UNIFORM = 1 / 0x110000

_FOLD = np.arange(256, dtype=np.uint8)
for _k in range(128):
    _c = chr(_k)
    _FOLD[_k] = _k if _c in "\n" or "a" <= _c <= "z" else ord("A" if "A" <= _c <= "Z" else "0" if _c.isdigit() else " " if _c in " \t\r\v\f" else ".")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def base_rules(b: Block) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text of a block."""
    s, e, first = b.words()
    at = np.stack([b.start, b.end], 1).ravel()
    chars = np.concatenate([[0], np.cumsum((b.buf & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[b.buf])])
    prefix = prefix_hash(b.buf)
    h, doc = span_hash(prefix, s, e), doc_of(first)
    out = {"n_words": np.diff(first), "word_chars": sums_by(chars[e] - chars[s], first, np.int64), "n_symbols": symbols[at[1::2]] - symbols[at[::2]]}
    # lines: cut at line feeds and text ends; those with a word count if an earlier line of the text is equal
    feed = np.flatnonzero(b.buf == 10)
    ls, le = feed[:-1] + 1, feed[1:]
    word_in = np.searchsorted(s, le) > np.searchsorted(s, ls)
    ls, le = ls[word_in], le[word_in]
    ldoc = np.searchsorted(b.start, ls, "right") - 1
    out["n_dup_lines"] = np.bincount(ldoc[_again(span_hash(prefix, ls, le), ldoc)], minlength=b.n)
    # words in 3-word windows that the text has twice or more
    repeated = np.zeros(len(h), bool)
    if len(h) >= 3:
        inside = np.flatnonzero(doc[2:] == doc[:-2])
        key = mix(combine(h, 3)[inside] + doc[inside].astype(U64) * U64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        k = key[order]
        twin = k[1:] == k[:-1]
        w = inside[order[np.concatenate([[False], twin]) | np.concatenate([twin, [False]])]]
        for j in range(3):
            repeated[w + j] = True
    out["n_repeat_words"] = sums_by(repeated, first, np.int64)
    return out


def _again(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Marks the keys that the same text had before."""
    k = mix(key + doc.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(k, kind="stable")
    again = np.zeros(len(k), bool)
    again[order[1:]] = k[order[1:]] == k[order[:-1]]
    return again


def characters(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts (a character's UTF-8 bytes as a number), each text closed by a line feed, and where each text's begin."""
    lead = (b.buf & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    at = at[at > 0]
    sym = _FOLD[b.buf[at]].astype(np.uint32)
    go = np.ones(len(at), bool)
    padded = np.append(b.buf, np.zeros(3, np.uint8))
    for k in (1, 2, 3):
        x = padded[at + k]
        go &= (x & 0xC0) == 0x80
        sym |= np.where(go, x.astype(np.uint32) << np.uint32(8 * k), np.uint32(0))
    return sym, np.append(np.searchsorted(at, b.start), len(at))


def windows(sym: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(characters, ORDER): each character with those before it; a text is preceded by line feeds."""
    out = np.full((len(sym), ORDER), 10, np.uint32)
    place = np.arange(len(sym)) - np.repeat(first[:-1], np.diff(first))
    out[:, -1] = sym
    for k in range(1, ORDER):
        inside = np.flatnonzero(place >= k)
        out[inside, ORDER - 1 - k] = sym[inside - k]
    return out


def gram_hash(grams: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of characters; of no characters it is 0."""
    h = np.zeros(len(grams), U64)
    for k in range(grams.shape[1]):
        h = (h + grams[:, k].astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15)
        h ^= h >> U64(29)
    return h


def distinct(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One row's index for each distinct row, and each row's number among them."""
    inv, _ = pd.factorize(gram_hash(grams))
    most = np.maximum.accumulate(inv) if len(inv) else inv
    return np.flatnonzero(np.diff(most, prepend=-1)), inv


class KneserNey:
    """For each order the sorted hashes of its n-grams with their discounted shares, and of contexts with the mass for the lower order."""

    def __init__(self):
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
        """Modified Kneser-Ney discounts of counts 0, 1, 2 and more, from the numbers of n-grams that occur 1 to 4 times."""
        y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        d = [0.0, 1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        return np.clip(d, [0, 0.05, 0.05, 0.05], [0, 0.95, 1.9, 2.9])

    def add(self, grams: np.ndarray, count: np.ndarray, total: np.ndarray, d: np.ndarray) -> None:
        """The next higher order: distinct n-grams, their counts, and the sums of counts of all n-grams with their contexts."""
        h, c = gram_hash(grams), gram_hash(grams[:, :-1])
        share = (count - d[np.minimum(count, 3)]) / total
        by = np.argsort(h)
        ctx, inv = np.unique(c, return_inverse=True)
        self.orders.append((h[by], share[by], ctx, 1 - np.bincount(inv.ravel(), share, len(ctx))))

    def prob(self, grams: np.ndarray) -> np.ndarray:
        """Probability of each row's last character after those before it."""
        p = np.full(len(grams), UNIFORM)
        for n, (key, share, ctx, rest) in enumerate(self.orders, 1):
            some = grams[:, ORDER - n :]
            p = _look(key, share, gram_hash(some), 0.0) + _look(ctx, rest, gram_hash(some[:, :-1]), 1.0) * p
        return p


def _look(keys: np.ndarray, values: np.ndarray, h: np.ndarray, other: float) -> np.ndarray:
    """Values of the hashes that the sorted keys have, by bisection."""
    if not len(keys):
        return np.full(len(h), other)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, values[at], other)


_COLS = [f"c{k}" for k in range(ORDER)]


def count_grams(df: DataFrame, text: str = "text") -> DataFrame:
    """(c0 .. c3, n): n-grams of the highest order over all texts; each task adds up its own in part before anything is shuffled."""
    ship(df.sparkSession)

    def count(batches):
        for batch in batches:
            for _, b in blocks(batch, text):
                w = windows(*characters(b))
                at, inv = distinct(w)
                yield pa.RecordBatch.from_arrays([*(pa.array(w[at, k].view(np.int32)) for k in range(ORDER)), pa.array(np.bincount(inv, minlength=len(at)))], [*_COLS, "n"])

    out = df.select(text).where(F.col(text).isNotNull()).mapInArrow(count, ", ".join(f"{c} int" for c in _COLS) + ", n long")
    return out.groupBy(*_COLS).agg(F.sum("n").alias("n"))


def _levels(grams: DataFrame) -> list[DataFrame]:
    """Counts of the n-grams of each order, the highest first."""
    levels = [grams]
    for k in range(1, ORDER):  # continuation counts: how many characters come before an n-gram
        levels.append(levels[-1].groupBy(*_COLS[k:]).agg(F.count("*").alias("n")))
    return levels


def _times(g: DataFrame) -> dict[int, int]:
    """The counts of counts, exact up to 1,000, then by powers of 2: few rows whatever the corpus."""
    grade = F.when(F.col("n") < 1000, F.col("n")).otherwise(F.expr("shiftleft(1L, CAST(floor(log2(n)) AS INT))"))
    return {int(r["grade"]): r["times"] for r in g.groupBy(grade.alias("grade")).agg(F.count("*").alias("times")).collect()}


def _least(times: dict[int, int], most: int) -> int | None:
    """The smallest count that at most ``most`` n-grams reach; None if there is none."""
    least, kept = None, 0
    for c in sorted(times, reverse=True):
        if kept + times[c] > most:
            break
        least, kept = c, kept + times[c]
    return least


def _discounts(times: dict[int, int]) -> np.ndarray:
    return KneserNey.discounts(*(float(times.get(i, 0)) for i in (1, 2, 3, 4)))


def _model(grams: DataFrame, max_grams: int) -> KneserNey:
    """The model with at most ``max_grams`` n-grams of each order, the most frequent ones; the share of others goes to the lower order."""
    model, levels = KneserNey(), _levels(grams)
    for k in reversed(range(ORDER)):
        g, cols = levels[k], _COLS[k:]
        times = _times(g)
        least = _least(times, max_grams)
        if least is None:
            model.add(np.empty((0, ORDER - k), np.uint32), np.empty(0, np.int64), np.empty(0), np.zeros(4))
            continue
        total = g.groupBy(*cols[:-1]).agg(F.sum("n").alias("total")) if cols[:-1] else g.agg(F.sum("n").alias("total"))
        some = g.where(F.col("n") >= least)
        t = (some.join(total, cols[:-1]) if cols[:-1] else some.crossJoin(F.broadcast(total))).toArrow()  # one row
        rows = np.stack([t[c].to_numpy().view(np.uint32) for c in cols], 1)
        model.add(rows, t["n"].to_numpy(), t["total"].to_numpy().astype(np.float64), _discounts(times))
    return model


def fit_model(df: DataFrame, text: str = "text", max_grams: int = MAX_GRAMS) -> KneserNey:
    """Counts with Spark; at most ``max_grams`` rows of each order reach the driver. Whole if there are no more; :func:`quality_rules` uses no other."""
    grams, path = table(count_grams(df, text), "grams")
    model = _model(grams, max_grams)
    drop_table(df.sparkSession, path)
    return model


def gram_logs(grams: DataFrame) -> tuple[DataFrame, float]:
    """(h, n, log): hash, count and log-probability of every n-gram of the highest order, nothing cut, by joins of the orders.

    Also the log-probability of a null text's only n-gram, which may have no row: line feeds.
    """
    p, blank = None, UNIFORM
    for k, g in reversed(list(enumerate(_levels(grams)))):
        cols, n = _COLS[k:], F.col("n")
        d = _discounts(_times(g)).tolist()
        mine = n - F.when(n == 1, d[1]).when(n == 2, d[2]).otherwise(d[3])
        sums = [F.sum("n").alias("total"), (d[1] * F.count_if(n == 1) + d[2] * F.count_if(n == 2) + d[3] * F.count_if(n > 2)).alias("cut")]
        t = g.join(g.groupBy(*cols[:-1]).agg(*sums), cols[:-1]) if cols[:-1] else g.crossJoin(F.broadcast(g.agg(*sums)))  # one row
        t = t.withColumn("lower", F.lit(UNIFORM)) if p is None else t.join(p, cols[1:])
        p = t.select(*cols, *["n"] * (k == 0), ((mine + F.col("cut") * F.col("lower")) / F.col("total")).alias("lower"))
        r = g.where(F.expr(" AND ".join(f"{c} = 10" for c in cols[:-1]) or "true")).agg(*sums, F.sum(F.when(F.col(cols[-1]) == 10, mine)).alias("mine")).first()
        blank = ((r["mine"] or 0) + r["cut"] * blank) / r["total"] if r["total"] else blank

    def hashed(batches):
        for t in batches:
            h = gram_hash(np.stack([t.column(c).to_numpy().view(np.uint32) for c in _COLS], 1))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), t.column("n"), pa.array(np.log(np.maximum(t.column("lower").to_numpy(), 1e-12)))], ["h", "n", "log"])

    return p.mapInArrow(hashed, "h long, n long, log double"), float(np.log(max(blank, 1e-12)))


_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _scored(ids: pa.Array, langs: pa.Array, base: list[np.ndarray], ppl: np.ndarray) -> pa.RecordBatch:
    words, repeated = base[0], base[4]
    failed = (words < 50) | (100 * repeated > 50 * words)
    return pa.RecordBatch.from_arrays([ids, langs, *[pa.array(v.astype(np.int64)) for v in base], pa.array(failed), pa.array(ppl)], ["doc_id", "lang", *_BASE, "base_failed", "log_ppl"])


def _score_schema(df: DataFrame, doc_id: str, lang: str) -> str:
    kind = dict(df.dtypes)
    return f"doc_id {kind[doc_id]}, lang {kind[lang]}, {', '.join(f'{c} long' for c in _BASE)}, base_failed boolean, log_ppl double"


def quality_scores(df: DataFrame, model: KneserNey, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, lang, the base columns, base_failed and log_ppl of every text."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)  # at most ORDER * MAX_GRAMS n-grams

    def score(batches):
        for batch in batches:
            for part, b in blocks(batch):
                base = base_rules(b)
                sym, first = characters(b)
                w = windows(sym, first)
                at, inv = distinct(w)
                logs = np.log(np.maximum(shared.value.prob(w[at]), 1e-12))
                yield _scored(part.column(0), part.column(1), [base[c] for c in _BASE], -sums_by(logs[inv], first) / np.diff(first))

    return df.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(score, _score_schema(df, doc_id, lang))


def large_scores(df: DataFrame, grams: DataFrame, max_grams: int = MAX_GRAMS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[DataFrame, list[str]]:
    """As :func:`quality_scores`, from the counts of any number of n-grams; also the paths of tables to drop.

    A chunk of texts adds up what the ``max_grams`` most frequent n-grams give. Of the others it keeps which text has
    which, and asks for each once; a task has the questions and n-grams of one bucket of hashes at a time.
    """
    spark = df.sparkSession
    ship(spark)
    logs, blank = gram_logs(grams)
    logs, p1 = table(logs, "logs")
    least = _least(_times(logs), max_grams)
    head = logs.where(F.col("n") >= least if least else F.lit(False)).select("h", "log").toArrow()
    key = head["h"].to_numpy().view(U64)
    by = np.argsort(key)
    shared = spark.sparkContext.broadcast((key[by], head["log"].to_numpy()[by]))
    kind = dict(df.dtypes)
    i64, binary = pa.int64(), pa.binary()
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)

    def prepare(batches):
        for number, b, (ids, langs) in chunked(batches, BLOCK_BYTES):
            base = base_rules(b)
            sym, first = characters(b)
            w = windows(sym, first)
            at, inv = distinct(w)
            h = gram_hash(w[at])
            log = np.where((w[at] == 10).all(1), blank, _look(*shared.value, h, np.nan))
            rare = np.isnan(log)
            known = sums_by(np.where(rare, 0.0, log)[inv], first)
            i = np.flatnonzero(rare[inv])
            blobs = dict(base=pack(np.stack([base[c] for c in _BASE]).astype(np.int64)), chars=pack(np.diff(first).astype(np.int64)), known=pack(known), doc=pack((np.searchsorted(first, i, "right") - 1).astype(np.int32)), gram=pack((np.cumsum(rare) - 1)[inv[i]].astype(np.int32)), hashes=h[rare].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([number], i64), one(ids), one(langs), *(pa.array([x], binary) for x in blobs.values())], ["chunk", "ids", "langs", *blobs])

    src = df.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    parts, p2 = table(src.mapInArrow(prepare, f"chunk long, ids array<{kind[doc_id]}>, langs array<{kind[lang]}>, base binary, chars binary, known binary, doc binary, gram binary, hashes binary"), "parts", codec="uncompressed")
    nb = max(32, parts.count() // 8)

    def ask(batches):
        for batch in batches:
            for chunk, hashes in zip(batch.column("chunk").to_pylist(), batch.column("hashes").to_pylist()):
                h = np.frombuffer(hashes, np.int64)
                rows = [(k, h[i].tobytes()) for k, i in split(h % nb)]
                yield columns(True, bucket=([r[0] for r in rows], i64), chunk=([chunk] * len(rows), i64), hashes=([r[1] for r in rows], binary))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        key, log = right["h"].to_numpy(), right["log"].to_numpy()
        by = np.argsort(key)
        key, log = key[by], log[by]
        found = [log[np.searchsorted(key, np.frombuffer(x, np.int64))].tobytes() for x in left["hashes"].to_pylist()]
        return columns(chunk=(left["chunk"].to_pylist(), i64), hashes=(left["hashes"].to_pylist(), binary), logs=(found, binary))

    asked = parts.select("chunk", "hashes").mapInArrow(ask, "bucket long, chunk long, hashes binary").groupBy("bucket")
    rest = logs.where(F.col("n") < least if least else F.lit(True)).select(F.pmod("h", F.lit(nb)).alias("bucket"), "h", "log").groupBy("bucket")
    told = asked.cogroup(rest).applyInArrow(answer, "chunk long, hashes binary, logs binary")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        (row,) = left.drop_columns(["ids", "langs"]).to_pylist()
        ids, langs = (left[c].combine_chunks().flatten() for c in ("ids", "langs"))
        total, chars = unpack(row["known"], np.float64), unpack(row["chars"], np.int64)
        if right.num_rows:
            key, log = (np.concatenate([np.frombuffer(x, t) for x in right[c].to_pylist()]) for c, t in (("hashes", np.int64), ("logs", np.float64)))
            by = np.argsort(key)
            log = log[by][np.searchsorted(key[by], np.frombuffer(row["hashes"], np.int64))]
            total = total + np.bincount(unpack(row["doc"], np.int32), log[unpack(row["gram"], np.int32)], minlength=len(total))
        return pa.Table.from_batches([_scored(ids, langs, list(unpack(row["base"], np.int64).reshape(len(_BASE), -1)), -total / chars)])

    return parts.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(score, _score_schema(df, doc_id, lang)), [p1, p2]


def bands(scores: DataFrame, width: float = 3.0) -> DataFrame:
    """(lang, lower, upper) of log_ppl for each language, null as one of its own."""
    hist = scores.where(~F.col("base_failed")).groupBy("lang", F.floor(F.col("log_ppl") / BIN).alias("bin")).agg(F.count("*").alias("n"))
    pairs = hist.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("h"), F.sum("n").alias("n"))
    # histograms have at most log(1e12) / BIN bins
    at = lambda q: F.aggregate("h", F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("bin")), lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.when(s["seen"] < F.col("n") * q, x["bin"]).otherwise(s["bin"]).alias("bin")), lambda s: (s["bin"] + 0.5) * BIN)
    far = width * (1 + SMALL / F.col("n")) * (F.col("q3") - F.col("q1") + BIN)
    return pairs.withColumns({"q1": at(0.25), "q3": at(0.75)}).select("lang", (F.col("q1") - far).alias("lower"), (F.col("q3") + far).alias("upper"))


def quality_rules(df: DataFrame, width: float = 3.0, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_grams: int = MAX_GRAMS) -> DataFrame:
    """One row per document: doc_id, the base columns, base_failed, kept, log_ppl, lower, upper. ``max_grams``: most n-grams of an order that are broadcast; results are the same."""
    grams, path = table(count_grams(df, text), "grams")
    if grams.count() <= max_grams:  # lower orders have no more
        scores, paths = quality_scores(df, _model(grams, max_grams), doc_id, text, lang), []
    else:
        scores, paths = large_scores(df, grams, max_grams, doc_id, text, lang)
    scores, _ = table(scores, "quality")
    for p in (path, *paths):
        drop_table(df.sparkSession, p)
    band = bands(scores, width).withColumnRenamed("lang", "_lang")
    out = scores.join(band, F.col("lang").eqNullSafe(F.col("_lang")), "left")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("log_ppl").between(F.col("lower"), F.col("upper"))).alias("kept"), "log_ppl", "lower", "upper",
    )
