"""Language identification in two steps: the family, then one-versus-one SVMs within it.

Features are hashed byte n-grams of the whole text (A-Z lower-cased; ASCII signs
and digits count as spaces), as square roots of counts, scaled to unit length.
One linear SVM for each family against the rest picks a family; linear SVMs
between each two of its languages then vote.

The models are fitted in the driver on a sample: at most ``per_lang`` texts of
each language and ``max_rows`` in all, chosen by a hash of the id. Their vectors
are made where the texts are, so that the driver holds ``max_rows`` rows of
2 ** BITS numbers (256 MB) however long the texts and however many the languages.

Defined results: a null text, or one without letters, is ``und`` with score 0,
as is every text if nothing could be learned. Null languages aren't learned
from; equal votes go to the greater sum of margins, then to the first language
in order. Repeated rows and empty tables need no care; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ._linear import fit_dense, gram_codes, sigmoid
from ._text import Block, blocks

BITS, ORDERS = 13, (1, 2, 3, 4)
_FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi", "romance": "fr es it pt ro ca gl oc ast la", "slavic": "ru uk be pl cs sk sl hr sr bs bg mk", "baltic": "lt lv", "celtic": "ga gd cy br",
    "uralic": "fi et hu se", "turkic": "tr az kk uz ky tk tt", "semitic": "ar he am mt", "iranian": "fa ps ku tg", "indic": "hi bn ur pa gu mr ne or as si", "dravidian": "ta te kn ml",
    "sinitic": "zh yue wuu", "austronesian": "id ms jv su tl ceb mg haw mi", "bantu": "sw zu xh sn rw st", "tai": "th lo",
}
FAMILY = {code: family for family, codes in _FAMILIES.items() for code in codes.split()}
_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[128:] = np.arange(128, 256)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)


def family_of(lang: str, families: dict[str, str]) -> str:
    """The family of a language code (what follows - or _ doesn't count); an unknown code is a family of its own."""
    code = lang.lower().replace("_", "-").split("-")[0]
    return families.get(code, "=" + lang)


def features(b: Block) -> np.ndarray:
    """(texts, 2 ** BITS) unit vectors; a text is enclosed in spaces."""
    b.buf = _LETTERS[b.buf]
    codes = [gram_codes(b.buf, k, BITS) for k in ORDERS]
    out = np.empty((b.n, 1 << BITS), np.float32)
    for i, (s, e) in enumerate(zip(b.start.tolist(), b.end.tolist())):
        n = sum(np.bincount(c[s - 1 : e + 2 - k], minlength=1 << BITS) for c, k in zip(codes, ORDERS))
        out[i] = n
    np.sqrt(out, out=out)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


def has_letter(raw: bytes | None) -> bool:
    if not raw:
        return False
    if raw.isascii():
        return any(map(raw.__contains__, _ASCII_LETTERS))
    return any(c.isalpha() for c in raw.decode("utf-8", "replace"))


_ASCII_LETTERS = [bytes([c]) for c in b"etaonisrhldcumfpgwybvkxjqzETAONISRHLDCUMFPGWYBVKXJQZ"]


class Model:
    """SVM weights: one column for each family, then one for each pair of languages of a family."""

    def __init__(self, x: np.ndarray, langs: list[str], families: dict[str, str]):
        self.langs = sorted(set(langs))
        fam = {c: family_of(c, families) for c in self.langs}
        self.families = sorted(set(fam.values()))
        self.members = [[i for i, c in enumerate(self.langs) if fam[c] == f] for f in self.families]
        lang = np.array([self.langs.index(c) for c in langs], np.int64)
        family = np.array([self.families.index(fam[c]) for c in langs], np.int64)
        w, b = [], []
        for k in range(len(self.families)):
            self._add(w, b, x, np.where(family == k, 1, -1), len(self.families) > 1)
        self.pairs = [[(i, j) for n, i in enumerate(m) for j in m[n + 1 :]] for m in self.members]
        for i, j in [p for ps in self.pairs for p in ps]:
            mine = np.flatnonzero((lang == i) | (lang == j))
            self._add(w, b, x[mine], np.where(lang[mine] == i, 1, -1), True)
        self.w = np.stack(w, 1).astype(np.float32) if w else np.empty((1 << BITS, 0), np.float32)
        self.b = np.array(b)

    @staticmethod
    def _add(w, b, x, y, needed):
        """One SVM on the rows whose ``y`` isn't 0."""
        signs = set(y[y != 0].tolist())
        if not needed or len(signs) < 2:
            w.append(np.zeros(x.shape[1])), b.append(float(next(iter(signs), 0)))
            return
        weight = np.where(y > 0, 1 / (y > 0).sum(), np.where(y < 0, 1 / max(1, (y < 0).sum()), 0)) / 2
        a, c = fit_dense(x, y, weight)
        w.append(a), b.append(c)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language numbers and scores of unit vectors."""
        k = len(self.families)
        margin = x @ self.w[:, :k] + self.b[:k]
        fam = margin.argmax(1)
        top = margin[np.arange(len(x)), fam]
        lang, score = np.zeros(len(x), np.int64), sigmoid(4 * top)
        at = k
        for f, (members, pairs) in enumerate(zip(self.members, self.pairs)):
            rows = np.flatnonzero(fam == f)
            if len(rows):
                m = x[rows] @ self.w[:, at : at + len(pairs)] + self.b[at : at + len(pairs)]
                votes, sums = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
                where = {c: n for n, c in enumerate(members)}
                for n, (i, j) in enumerate(pairs):
                    votes[:, where[i]] += m[:, n] >= 0
                    votes[:, where[j]] += m[:, n] < 0
                    sums[:, where[i]] += np.clip(m[:, n], -3, 3)
                    sums[:, where[j]] -= np.clip(m[:, n], -3, 3)
                best = (votes * 1e4 + sums).argmax(1)
                lang[rows] = np.array(members)[best]
                if pairs:
                    score[rows] *= sigmoid(4 * sums[np.arange(len(rows)), best] / (len(members) - 1))
            at += len(pairs)
        return lang, score


def train(df: DataFrame, per_lang: int = 1000, max_rows: int = 8_192, families: dict[str, str] | None = None) -> Model:
    """Fits on (doc_id, text, lang) rows that may be learned from."""
    rows = df.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_rows // 2).collect()}
    each = min(per_lang, max_rows // max(1, len(counts)))
    h = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.lit(1 << 30))
    share = df.sparkSession.createDataFrame([(k, int(min(1.0, 1.2 * each / n) * (1 << 30))) for k, n in counts.items()], "lang string, share long")

    def vectors(batches):
        for batch in batches:
            for part, b in blocks(batch, max_bytes=1 << 20):
                ok = np.array([has_letter(x) for x in part.column(2).cast(pa.large_binary()).to_pylist()])
                rows = features(b)[ok]
                at = [np.flatnonzero(r) for r in rows]
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(ok)), part.column(1).filter(pa.array(ok)), pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()), pa.array([r[a].astype(np.float16).tobytes() for r, a in zip(rows, at)], pa.binary())], ["h", "lang", "at", "value"])

    # about `each` rows a language
    got = rows.join(F.broadcast(share), "lang").where(h < F.col("share")).select(h.alias("h"), "lang", "text").mapInArrow(vectors, "h long, lang string, at binary, value binary").toArrow()
    order = np.argsort(got["h"].to_numpy(), kind="stable")
    langs = got["lang"].to_pylist()
    taken: dict[str, int] = {}
    use = []
    for i in order.tolist():
        if taken.get(langs[i], 0) < each:
            taken[langs[i]] = taken.get(langs[i], 0) + 1
            use.append(i)
    x = np.zeros((len(use), 1 << BITS), np.float32)
    for r, i in enumerate(use):
        x[r, np.frombuffer(got["at"][i].as_py(), np.uint16)] = np.frombuffer(got["value"][i].as_py(), np.float16)
    return Model(x, [langs[i] for i in use], FAMILY if families is None else families)


def language_id(df: DataFrame, held_out: F.Column | None = None, per_lang: int = 1000, max_rows: int = 8_192, families: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    ``held_out``: a boolean column, rows that aren't learned from; by default crc32 of the id's text mod 3 = 1.
    """
    ship(df.sparkSession)
    if held_out is None:
        held_out = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1
    rows = df.select(F.col(doc_id).alias("doc_id"), held_out.alias("held_out"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(train(rows.where(~F.col("held_out")), per_lang, max_rows, families))

    def predict(batches):
        model = shared.value
        for batch in batches:
            for part, b in blocks(batch, max_bytes=1 << 20):
                raw = part.column(2).cast(pa.large_binary()).to_pylist()
                known = np.array([has_letter(x) for x in raw]) & bool(model.langs)
                pred, score = np.full(b.n, "und", object), np.zeros(b.n)
                if known.any():
                    k, s = model.predict(features(b)[known])
                    pred[known] = np.array(model.langs, object)[k]
                    score[known] = s
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pred, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    kind = dict(df.dtypes)[doc_id]
    return rows.select("doc_id", "held_out", "text").mapInArrow(predict, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
