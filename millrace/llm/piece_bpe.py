"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut before each run of spaces that follows another character; no
piece crosses such a cut (checked on the model, else ValueError), so distinct
words are encoded once for each block. A round finds in flat symbol arrays the
best-ranked pair of every word (a segmented minimum), merges its occurrences
from the left, and compacts; it ends when no pair is left. A round's cost is the
symbols of the words that go on, so a very long word would cost its square:
words of more than ``LONG_WORD`` characters take the same merges in the same
order (best rank, then leftmost) from a heap, in n log n.

Defined results: a null text is empty; an empty text has no ids and decodes to
the empty text. Rows are encoded one by one, whatever their length; extra
columns are ignored and ties, repeated rows and empty tables need no care.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Distinct words whose ids a task remembers; beyond, it starts afresh (speed only).
CACHE_WORDS = 120_000
#: Words that a round of merges handles together, so that its arrays stay in the processor's cache.
ROUND_WORDS = 16384
#: Longer words (in characters) are merged by a heap.
LONG_WORD = 256
_NONE = np.iinfo(np.int32).max
_WORD = re.compile("▁*[^▁]*")


class PieceModel:
    """Tables of a sentencepiece BPE model, read from its file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        norm = m.normalizer_spec
        if m.trainer_spec.model_type != 2 or not m.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or m.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback, identity normalisation and a dummy prefix")
        self.size = len(m.pieces)
        text = {p.piece: (i, p.score) for i, p in enumerate(m.pieces) if p.type == 1}
        if any(p.type in (4, 5) for p in m.pieces):
            raise ValueError("user-defined and unused pieces aren't supported")
        if any("▁" in p.lstrip("▁") for p in text):
            raise ValueError("a piece crosses a word's start")
        self.byte_id = np.zeros(256, np.int64)
        self.decoded: list[bytes] = [b""] * self.size
        for i, p in enumerate(m.pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.decoded[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == 1:
                self.decoded[i] = p.piece.replace("▁", " ").encode()
        self.char_id = {p: i for p, (i, _) in text.items() if len(p) == 1}
        # symbols: piece ids; characters that aren't pieces get ids from `size` on and never merge, unless a piece holds them
        self.extra: dict[str, int] = {}
        symbol = lambda p: text[p][0] if p in text else self._extra(p) if len(p) == 1 else None
        order = {s: k for k, s in enumerate(sorted({s for _, s in text.values()}, reverse=True))}
        left, right, to, rank = [], [], [], []
        for p, (i, s) in text.items():
            for k in range(1, len(p)):
                a, b = symbol(p[:k]), symbol(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), to.append(i), rank.append(order[s])
        self.extra_base = self.size
        self.width = self.size + len(self.extra) + 1
        key = np.array(left, np.int64) * self.width + np.array(right, np.int64)
        at = np.argsort(key)
        self.key, self.to, self.rank = key[at], np.array(to, np.int32)[at], np.array(rank, np.int64)[at]
        # A merge is safe to make everywhere at once if what it gives can't merge further at as good a rank.
        best = np.full(self.width, np.iinfo(np.int64).max)
        np.minimum.at(best, np.array(left, np.int64), np.array(rank, np.int64))
        np.minimum.at(best, np.array(right, np.int64), np.array(rank, np.int64))
        self.safe = best[self.to] > self.rank
        self.of_char = np.full(0x110000, self.width - 1, np.int32)
        for c, i in (self.char_id | self.extra).items():
            self.of_char[ord(c)] = i
        self.table: dict[int, tuple[int, int]] | None = None  # pair to rank and piece, made where needed
        self.strings = [str(i) for i in range(self.size)]
        self._build_slots()

    def _build_slots(self, bits: int = 18) -> None:
        """Two-choice tables from pair to merge; the few pairs that collide in both are kept aside, sorted."""
        self.bits = bits
        left = np.arange(len(self.key))
        self.slots = []
        for factor in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            slot = (self.key[left].astype(np.uint64) * np.uint64(factor)) >> np.uint64(64 - bits)
            _, first = np.unique(slot, return_index=True)
            t = np.full(1 << bits, len(self.key), np.int32)
            t[slot[first].astype(np.int64)] = left[first]
            self.slots.append((np.uint64(factor), t))
            left = np.delete(left, first)
        self.rest = left
        self.keys1 = np.append(self.key, -2)  # the last entry stands for no merge
        self.rank1 = np.append(self.rank, _NONE).astype(np.int32)

    def _find(self, pair: np.ndarray) -> np.ndarray:
        """Index of each pair's merge; len(key) where there is none."""
        u = pair.astype(np.uint64)
        shift = np.uint64(64 - self.bits)
        (f1, t1), (f2, t2) = self.slots
        k = t1[(u * f1) >> shift]
        miss = np.flatnonzero(self.keys1[k] != pair)
        if len(miss):
            k2 = t2[(u[miss] * f2) >> shift]
            k2[self.keys1[k2] != pair[miss]] = len(self.key)
            if len(self.rest):
                i = np.minimum(np.searchsorted(self.key[self.rest], pair[miss]), len(self.rest) - 1)
                k2 = np.where(self.key[self.rest][i] == pair[miss], self.rest[i], k2)
            k[miss] = k2
        return k

    def _extra(self, c: str) -> int:
        return self.extra.setdefault(c, self.size + len(self.extra))

    def merge_long(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of one long word, and each one's first character."""
        if self.table is None:
            self.table = dict(zip(self.key.tolist(), zip(self.rank.tolist(), self.to.tolist())))
        table, width, n = self.table, self.width, len(sym)
        first = self._find(sym[:-1].astype(np.int64) * width + sym[1:])
        some = np.flatnonzero(first < len(self.key))
        heap = ((self.rank1[first[some]].astype(np.int64) << 32) | some).tolist()
        heapq.heapify(heap)
        s, after, before = sym.tolist(), [*range(1, n), -1], [*range(-1, n - 1)]
        while heap:
            x = heapq.heappop(heap)
            p, rank = x & 0xFFFFFFFF, x >> 32
            q = after[p]
            if s[p] < 0 or q < 0:
                continue
            m = table.get(s[p] * width + s[q])
            if m is None or m[0] != rank:  # one of the two has changed since
                continue
            s[p], s[q] = m[1], -1
            r = after[p] = after[q]
            if r >= 0:
                before[r] = p
                m = table.get(s[p] * width + s[r])
                if m is not None:
                    heapq.heappush(heap, m[0] << 32 | p)
            o = before[p]
            if o >= 0:
                m = table.get(s[o] * width + s[p])
                if m is not None:
                    heapq.heappush(heap, m[0] << 32 | o)
        out = np.array(s, np.int32)
        at = np.flatnonzero(out >= 0)
        return out[at], at

    def encode_words(self, words: list[str]) -> tuple[list[int], list[int]]:
        """Piece ids of all words (spaces are U+2581) and where each word's begin, with the end."""
        chars = "".join(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer(chars.encode("utf-32-le", "surrogatepass"), np.uint32)
        sym = self.of_char[code]
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        at = np.arange(len(code), dtype=np.int32)  # each symbol's first character
        found, owner = np.full(len(code), -1, np.int32), word  # each final symbol at its first character
        none = np.int32(_NONE)
        if len(size) and size.max() > LONG_WORD:
            stop = np.cumsum(size)
            for i in np.flatnonzero(size > LONG_WORD).tolist():
                a = int(stop[i] - size[i])
                got, where = self.merge_long(sym[a : stop[i]])
                found[a + where] = got
            short = np.repeat(size <= LONG_WORD, size)
            sym, word, at = sym[short], word[short], at[short]
        while len(sym) > 1:
            same = word[1:] == word[:-1]
            k = self._find(np.where(same, sym[:-1].astype(np.int64) * self.width + sym[1:], -1))
            rank = np.append(self.rank1[k], none)  # a word's last symbol starts no pair
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            low = np.minimum.reduceat(rank, starts)
            low = np.repeat(low, np.diff(np.append(starts, len(sym))))
            keep = low < none
            if not keep.all():  # words without a pair are complete
                done = ~keep
                found[at[done]] = sym[done]
            # of overlapping occurrences take the 1st, 3rd, ... of each run; unsafe merges one at a time
            hit = np.flatnonzero((rank == low) & keep)
            if not len(hit):
                sym = sym[:0]
                break
            follows = np.concatenate([[False], hit[1:] == hit[:-1] + 1])
            if follows.any():
                place = np.arange(len(hit))
                hit = hit[(place - np.maximum.accumulate(np.where(follows, 0, place))) % 2 == 0]
            careful = ~self.safe[k[hit]]
            if careful.any():
                w = word[hit]
                hit = hit[~(careful & np.concatenate([[False], w[1:] == w[:-1]]))]
            sym[hit] = self.to[k[hit]]
            keep[hit + 1] = False
            sym, word, at = sym[keep], word[keep], at[keep]
        found[at[: len(sym)]] = sym
        at = np.flatnonzero(found >= 0)
        sym, word = found[at], owner[at]
        raw = np.flatnonzero(sym >= self.size)
        if len(raw):  # byte fallback
            parts = [[s] for s in sym.tolist()]
            for j in raw.tolist():
                parts[j] = self.byte_id[list(chars[at[j]].encode("utf-8", "surrogatepass"))].tolist()
            n = np.fromiter(map(len, parts), np.int64, len(parts))
            sym, word = np.array([x for p in parts for x in p], np.int64), np.repeat(word, n)
        return sym.tolist(), np.searchsorted(word, np.arange(len(words) + 1)).tolist()

@lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    return PieceModel(path)


class Cache:
    """Ids (as text) of the words seen so far; ``odd``: decoded bytes of words that don't decode to themselves."""

    def __init__(self):
        self.ids: dict[str, str] = {}
        self.odd: dict[str, bytes] = {}


def encode_texts(model: PieceModel, texts: list[bytes | None], cache: Cache) -> list[tuple[str, bytes]]:
    """For each text: its ids, joined by commas, and the decoded text in UTF-8."""
    split = []
    for raw in texts:
        if not raw:
            split.append([])
            continue
        t = "▁" + raw.decode("utf-8", "replace").replace(" ", "▁")
        words = t.split("▁")
        if "" in words[1:]:  # runs of spaces stay together, with the word that follows
            words = [w for w in _WORD.findall(t) if w]
        else:
            words = ["▁" + w for w in words[1:]]
        split.append(words)
    seen = set().union(*split)
    todo = [w for w in seen if w not in cache.ids]
    if len(cache.ids) + len(todo) > CACHE_WORDS:
        cache.ids = {w: i for w, i in cache.ids.items() if w in seen}
        cache.odd = {w: i for w, i in cache.odd.items() if w in seen}
    if todo:
        for k in range(0, len(todo), ROUND_WORDS):
            some = todo[k : k + ROUND_WORDS]
            ids, at = model.encode_words(some)
            text = [model.strings[i] for i in ids]
            back = [model.decoded[i] for i in ids]
            plain = "\n".join(some).replace("▁", " ").encode().split(b"\n") if not any("\n" in w for w in some) else [w.replace("▁", " ").encode() for w in some]
            for w, p, a, b in zip(some, plain, at, at[1:]):
                cache.ids[w] = ",".join(text[a:b])
                d = b"".join(back[a:b])
                if d != p:
                    cache.odd[w] = d
    out = []
    for words in split:
        if not words:
            out.append(("", b""))
            continue
        if cache.odd and not cache.odd.keys().isdisjoint(words):
            raw = b"".join([cache.odd.get(w) or w.replace("▁", " ").encode() for w in words])
        else:
            raw = "".join(words).replace("▁", " ").encode()
        out.append((",".join(map(cache.ids.__getitem__, words)), raw[1:] if raw[:1] == b" " else raw))
    return out


def _lists(joined: list[str]) -> pa.Array:
    """The ids as lists."""
    n = np.array([j.count(",") + 1 if j else 0 for j in joined])
    flat = np.array(",".join([j for j in joined if j]).split(","), dtype=np.int32) if n.any() else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat))


def piece_bpe(df: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text", ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``ids`` also ids (array).

    ``model_path`` must name the file on every executor. Null and empty texts: no ids.
    """

    ship(df.sparkSession)

    def encode(batches):
        model, cache = load(model_path), Cache()
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            a = 0
            while a < len(texts):
                b, size = a, 0
                part = []
                while b < len(texts) and (not part or size < 1 << 20):
                    x = texts[b].as_py()
                    part.append(x)
                    size += len(x) if x else 0
                    b += 1
                got = encode_texts(model, part, cache)
                joined, back = [g[0] for g in got], [g[1] for g in got]
                cols = [batch.column(0).slice(a, b - a), pa.array([j.count(",") + 1 if j else 0 for j in joined], pa.int64()), pa.array([hashlib.sha256(j.encode()).hexdigest() for j in joined]), pa.array([hashlib.sha256(t).hexdigest() for t in back])]
                if ids:
                    cols += [_lists(joined)]
                del got, joined, back
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])
                a = b

    kind = dict(df.dtypes)[doc_id]
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
