"""SentencePiece encoding and decoding: the unigram model's best segmentation by Viterbi over a double-array trie of pieces.

White space is the marker U+2581; a marker is put before a text. Characters that no piece covers become byte pieces. The best
segmentation of a text is that of its pre-tokens (markers, then other characters) where no piece holds a marker behind
another character, which is examined on the pieces; a bounded memo keeps the segmentations of short pre-tokens.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MEMO = 300_000
#: What a character outside the pieces costs more than the worst piece, in log score.
UNKNOWN = 10.0


class DoubleArray:
    """A trie in two arrays: the child of state s by character code c is t = base[s] + c where check[t] = s. Codes start at 1;
    code 0 leads to a key's value, which base holds as -1 - value."""

    def __init__(self, keys: list[str]):
        """keys: distinct; a key's value is its place in the list."""
        self.codes = {c: k + 1 for k, c in enumerate(sorted({c for key in keys for c in key}))}
        self.base, self.check = [0], [0]
        self.free = 1
        order = sorted(range(len(keys)), key=lambda i: keys[i])
        self._build([(keys[i], i) for i in order])
        self.size = len(self.base)

    def _grow(self, n: int) -> None:
        if n >= len(self.base):
            more = n + 1 - len(self.base)
            self.base += [0] * more
            self.check += [-1] * more

    def _build(self, keys: list[tuple[str, int]]) -> None:
        todo = [(0, 0, len(keys), 0)]  # state, first key, behind the last, depth
        codes = self.codes
        while todo:
            state, lo, hi, depth = todo.pop()
            children: list[tuple[int, int, int]] = []
            i = lo
            while i < hi:
                key = keys[i][0]
                c = codes[key[depth]] if depth < len(key) else 0
                j = i + 1
                while j < hi and (codes[keys[j][0][depth]] if depth < len(keys[j][0]) else 0) == c:
                    j += 1
                children.append((c, i, j))
                i = j
            base = self._place([c for c, _, _ in children])
            self.base[state] = base
            for c, i, j in children:
                self.check[base + c] = state
            for c, i, j in children:
                if c == 0:
                    self.base[base] = -1 - keys[i][1]
                else:
                    todo.append((base + c, i, j, depth + 1))

    def _place(self, codes: list[int]) -> int:
        while self.free < len(self.check) and self.check[self.free] != -1:
            self.free += 1
        at, first, tried = max(1, self.free - codes[0]), codes[0], 0
        if len(codes) > 1 and self.free < len(self.check) - 4096:
            at = max(at, len(self.check) - 4096)  # nodes with several children look near the end: building stays linear
        while True:
            self._grow(at + codes[-1])
            if self.check[at + first] == -1 and all(self.check[at + c] == -1 for c in codes):
                return at
            at += 1
            tried += 1


class Unigram:
    """pieces: (string, log score); bytes_at: the id of the byte piece 0, None without byte fallback; ids: of the pieces."""

    def __init__(self, pieces: list[tuple[str, float]], ids: list[int], bytes_at: int | None, unknown_id: int):
        self.pieces, self.bytes_at, self.unknown_id = pieces, bytes_at, unknown_id
        self.trie = DoubleArray([p for p, _ in pieces])
        self.score, self.ids = [s for _, s in pieces], ids
        #: UTF-8 of every id's piece; ids without one (control pieces, the unknown one) stand for nothing
        self.raw_of = [b""] * (1 + max([unknown_id, *ids, *([bytes_at + 255] if bytes_at is not None else [])]))
        for (p, _), i in zip(pieces, ids):
            self.raw_of[i] = p.encode()
        for b in range(256 if bytes_at is not None else 0):
            self.raw_of[bytes_at + b] = bytes([b])
        self.worst = min(self.score) - UNKNOWN
        apart = not any(MARK in p.lstrip(MARK) for p, _ in pieces)
        self.pattern = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if apart else "(?s).+")
        if apart and not any("\n" in p for p, _ in pieces):
            self.pattern = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self.memo: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str) -> Unigram:
        """A SentencePiece model. A unigram model's scores are taken as they are; a BPE model's are merge ranks (0, -1, ...), from
        which log scores follow by Zipf's law: -log(rank + 2.7), less the log of their sum."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        own = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        raw = np.array([sp.get_score(i) for i in own])
        if raw.max() <= 0 and np.all(raw == np.floor(raw)):
            rank = np.where(raw < -1e8, len(raw), -raw)  # pieces that no merge led to come last
            weight = 1.0 / (rank + 2.7)
            raw = np.log(weight / weight.sum())
        first = next((i for i in range(n) if sp.is_byte(i)), None)
        return cls([(sp.id_to_piece(i), float(s)) for i, s in zip(own, raw)], own, first, sp.unk_id())

    def segment(self, word: str) -> list[int]:
        """The best segmentation of one pre-token. Ties: the longer last piece."""
        n = len(word)
        best, back, took = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        base, check, score = self.trie.base, self.trie.check, self.score
        size = len(check)
        codes = [self.trie.codes.get(c, -1) for c in word]
        for i in range(n):
            s, here, single = 0, best[i], False
            for j in range(i, n):
                c = codes[j]
                if c < 0:
                    break
                t = base[s] + c
                if t >= size or check[t] != s:
                    break
                s = t
                e = base[s]
                if e > 0 and check[e] == s and base[e] < 0:
                    v = -1 - base[e]
                    x = here + score[v]
                    single |= j == i
                    if x > best[j + 1]:
                        best[j + 1], back[j + 1], took[j + 1] = x, i, v
            if not single and here + self.worst > best[i + 1]:
                best[i + 1], back[i + 1], took[i + 1] = here + self.worst, i, -1
        out, at = [], n
        while at:
            i, v = back[at], took[at]
            if v >= 0:
                out.append(self.ids[v])
            elif self.bytes_at is None:
                out.append(self.unknown_id)
            else:
                out += [self.bytes_at + b for b in reversed(word[i:at].encode())]
            at = i
        return out[::-1]

    def encode(self, text: str | None) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit integers; none for null or empty texts."""
        if not text:
            return b""
        memo, out = self.memo, []
        for w in self.pattern.findall(MARK + text.replace(" ", MARK)):
            got = memo.get(w)
            if got is None:
                got = np.array(self.segment(w), "<u4").tobytes()
                if len(w) <= 64:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[w] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: byte pieces in a row are UTF-8 (what is not becomes U+FFFD), markers are spaces, the first is dropped."""
        raw = b"".join(map(self.raw_of.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "replace").replace(MARK, " ").removeprefix(" ")


@lru_cache(2)
def model(path: str) -> Unigram:
    return Unigram.load(path)


def encode_texts(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each row of docs: the columns in keep, n_tokens long, ids binary (little-endian unsigned 32-bit integers),
    decoded string, round_trip boolean (decoded equals the text).

    Null texts count as empty: no ids, the empty text. A text's own U+2581 decodes as a space, so round_trip is false there.
    Repeated rows stay; an empty table gives none; other columns are not read. One narrow pass without a shuffle.
    """
    at = len(keep)

    def run(batches):
        m = model(model_path)
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                texts = [t or "" for t in b.column(at).to_pylist()]
                ids = [m.encode(t) for t in texts]
                decoded = [m.decode(np.frombuffer(x, "<u4")) for x in ids]
                cols = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.string()), pa.array([a == b for a, b in zip(texts, decoded)])]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(at)), *cols], names=[*(f"k{k}" for k in range(at)), "n_tokens", "ids", "decoded", "round_trip"])

    kinds = ", ".join(f"k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    out = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).alias("t")).mapInArrow(run, f"{kinds}, n_tokens long, ids binary, decoded string, round_trip boolean")
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "n_tokens", "ids", "decoded", "round_trip")
