"""Token counts by a whole-token shortcut, for SentencePiece BPE vocabularies.

Offline, once per process, the vocabulary itself is examined:

* No piece joins a character other than the marker U+2581 to a following marker, so merges never cross such a place and a text
  falls apart into pre-tokens (a run of markers, then other characters). Likewise a line feed that occurs in no piece stands alone.
* Every piece that is a possible pre-token is run through the merges alone. Those that come out as one token are *proven*: a
  pre-token equal to one of them counts 1 and is never merged again.

Only the other pre-tokens are merged. A bounded memo keeps their counts.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Entries of the memo of merged pre-tokens; it starts anew beyond that.
MEMO = 400_000


class BpeCounter:
    """Counts tokens as the vocabulary's merges give them."""

    def __init__(self, scores: dict[str, float], byte_fallback: bool, dummy_prefix: bool, library=None):
        self.scores, self.dummy_prefix, self.library = scores, dummy_prefix, library
        self.byte_fallback = byte_fallback
        inner = [p for p in scores if MARK in p.lstrip(MARK)]
        self.splits_at_marks = not inner
        self.lone_line_feed = not any("\n" in p for p in scores)
        line, cut = ("\n", "|\n") if self.lone_line_feed else ("", "")
        self.pattern = re.compile(f"{MARK}*[^{MARK}{line}]+|{MARK}+{cut}") if self.splits_at_marks else re.compile("(?s).+")
        whole = re.compile(f"{MARK}*[^{MARK}{line}]+|{MARK}+")
        self.proven = frozenset(p for p in scores if whole.fullmatch(p) and self.merged(p) == 1) if self.splits_at_marks else frozenset()
        self.memo: dict[str, int] = dict.fromkeys(self.proven, 1)

    @classmethod
    def load(cls, path: str) -> BpeCounter:
        """path: a SentencePiece model of kind BPE with the identity as its normaliser."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        own = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        if sp.encode("a  b", out_type=str) and sp.decode(sp.encode("a  b ")) != "a  b ":
            raise ValueError("the model's normaliser drops white space, so texts do not fall apart as this shortcut needs")
        scores = {sp.id_to_piece(i): sp.get_score(i) for i in own}
        byte_fallback = any(sp.is_byte(i) for i in range(min(300, sp.get_piece_size())))
        prefix = sp.encode("a", out_type=str)[0].startswith(MARK)
        leads = prefix and byte_fallback and MARK in scores and not any("\n" in p for p in scores)
        return cls(scores, byte_fallback, prefix, (lambda x: sp.encode(x, num_threads=1)) if leads else None)

    def merged(self, word: str) -> int:
        """Best score first, leftmost on ties, over a linked list of symbols with a heap of candidate pairs."""
        n, scores = len(word), self.scores
        if n == 1:
            return self._cost(word)
        symbols = list(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            s = scores.get(symbols[i] + symbols[i + 1])
            if s is not None:
                heap.append((-s, i, symbols[i] + symbols[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != len(both) or symbols[i] + symbols[j] != both:
                continue
            symbols[i], symbols[j] = both, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                s = scores.get(both + symbols[k])
                if s is not None:
                    heapq.heappush(heap, (-s, i, both + symbols[k]))
            h = before[i]
            if h >= 0:
                s = scores.get(symbols[h] + both)
                if s is not None:
                    heapq.heappush(heap, (-s, h, symbols[h] + both))
        return sum(self._cost(s) for s in symbols if s)

    def _cost(self, symbol: str) -> int:
        return 1 if symbol in self.scores or not self.byte_fallback else len(symbol.encode())

    def words(self, text: str | None) -> list[str]:
        """The pre-tokens of a whole text; none for null or empty texts."""
        return self.pattern.findall((MARK if self.dummy_prefix else "") + text.replace(" ", MARK)) if text else []

    def counts(self, texts: list[str | None]) -> list[int]:
        """Tokens of each whole text. The proven pre-tokens and those of the memo count directly; the rest are merged, each once."""
        found: list[int] = []
        for i in range(0, len(texts), 256):
            if len(self.memo) > MEMO + len(self.proven):
                self.memo = dict.fromkeys(self.proven, 1)
            memo, words = self.memo, [self.words(t) for t in texts[i : i + 256]]
            rest = list(set(chain.from_iterable(words)).difference(memo))
            memo.update(zip(rest, self.merge_all(rest)))
            found += [sum(map(memo.__getitem__, w)) for w in words]
            for w in rest:
                if len(w) > 64:
                    del memo[w]
        return found

    def merge_all(self, words: list[str]) -> list[int]:
        """Token counts of pre-tokens by merging: with the library's merges where they can be led to one pre-token, else with our own.
        The library puts a marker before a text; a pre-token without one stands behind a line feed there, which costs the marker
        and one byte piece more."""
        if self.library is None:
            return [self.merged(w) for w in words]
        asked = [w[1:] if w[0] == MARK else "\n" + w for w in words]
        return [len(ids) - 2 * (w[0] != MARK) if w != MARK else 1 for w, ids in zip(words, self.library(asked))]


@lru_cache(2)
def counter(path: str) -> BpeCounter:
    return BpeCounter.load(path)


def token_counts(docs: DataFrame, model_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 4096) -> DataFrame:
    """A row for each row of docs: the columns in keep, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. Texts of any length are counted whole, one at a time. Repeated rows stay, each with its counts; an empty table gives none. Other
    columns of docs, whatever their names, are not read. One narrow pass: no shuffle, a memo of bounded size per Python worker.
    """
    fields = [docs.schema[c] for c in keep]
    at = len(keep)

    def run(batches):
        c = counter(model_path)
        for b in batches:
            texts = b.column(at)
            n = pa.array(c.counts(texts.to_pylist()), pa.int64())
            size = pc.cast(pc.fill_null(pc.binary_length(texts), 0), pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(at)), size, n, pc.greater(n, limit)], names=[*(f"k{i}" for i in range(at)), "n_bytes", "n_tokens", "over_limit"])

    kinds = ", ".join(f"k{i} {f.dataType.simpleString()}" for i, f in enumerate(fields))
    out = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(text).alias("t")).mapInArrow(run, f"{kinds}, n_bytes long, n_tokens long, over_limit boolean")
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "n_bytes", "n_tokens", "over_limit")
