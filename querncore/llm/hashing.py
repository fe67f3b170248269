"""Vectorised hashes of words, runs of words and shingles over the bytes of an Arrow string column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text hashed at a time (a longer document is a slice of its own).
SLICE = 1 << 20
#: Longer ranges of bytes are hashed one by one.
LONG = 256
_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Texts:
    """The bytes of some texts, their words, and hashes of byte ranges. Nulls are empty texts."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, fold: bool):
        self.raw, self.offsets, self.fold = raw, offsets, fold
        space = _space[raw]
        if len(raw):
            first = ~space
            first[1:] &= space[:-1] | False
            edge = np.zeros(len(raw), bool)
            inner = offsets[(offsets > 0) & (offsets < len(raw))]
            edge[inner] = True
            first |= edge & ~space
            last = ~space
            last[:-1] &= space[1:] | edge[1:]
            self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        #: words of text k are bounds[k] to bounds[k + 1]
        self.bounds = np.searchsorted(self.starts, offsets)
        self._folded = None

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of byte ranges, by their bytes alone. Eight bytes at a time go through a finaliser on top of the hash of those before, so ranges of up to
        eight bytes and one length never share a hash, and others share one by chance alone, whatever their bytes; longer ones than LONG by xxh3."""
        if self._folded is None:
            folded = _lower[self.raw] if self.fold else self.raw
            self._folded = np.concatenate([folded, np.zeros(8, np.uint8)])
            # the eight bytes from each place on
            self._eight = np.ndarray(len(self.raw) + 1, "<u8", self._folded.data, strides=(1,))
        n = ends - starts
        out = mix(n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(0x9E3779B97F4A7C15))
        left = np.flatnonzero((n > 0) & (n <= LONG))
        at, rest = starts[left], n[left]
        while len(left):
            chunk = self._eight[at]
            part = np.minimum(rest, 8).astype(np.uint64)
            chunk &= np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - part * np.uint64(8))
            out[left] = mix(out[left] * np.uint64(0xA0761D6478BD642F) ^ chunk)
            more = rest > 8
            left, at, rest = left[more], at[more] + 8, rest[more] - 8
        for k in np.flatnonzero(n > LONG):
            out[k] = xxhash.xxh3_64_intdigest(self._folded[starts[k] : ends[k]].data)
        return out

    def words(self) -> np.ndarray:
        return self.hashes(self.starts, self.ends)


def slices(column: pa.Array, fold: bool, size: int = SLICE):
    """(first row, Texts) of about ``size`` bytes each; every text is whole."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    n = len(column)
    if not n:
        return
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    if column.null_count:  # the bytes under nulls do not count
        column = column.fill_null("")
        yield from slices(column, fold, size)
        return
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, Texts(raw[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], fold)
        at = to


def shingles(t: Texts, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of every run of ``width`` words; a text with fewer words, but any, has one: all of them."""
    w = t.words()
    n = np.diff(t.bounds)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(w)) - t.bounds[:-1][doc]
    h = np.zeros(len(w), np.uint64)
    for k in range(width):
        h[: len(w) - k if k else None] += w[k:] * np.uint64((2 * k + 1) * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF | 1)
    whole = place + width <= n[doc]
    short = np.flatnonzero((n > 0) & (n < width))
    one = np.array([int(np.bitwise_xor.reduce(mix(w[t.bounds[k] : t.bounds[k + 1]] + np.arange(n[k], dtype=np.uint64) + np.uint64(n[k] << 32)))) for k in short], np.uint64)
    docs, found = np.r_[doc[whole], short], mix(np.r_[h[whole], one])
    return docs, found
