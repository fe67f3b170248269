"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: at line feeds, and inside a line behind words chosen by their own hash (one of four), so that an edit
changes the paragraphs that it touches and no others; a run of equal or uncut words is cut every 16. The digest of a paragraph's
second, third, ... occurrence is one of its own. Each digest is put into one cell of each third of a
sketch: a cell holds how many digests it got, their sum, and the sum of their checks. Two versions' sketches subtract cell by cell; what
both hold cancels, and cells left with a single digest are peeled until the differing digests are all recovered.

A fingerprint is such a sketch as text, so the likeness of two versions comes from their two fingerprints alone (``fingerprint_likeness``,
``likeness_of``) while they differ in few digests. Where cells remain, a fingerprint is too small for the difference: both sketches are then made anew
from the texts with four times the cells, again and again (``differences``), until peeling recovers everything or the sketches have cells enough for all
digests; what even these leave (a digest that one text holds twice by chance) is compared digest by digest.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from querncore.llm.common import bucket_of, partitions, split_points
from querncore.llm.hashing import Texts, mix, slices

#: Cells of a fingerprint (a multiple of three); one of so many words ends a paragraph.
CELLS, ONE_OF = 48, 4
#: Words of a paragraph at most.
LONGEST = 16
PARTS = 3
#: A cell in a fingerprint: count, sum and check, little-endian.
CELL = np.dtype([("c", "<u4"), ("t", "<u8"), ("k", "<u4")])
#: Checks have so many bits.
LOW = np.uint64(0xFFFFFFFF)


def digests(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(text, digest) of the paragraphs of texts."""
    if not len(t.starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = np.diff(t.bounds)
    doc = np.repeat(np.arange(len(n)), n)
    cut = t.words() >> np.uint64(40) & np.uint64(ONE_OF - 1) == 0
    lines = np.cumsum(np.r_[0, t.raw == 10])
    cut[:-1] |= lines[t.starts[1:]] != lines[t.ends[:-1]]
    cut[:-1] |= doc[1:] != doc[:-1]
    cut[-1] = True
    before = np.r_[0, np.flatnonzero(cut)[:-1] + 1]
    place = np.arange(len(cut)) - np.repeat(before, np.diff(np.r_[before, len(cut)]))
    cut |= place % LONGEST == LONGEST - 1
    last = np.flatnonzero(cut)
    first = np.r_[0, last[:-1] + 1]
    d = t.hashes(t.starts[first], t.ends[last])
    doc = doc[first]
    order = np.lexsort((d, doc))
    doc, d = doc[order], d[order]
    runs = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (d[1:] != d[:-1])])
    again = (np.arange(len(d)) - np.repeat(runs, np.diff(np.r_[runs, len(d)]))).astype(np.uint64)
    return doc, np.where(again > 0, mix(d + again * np.uint64(0xA0761D6478BD642F)), d)


def check_of(d: np.ndarray) -> np.ndarray:
    return mix(d ^ np.uint64(0xC0FFEE123456789)) >> np.uint64(32)


class Sketches:
    """Sketches of many texts at once, each of ``cells`` cells."""

    def __init__(self, texts: int, cells: int):
        self.cells, self.third = cells, cells // PARTS
        size = texts * cells
        self.count, self.total, self.check = np.zeros(size, np.int64), np.zeros(size, np.uint64), np.zeros(size, np.uint64)

    def spots(self, doc: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Places of digests in the cells, one row for each third."""
        return np.stack([doc * self.cells + k * self.third + (mix(d + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(self.third)).astype(np.int64) for k in range(PARTS)])

    def add(self, doc: np.ndarray, d: np.ndarray, sign: np.ndarray | int) -> np.ndarray:
        spots, check = self.spots(doc, d), check_of(d)
        sign = np.broadcast_to(np.asarray(sign, np.int64), d.shape)
        wrap = sign.view(np.uint64) if sign.flags.c_contiguous else np.ascontiguousarray(sign).view(np.uint64)
        for s in spots:
            np.add.at(self.count, s, sign)
            np.add.at(self.total, s, d * wrap)
            np.add.at(self.check, s, check * wrap)
        return spots

    def peel(self, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes out the digests that the cells give up. Digests recovered with sign +1 and -1 by text; which texts are done."""
        plus, minus = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
        look = np.flatnonzero(self.count)
        for _ in range(4096):
            c = self.count[look]
            pure = look[np.abs(c) == 1]
            sign = self.count[pure]
            d = self.total[pure] * sign.view(np.uint64)
            good = check_of(d) == self.check[pure] * sign.view(np.uint64) & LOW
            pure, sign, d = pure[good], sign[good], d[good]
            doc = pure // self.cells
            order = np.lexsort((d, doc))
            doc, d, sign = doc[order], d[order], sign[order]
            fresh = np.r_[True, (doc[1:] != doc[:-1]) | (d[1:] != d[:-1])] if len(d) else np.zeros(0, bool)
            doc, d, sign = doc[fresh], d[fresh], sign[fresh]
            if not len(d):
                break
            np.add.at(plus, doc[sign > 0], 1)
            np.add.at(minus, doc[sign < 0], 1)
            look = np.unique(self.add(doc, d, -sign))
        busy = np.flatnonzero((self.count != 0) | (self.total != 0) | (self.check & LOW != 0)) // self.cells
        done = np.ones(texts, bool)
        done[busy] = False
        return plus, minus, done


def strings(doc: np.ndarray, d: np.ndarray, texts: int, cells: int = CELLS) -> list[str]:
    """The fingerprints: the cells in base64."""
    s = Sketches(texts, cells)
    s.add(doc, d, 1)
    packed = np.zeros((texts, cells), CELL)
    packed["c"], packed["t"], packed["k"] = (x.reshape(texts, cells) for x in (s.count.astype(np.uint32), s.total, s.check & LOW))
    return [base64.b64encode(row.tobytes()).decode() for row in packed]


def parsed(fingerprints: list[str], cells: int = CELLS) -> np.ndarray:
    """The cells of fingerprints, a row for each."""
    raw = b"".join(map(base64.b64decode, fingerprints))
    return np.frombuffer(raw, CELL).reshape(len(fingerprints), cells)


def subtracted(first: list[str], second: list[str], cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For pairs of fingerprints: the first's number of digests, how many digests only the first holds, and only the second, and whether the cells gave all of
    them up (only then do the numbers before count)."""
    a, b = parsed(first, cells), parsed(second, cells)
    s = Sketches(len(first), cells)
    s.count = (a["c"].astype(np.int64) - b["c"].astype(np.int64)).ravel()
    s.total, s.check = (a["t"] - b["t"]).ravel(), (a["k"].astype(np.uint64) - b["k"].astype(np.uint64)).ravel()
    only_a, only_b, done = s.peel(len(first))
    return a["c"].sum(axis=1, dtype=np.int64) // PARTS, only_a, only_b, done


def share(n: np.ndarray, only_a: np.ndarray, only_b: np.ndarray) -> np.ndarray:
    """Common digests over all digests of a pair, in 0 to 1; 1 for two texts without any. n: digests of the first."""
    every = n + only_b
    return np.where(every > 0, (n - only_a) / np.maximum(every, 1), 1.0)


def fingerprint_likeness(first: list[str], second: list[str], cells: int = CELLS) -> np.ndarray:
    """The likeness of pairs of fingerprints, from these alone; nan where they differ in more digests than their cells give up."""
    n, only_a, only_b, done = subtracted(first, second, cells)
    return np.where(done, share(n, only_a, only_b), np.nan)


@F.pandas_udf(DoubleType())
def likeness_of(first: pd.Series, second: pd.Series) -> pd.Series:
    """Columns of fingerprints -> their likeness; null where one is null or they differ in too many digests."""
    out = pd.Series(np.nan, index=first.index)
    some = first.notna() & second.notna()
    out[some] = fingerprint_likeness(first[some].tolist(), second[some].tolist())
    return out.astype(object).where(out.notna(), None)


def one_by_one(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], texts: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``differences`` gives, digest by digest."""
    doc, d = np.r_[a[0], b[0]], np.r_[a[1], b[1]]
    sign = np.r_[np.ones(len(a[0]), np.int64), -np.ones(len(b[0]), np.int64)]
    order = np.lexsort((d, doc))
    doc, d, sign = doc[order], d[order], sign[order]
    first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (d[1:] != d[:-1])]) if len(doc) else np.zeros(0, np.int64)
    net = np.add.reduceat(sign, first) if len(first) else sign
    return (np.bincount(doc[first], np.maximum(w, 0), texts).astype(np.int64) for w in (net, -net))


def differences(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], texts: int, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of versions (text, digest): how many digests only the first holds, and only the second, by sketches of ``cells`` cells, subtracted and peeled;
    what they leave, by four times the cells, until these are twice the digests of the pair; what is left then, digest by digest."""
    only_a, only_b = np.zeros(texts, np.int64), np.zeros(texts, np.int64)
    open_ = np.arange(texts)
    while len(open_):
        held = np.bincount(a[0], minlength=len(open_)) + np.bincount(b[0], minlength=len(open_))
        s = Sketches(len(open_), cells)
        s.add(*a, 1)
        s.add(*b, -1)
        plus, minus, done = s.peel(len(open_))
        only_a[open_[done]], only_b[open_[done]] = plus[done], minus[done]
        stuck = ~done & (cells >= 2 * held)
        if stuck.any():
            plus, minus = one_by_one(a, b, len(open_))
            only_a[open_[stuck]], only_b[open_[stuck]] = plus[stuck], minus[stuck]
        a, b, open_ = (*of(a, b, ~done & ~stuck), open_[~done & ~stuck])
        cells *= 4
    return only_a, only_b


def of(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], some: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The digests of some texts, these numbered anew."""
    place = np.cumsum(some) - 1
    return [(place[doc[some[doc]]], d[some[doc]]) for doc, d in (a, b)]


def likeness(first: list[str], second: list[str], a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], cells: int = CELLS) -> np.ndarray:
    """The likeness of pairs of fingerprints; where these do not give it, that of larger ones made from the texts' digests."""
    n, only_a, only_b, done = subtracted(first, second, cells)
    if not done.all():
        only_a[~done], only_b[~done] = differences(*of(a, b, ~done), int((~done).sum()), cells * 4)
    return share(n, only_a, only_b)


def _compare(keep: int):
    def run(batches):
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                n = 1024
                b = whole.slice(at, n)
                at += n
                cols = []
                for k in range(keep, keep + 3):
                    doc, d = [], []
                    for first, t in slices(b.column(k), fold=False):
                        x, y = digests(t)
                        doc.append(x + first)
                        d.append(y)
                    cols.append((np.concatenate(doc), np.concatenate(d)))
                own, edited, following = cols
                m = b.num_rows
                prints = [strings(*x, m) for x in cols]
                near = [likeness(prints[0], prints[k], own, x) for k, x in ((1, edited), (2, following))]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k) for k in range(keep)), *map(pa.array, prints[:2]), *map(pa.array, near)],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return run


def with_next(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """id, t and next: the text of the row that follows in descending order of ids; after the last row comes the first.

    Rows are dealt over ranges of ids of about equal size. The largest id of each range is given to the range before it too,
    as its look-ahead, so every row finds what follows it within its range: one shuffle of the texts and no window over all rows.
    Null ids come last; rows with equal ids are ordered by their texts, nulls (taken as empty) among them. A table of one row is
    followed by itself.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    points = split_points(rows, "id", 4 * parts)
    ranges = rows.select(bucket_of(points)("id").alias("range"), "id")
    # a row for each range: the largest id, a null only where a range holds nothing else
    tops = ranges.groupBy("range").agg(F.max("id").alias("top")).orderBy("range").collect()
    if not tops:
        return rows.withColumn("next", F.col("t"))
    before = [(r.top, tops[k + 1].range if k + 1 < len(tops) else tops[0].range, k + 1 == len(tops)) for k, r in enumerate(tops)]
    ahead = spark.createDataFrame(before, "top long, range int, wraps boolean")
    dealt = rows.withColumn("range", bucket_of(points)("id")).withColumn("extra", F.lit(0))
    looked = dealt.select("id", "t").join(F.broadcast(ahead), F.col("id").eqNullSafe(F.col("top"))).select("id", "t", "range", F.lit(1).alias("extra"))
    # only the first of a range's rows in the order is looked at; equal ids all come along
    order = Window.partitionBy("range").orderBy("extra", F.desc_nulls_last("id"), "t")
    both = dealt.unionByName(looked)
    return both.withColumn("next", F.lead("t").over(order)).filter("extra = 0").select("id", "t", "next")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each row of docs: doc_id, n_chars long (code points), edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next.

    The edited text is the text with its last floor(n_chars / 3) code points replaced by as many of the next text's first
    (or all); what is next says ``with_next``. near_edited and near_next are the likeness of its fingerprint to the edited text's and to
    the next text's: common digests over all; where the fingerprints differ in too much to tell, that of larger ones. A very long text is cut into digests
    whole; its fingerprint is as long as any other. A null text counts as empty; a text without words has the
    sketch without digests; two such are alike to 1. Equal texts have equal fingerprints. Repeated rows each get their row; an empty
    table gives none; other columns are not read.
    """
    rows = with_next(docs, text, doc_id)
    n = F.char_length("t")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), n - third), F.substring(F.col("next"), F.lit(1), third))
    rows = rows.select("id", n.cast("long").alias("n_chars"), edited.alias("edited"), "t", "next")
    rows = rows.select("id", "n_chars", F.sha2("edited", 256).alias("sha"), "t", "edited", "next")
    return rows.mapInArrow(_compare(3), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
