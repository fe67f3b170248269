"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, and a calibrating temperature.

Random indexing gives every term a fixed sparse vector of +1 and -1, from its hash. A term's word vector is its own index vector plus, for the
frequent terms of the training sample, the (damped) sum of the index vectors that stand near it. A document is the mean of its
terms' vectors, with the norms of that mean (which tell how much terms repeat) and the logarithm of its length. Terms are words with
their letters lowered, and each word's shape (kinds of characters in turn), so words never seen still count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querncore.llm.common import id_crc, removed, small_batches, written
from querncore.llm.hashing import Texts, mix, slices

#: Labelled rows that are learnt from, at most: those with the smallest hashes of their ids. The one bound on a sample here.
SAMPLE = 6000
DIM, NONZERO, FREQUENT, WINDOW = 48, 6, 4000, 2
WIDTH = 2 * DIM + 4
THRESHOLD = 0.3
#: Kinds of bytes in a shape: digits, lower case and letters beyond ASCII, upper case; any other byte is its own kind.
_kind = np.arange(256, dtype=np.uint8)
_kind[ord("0") : ord("9") + 1] = ord("9")
_kind[ord("a") : ord("z") + 1] = ord("a")
_kind[128:] = ord("a")
_kind[ord("A") : ord("Z") + 1] = ord("A")


def shape_hashes(t: Texts) -> np.ndarray:
    """Hashes of words' shapes: the kinds of their bytes, runs of one kind counted once."""
    kinds = _kind[t.raw]
    fresh = np.ones(len(kinds), bool)
    fresh[1:] = kinds[1:] != kinds[:-1]
    fresh[t.starts] = True
    place = np.cumsum(fresh)  # behind each byte: bytes kept so far
    runs = Texts(kinds[fresh], np.array([0, int(fresh.sum())]), fold=False)
    return runs.hashes(place[t.starts] - 1, place[t.ends - 1])


def pooled(doc: np.ndarray, h: np.ndarray, texts: int) -> np.ndarray:
    """Sums over each text of its terms' index vectors: NONZERO entries of +1 or -1 at places that the hash tells."""
    out = np.zeros(texts * DIM)
    for k in range(NONZERO):
        r = mix(h + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        spot = doc * DIM + (r % np.uint64(DIM)).astype(np.int64)
        out += np.bincount(spot, np.where(r >> np.uint64(40) & np.uint64(1), 1.0, -1.0), minlength=len(out))
    return out.reshape(texts, DIM)


@dataclass
class Quality:
    """A trained classifier. terms, context: hashes of the sample's frequent terms, ascending, and what context adds to their vectors; then
    the features' means and scales, the network's weights, and the temperature."""

    terms: np.ndarray
    context: np.ndarray
    mean: np.ndarray = None
    scale: np.ndarray = None
    w1: np.ndarray = None
    b1: np.ndarray = None
    w2: np.ndarray = None
    b2: float = 0.0
    temperature: float = 1.0

    def features(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), WIDTH))
        for first, t in slices(texts, fold=True):
            m = len(t.offsets) - 1
            n = np.diff(t.bounds)
            doc = np.repeat(np.arange(m), n)
            h = t.words()
            x = np.zeros((m, WIDTH))
            x[:, :DIM] = pooled(doc, h, m)
            x[:, DIM : 2 * DIM] = pooled(doc, shape_hashes(t), m)
            if len(self.terms) and len(h):
                at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
                known = self.terms[at] == h
                pair, times = np.unique(doc[known] * len(self.terms) + at[known], return_counts=True)
                add = self.context[pair % len(self.terms)] * times[:, None]
                who = pair // len(self.terms)
                starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, int)
                if len(who):
                    x[who[starts], :DIM] += np.add.reduceat(add, starts, axis=0)
            some = np.maximum(n, 1)[:, None]
            x[:, : 2 * DIM] /= some
            x[:, 2 * DIM] = np.log1p(n)
            x[:, 2 * DIM + 1] = np.linalg.norm(x[:, :DIM], axis=1)
            x[:, 2 * DIM + 2] = np.linalg.norm(x[:, DIM : 2 * DIM], axis=1)
            x[:, 2 * DIM + 3] = np.log1p(np.diff(t.offsets) / some[:, 0])
            x[n == 0] = 0
            out[first : first + m] = x
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0)
        return h @ self.w2 + self.b2

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(self.features(texts)) / self.temperature, -40, 40)))


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts and how often each stands there."""
    found = [t.words() for _, t in slices(texts, fold=True)]
    return np.unique(np.concatenate(found or [np.zeros(0, np.uint64)]), return_counts=True)


def index_of(terms: np.ndarray) -> np.ndarray:
    return np.rint(pooled(np.arange(len(terms)), terms, len(terms))).astype(np.int64)


def context_of(texts: pa.Array, terms: np.ndarray, index: np.ndarray) -> np.ndarray:
    """For each term (ascending hashes) the sum of the index vectors of the terms that stand near it in some texts; whole numbers, so that the order in
    which texts are summed up does not matter."""
    out = np.zeros((len(terms), DIM), np.int64)
    for _, t in slices(texts, fold=True):
        h = t.words()
        if not len(h) or not len(terms):
            continue
        doc = np.repeat(np.arange(len(t.offsets) - 1), np.diff(t.bounds))
        at = np.minimum(np.searchsorted(terms, h), len(terms) - 1)
        known = terms[at] == h
        for d in range(1, WINDOW + 1):
            ok = known[d:] & known[:-d] & (doc[d:] == doc[:-d])
            a, b = at[d:][ok], at[:-d][ok]
            pair, times = np.unique(np.r_[a * len(terms) + b, b * len(terms) + a], return_counts=True)
            if len(pair):
                own, near = pair // len(terms), pair % len(terms)
                first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                out[own[first]] += np.add.reduceat(index[near] * times[:, None], first, axis=0)
    return out


def to_length_one(context: np.ndarray) -> np.ndarray:
    return context / np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)


def fit(texts: list[str | None], labels: list[int], **how) -> Quality:
    """A classifier from texts that are at hand."""
    column = pa.array(texts, pa.large_string())
    terms, times = terms_of(column)
    terms = np.sort(terms[np.lexsort((terms, -times))[:FREQUENT]])
    model = Quality(terms, to_length_one(context_of(column, terms, index_of(terms))))
    return trained(model, model.features(column), np.array(labels, np.float64), **how)


def trained(model: Quality, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 40, seed: int = 7) -> Quality:
    """Trains on the features of four of five rows and sets the temperature on the fifth. Without both labels the score is the labels' (smoothed) mean."""
    model.mean, model.scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
    rng = np.random.default_rng(seed)
    model.w1, model.b1 = (rng.normal(0, (2 / WIDTH) ** 0.5, (WIDTH, hidden)), np.zeros(hidden))
    model.w2, model.b2 = rng.normal(0, (1 / hidden) ** 0.5, hidden), 0.0
    if len(set(y.tolist())) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        model.w2, model.b2 = np.zeros(hidden), float(np.log(p / (1 - p)))
        return model
    z = (x - model.mean) / model.scale
    order = rng.permutation(len(y))
    tune, learn = order[: len(y) // 5], order[len(y) // 5 :]
    if len(tune) < 20:
        tune = learn = order
    params = [model.w1, model.b1, model.w2, np.array([0.0])]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        learn = rng.permutation(learn)
        for at in range(0, len(learn), 64):
            rows = learn[at : at + 64]
            a, t = z[rows], y[rows]
            pre = a @ params[0] + params[1]
            h = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40)))
            d = (p - t) / len(rows)
            back = np.outer(d, params[2]) * (pre > 0)
            grads = [a.T @ back + 1e-3 * params[0], back.sum(axis=0), h.T @ d + 1e-3 * params[2], np.array([d.sum()])]
            step += 1
            rate = 3e-3 * (1 - epoch / epochs)
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                params[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.w1, model.b1, model.w2, model.b2 = *params[:3], float(params[3][0])
    raw, t = model.logits(x[tune]), y[tune]
    grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
    loss = [float(np.mean(np.logaddexp(0, raw / g) - t * raw / g)) for g in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    return model


def learn(docs: DataFrame, labels: DataFrame, usable=None, sample: int = SAMPLE, label: str = "quality", text: str = "text", doc_id: str = "doc_id") -> Quality:
    """Fits on at most ``sample`` labelled rows, those with the smallest hashes of their ids; usable: a condition on the id. Null labels and null ids are
    passed over; of labels that repeat an id, the smallest counts, and of documents that repeat one, any.

    Terms are counted, contexts summed up and features made in tasks, a very long text's like any other's; the driver gets the sample's ids and
    features, the frequent terms and their contexts, all of fixed size, and no text."""
    spark = docs.sparkSession
    small_batches(spark)
    own = labels.select(F.col(doc_id).cast("long").alias("_id"), F.col(label).cast("int").alias("_label")).filter("_id is not null and _label is not null")
    if usable is not None:
        own = own.filter(usable(F.col("_id")))
    chosen = own.groupBy("_id").agg(F.min("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    chosen = spark.createDataFrame([(r._id, r._label) for r in chosen.collect()], "_id long, _label int")
    rows = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id").dropDuplicates(["_id"])
    rows = written(rows.select("_text", "_id", "_label").repartition(8, "_id"), "sample")

    def counted(batches):
        for b in batches:
            h, n = terms_of(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["term", "n"])

    counts = rows.mapInArrow(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    terms = np.array([r.term for r in counts.orderBy(F.desc("n"), "term").limit(FREQUENT).collect()], np.int64).view(np.uint64)
    terms = np.sort(terms)
    index = index_of(terms)
    sent = spark.sparkContext.broadcast((terms, index))

    def summed(batches):
        out = 0
        for b in batches:
            out = out + context_of(b.column(0), *sent.value)
        if not np.isscalar(out):
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["context"])

    # a row for each of eight tasks
    parts = [np.frombuffer(r.context, np.int64).reshape(len(terms), DIM) for r in rows.coalesce(8).mapInArrow(summed, "context binary").collect()]
    model = Quality(terms, to_length_one(sum(parts, np.zeros((len(terms), DIM)))))
    ready = spark.sparkContext.broadcast(model)

    def made(batches):
        for b in batches:
            x = ready.value.features(b.column(0))
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "label", "x"])

    got = sorted(((r.id, r.label, r.x) for r in rows.mapInArrow(made, "id long, label int, x binary").collect()), key=lambda r: r[0])
    removed(rows)
    x = np.array([np.frombuffer(x) for *_, x in got]).reshape(len(got), WIDTH)
    return trained(model, x, np.array([y for _, y, _ in got], np.float64))


def score(docs: DataFrame, model: Quality, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each row of docs: the columns in keep and score double (0 to 1). Null and empty texts get the score of a text without
    words. One narrow pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, of fixed size
    at = len(keep)

    def run(batches):
        m = sent.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(at)), pa.array(m.scores(b.column(at)))], names=[*(f"k{k}" for k in range(at)), "score"])

    kinds = ", ".join(f"k{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(keep))
    out = docs.select(*(F.col(c).alias(f"k{k}") for k, c in enumerate(keep)), F.col(text).alias("t")).mapInArrow(run, f"{kinds}, score double")
    return out.select(*(F.col(f"k{k}").alias(c) for k, c in enumerate(keep)), "score")


def accepted(docs: DataFrame, model: Quality, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold. One narrow pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        m = sent.value
        for b in batches:
            yield b.filter(pa.array(m.scores(b.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def quality(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out boolean (crc32 of the id as text modulo folds is 0; those ids' labels are not learnt from), score double,
    predicted int (1 if score >= 0.3).

    Nothing but the text goes into a score. Null and empty texts are scored too, very long ones whole; repeated rows each get their row; null ids are
    held out; an empty table gives none; without labels every score is 0.5. Other columns are not read.
    """
    model = learn(docs, labels, lambda c: id_crc(c) % folds != 0, sample)
    out = score(docs, model)
    return out.select("doc_id", (id_crc("doc_id") % folds == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
