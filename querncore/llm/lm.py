"""LM scoring: a causal self-attention model trained in numpy on subword ids, beside a smoothed unigram base over words.

A text is one sequence: the subword ids of its words, in order, then the end id. Windows of PLACES ids overlap: the first CONTEXT places of all
windows but a text's first only give context, so each id is scored once. Masked attention runs over whole batches of windows. An id is predicted
as its class: the frequent ids are classes of their own, the others share classes by rank, and within a shared class an id has its add-0.1 share of
the class's count. Classes come in two steps (group, then member of the group), so a distribution over CLASSES costs two small softmaxes; the
probabilities of all ids sum to 1 at every place.

All training documents count, and all their ids are learnt from. Documents are dealt into groups by a hash of their id and text; a group is a bounded
number of ids, so the groups grow with the corpus. Each round trains on its groups from common weights, and the groups' weights are averaged in
whole numbers. So the model depends on the rows alone, not on how they lie in tasks. Only weights, counts of ids and the most frequent words, all of
fixed size, reach the driver; rarer words are joined by their keys, with the same result.
"""

from __future__ import annotations

import ctypes
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querncore.llm.common import id_crc, most_frequent, partitions, removed, written

PLACES, CONTEXT, DIM, HIDDEN = 32, 6, 16, 32
GROUPS, MEMBERS = 16, 64
CLASSES = GROUPS * MEMBERS
#: Classes that several ids share; of fixed number.
SHARED = 96
#: Ids of a training group (but for its longest text), windows of a step, rates of the rounds.
GROUP_IDS, STEP, RATES = 1 << 20, 128, (8e-3, 8e-3, 6e-3, 3e-3)
#: Most frequent words that all tasks are told of (16 bytes each); rarer words are looked up by a join. Steers the cost alone.
TOLD = 1 << 18
#: Words that a task keeps the ids of.
MEMO = 500_000
PAD = -1
#: Weights are averaged as multiples of 2**-24.
GRAIN = 1 << 24


def lowered(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lowered."""
    return (text or "").encode().lower().split()


def word_hash(word: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


@lru_cache(1)
def keep_freed() -> None:
    """Has the C library keep freed arrays for the next step: to map and clear them anew for each costs as much as the arithmetic."""
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 25)
        libc.mallopt(-1, 1 << 26)
    except (OSError, AttributeError):
        pass  # another C library


class Subwords:
    """Subword ids of words by a SentencePiece model; a text ends in the model's end id."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size, self.unknown = self.sp.get_piece_size(), self.sp.unk_id()
        self.end = self.sp.eos_id() if self.sp.eos_id() >= 0 else self.unknown
        self.dtype = "<u2" if self.size <= 1 << 16 else "<u4"

    def ids(self, words: list[bytes]) -> list[list[int]]:
        return [x or [self.unknown] for x in self.sp.encode([w.decode() for w in words], num_threads=1)]


@lru_cache(2)
def subwords(path: str) -> Subwords:
    return Subwords(path)


class Numbers(dict):
    """Numbers from 1 on, a new one for each word that is asked for the first time; fresh: those words, in order."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.fresh.append(word)
        n = self[word] = len(self) + 1
        return n


class Words:
    """Words met so far by number, 0 being the text's end: hash, and ids one behind the other. Started anew beyond MEMO words."""

    def __init__(self, sub: Subwords):
        self.sub = sub
        self.clear()

    def clear(self) -> None:
        self.at = Numbers()
        self.n, self.used = 1, 1
        self.hash, self.start, self.size = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.ids = np.zeros(1 << 13, np.int32)
        self.size[0], self.ids[0] = 1, self.sub.end

    def full(self) -> bool:
        return self.n > MEMO

    def add(self, words: list[bytes]) -> np.ndarray:
        """Numbers of words; those not met before are entered."""
        numbers = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        fresh, self.at.fresh = self.at.fresh, []
        for i in range(0, len(fresh), 1 << 14):
            part = fresh[i : i + (1 << 14)]
            found = self.sub.ids(part)
            size = np.array([len(x) for x in found])
            lo, hi = self.n, self.n + len(part)
            if hi > len(self.hash):
                self.hash, self.start, self.size = (np.resize(x, max(hi, 2 * len(x))) for x in (self.hash, self.start, self.size))
            if self.used + size.sum() > len(self.ids):
                self.ids = np.resize(self.ids, max(self.used + int(size.sum()), 2 * len(self.ids)))
            self.hash[lo:hi] = [word_hash(w) for w in part]
            self.size[lo:hi] = size
            self.start[lo:hi] = self.used + np.cumsum(size) - size
            self.ids[self.used : self.used + int(size.sum())] = [i for x in found for i in x]
            self.n, self.used = hi, self.used + int(size.sum())
        return numbers

    def sequences(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one behind the other, and how many each has."""
        n = self.size[numbers]
        spot = np.repeat(self.start[numbers] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.ids[spot], n


def texts_of(words: Words, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of some texts, each text's end behind it, and each text's number of them."""
    each = [lowered(t) for t in texts]
    n = np.array([len(x) for x in each], np.int64)
    out = np.zeros(int(n.sum()) + len(n), np.int64)
    out[np.arange(int(n.sum())) + np.repeat(np.arange(len(n)), n)] = words.add([w for x in each for w in x])
    return out, n + 1


def classes_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of every id, the log probability of every id in its class, and the classes' masses, from the ids' counts."""
    order = np.lexsort((np.arange(len(counts)), -counts))
    own = min(len(counts), CLASSES - SHARED)
    cls = np.empty(len(counts), np.int16)
    cls[order[:own]] = np.arange(own)
    rest = order[own:]
    # shared classes of about equal mass, in order of rank
    mass = np.cumsum(counts[rest] + 0.1)
    cls[rest] = own + np.minimum(SHARED - 1, (mass / mass[-1] * SHARED).astype(np.int64)) if len(rest) else 0
    total = np.bincount(cls, counts + 0.1, minlength=CLASSES)
    return cls, np.log((counts + 0.1) / total[cls]), total


def windows(given: np.ndarray, n: np.ndarray, places: int, context: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, inputs, targets) of all windows of sequences of target classes, PAD beyond their ends. given: the sequences one behind the other,
    n: their lengths. Class CLASSES stands before a sequence. Each target comes once: those of the first context places of later windows are PAD."""
    step = places - context
    many = np.maximum(1, -(-(n - context) // step))
    room = context + many * step + 1
    at = np.cumsum(room) - room
    x = np.full(int(room.sum()), PAD, np.int16)
    x[at] = CLASSES
    x[np.arange(len(given)) + np.repeat(at + 1 - (np.cumsum(n) - n), n)] = given
    who = np.repeat(np.arange(len(n)), many)
    k = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
    spots = (at[who] + k * step)[:, None] + np.arange(places)
    inputs, targets = x[spots], x[spots + 1]
    inputs[targets == PAD] = PAD
    targets[k > 0, :context] = PAD
    return who, inputs, targets


def initial(mass: np.ndarray, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights before training; hidden unit 0 is always 1, so its rows of g and c are biases: the logs of the classes' shares."""
    r = np.random.default_rng(seed)
    d = lambda *s: r.normal(0, 0.5 / s[0] ** 0.5, s)
    p = {"emb": r.normal(0, 0.3, (CLASSES + 1, DIM)), "pos": r.normal(0, 0.05, (PLACES, DIM)), "qkv": d(DIM, 3 * DIM), "skip": d(DIM, HIDDEN), "o": d(DIM, HIDDEN), "b": np.zeros(HIDDEN)}
    p |= {"g": r.normal(0, 0.05, (HIDDEN, GROUPS)), "c": r.normal(0, 0.05, (GROUPS, HIDDEN, MEMBERS))}
    share = (mass / mass.sum()).reshape(GROUPS, MEMBERS)
    p["g"][0], p["c"][:, 0] = np.log(share.sum(axis=1)), np.log(share / share.sum(axis=1, keepdims=True))
    return {k: v.astype(np.float32) for k, v in p.items()}


def in_order(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places with targets, in order of the targets' groups, and the targets."""
    rows = np.flatnonzero(y.ravel() != PAD)
    t = y.ravel()[rows].astype(np.int64)
    order = np.argsort((t // MEMBERS).astype(np.uint8), kind="stable")
    return rows[order], t[order]


class Net:
    """The model with some weights. What depends on a class or a place alone is multiplied out beforehand."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.p, dtype = p, p["g"].dtype
        self.w = np.concatenate([p["qkv"], p["skip"]], axis=1)
        self.w[:, :DIM] *= DIM**-0.5
        self.of_class = p["emb"] @ self.w
        self.of_class[:, 3 * DIM :] += p["b"]
        self.of_place = np.zeros((PLACES, self.w.shape[1]), dtype)
        np.matmul(p["pos"], self.w[:, : 3 * DIM], out=self.of_place[:, : 3 * DIM])
        # exponents stay in range by themselves unless weights are very large
        q, k = max_norms(self.of_class) + max_norms(self.of_place)
        self.clip = q * k > 60
        self.shift = (HIDDEN * max(float(np.einsum("hj,hj->j", p["g"], p["g"]).max()), float(np.einsum("jhm,jhm->jm", p["c"], p["c"]).max()))) ** 0.5 > 60
        self.mask, self.ones = mask_of(dtype), np.ones(max(PLACES, GROUPS, MEMBERS), dtype)

    def attention(self, x: np.ndarray, skip: int = 0):
        """What stands at each place (queries, keys, values, and the place's own share of the hidden units), masked weights, their sums; the last two
        for the places from skip on."""
        places = x.shape[1]
        z = self.of_class.take(np.where(x == PAD, CLASSES, x), axis=0)
        by_window = z.reshape(len(x), -1)
        by_window += self.of_place[:places].ravel()
        a = z[:, skip:, :DIM] @ z[:, :, DIM : 2 * DIM].transpose(0, 2, 1)
        if self.clip:
            np.clip(a, -60, 60, out=a)
        np.exp(a, out=a)
        a *= self.mask[skip:places, :places]
        return z, a, (a.reshape(-1, places) @ self.ones[:places]).reshape(len(x), -1, 1)

    def hidden(self, z: np.ndarray, m: np.ndarray, rows: np.ndarray) -> np.ndarray:
        h = m.reshape(-1, DIM) @ self.p["o"]
        by_window = h.reshape(*m.shape[:2], HIDDEN)
        by_window += z[:, z.shape[1] - m.shape[1] :, 3 * DIM :]
        h = h.take(rows, axis=0)
        # tanh, at half of what np.tanh takes
        h *= -2
        with np.errstate(over="ignore"):
            np.exp(h, out=h)
        h += 1
        np.divide(2, h, out=h)
        h -= 1
        h[:, 0] = 1
        return h

    def _soft(self, logit: np.ndarray, t: np.ndarray):
        """Log probability of column t of each row, and sums of the exponents, which take the place of the logits."""
        if self.shift:
            logit -= logit.max(axis=1, keepdims=True)
        found = logit.ravel().take(t)
        np.exp(logit, out=logit)
        total = logit @ self.ones[: logit.shape[1]]
        found -= np.log(total)
        return found, total

    def outputs(self, h: np.ndarray, t: np.ndarray, back: bool = False):
        """Log probabilities of targets in order of group; with back, also the gradients of minus their mean by g, c and h."""
        p, n = self.p, len(t)
        group, first = t // MEMBERS, np.arange(n)
        in_group, in_member = first * GROUPS + group, first * MEMBERS + t % MEMBERS
        bounds = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        parts = [(j, slice(lo, hi)) for j, (lo, hi) in enumerate(zip(bounds, bounds[1:])) if lo < hi]
        of_group, of_member = h @ p["g"], np.empty((n, MEMBERS), h.dtype)
        for j, part in parts:
            np.matmul(h[part], p["c"][j], out=of_member[part])
        found, group_total = self._soft(of_group, in_group)
        more, member_total = self._soft(of_member, in_member)
        found += more
        if not back:
            return found
        for logit, total, at in ((of_group, group_total, in_group), (of_member, member_total, in_member)):
            total *= n
            logit *= np.reciprocal(total, out=total)[:, None]
            logit.ravel()[at] -= logit.dtype.type(1 / n)
        d = {"g": h.T @ of_group, "c": np.zeros_like(p["c"])}
        dh = np.empty_like(h)
        for j, part in parts:
            d["c"][j] = (of_member[part].T @ h[part]).T
            np.matmul(of_member[part], p["c"][j].T, out=dh[part])
        dh += of_group @ p["g"].T
        return found, d, dh

    def log_probs(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log probabilities of the target classes, 0 at PAD."""
        out = np.zeros(y.shape)
        # windows whose first places only give context need no answers there
        later = (y[:, :CONTEXT] == PAD).all(axis=1) & (y.shape[1] > CONTEXT)
        for skip, which in ((0, np.flatnonzero(~later)), (CONTEXT, np.flatnonzero(later))):
            for at in range(0, len(which), STEP):
                some = which[at : at + STEP]
                part = y[some, skip:]
                z, a, total = self.attention(x[some], skip)
                m = a @ z[:, :, 2 * DIM : 3 * DIM]
                m /= total
                rows, t = in_order(part)
                found = np.zeros(part.size)
                found[rows] = self.outputs(self.hidden(z, m, rows), t)
                out[some, skip:] = found.reshape(part.shape)
        return out


@lru_cache(2)
def mask_of(dtype: np.dtype) -> np.ndarray:
    """1 for the places that a place may look at: itself and those before it."""
    return np.tril(np.ones((PLACES, PLACES), dtype))


def max_norms(z: np.ndarray) -> np.ndarray:
    """Lengths of the longest query and of the longest key."""
    both = np.zeros((z.shape[1], 2), z.dtype)
    both[:DIM, 0] = both[DIM : 2 * DIM, 1] = 1
    return np.sqrt((np.square(z) @ both).max(axis=0))


def gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log probability of the targets and its gradients."""
    net = Net(p)
    z, a, total = net.attention(x)
    q, k, v = z[:, :, :DIM], z[:, :, DIM : 2 * DIM], z[:, :, 2 * DIM : 3 * DIM]
    m = a @ v
    m /= total
    rows, t = in_order(y)
    h = net.hidden(z, m, rows)
    found, d, dh = net.outputs(h, t, back=True)
    h *= h
    np.subtract(1, h, out=h)
    dh *= h
    pre = np.zeros((x.size, HIDDEN), h.dtype)
    pre[rows] = dh
    d["o"] = m.reshape(-1, DIM).T @ pre
    d["b"] = np.ones(len(pre), pre.dtype) @ pre
    dm = (pre @ p["o"].T).reshape(m.shape)
    # weights stay undivided by their sums; the slopes of the means are divided instead
    dm /= total
    da = dm @ v.transpose(0, 2, 1)
    da -= np.einsum("bld,bld->bl", dm, m)[:, :, None]
    da *= a
    dz = np.empty_like(z)
    np.matmul(da, k, out=dz[:, :, :DIM])
    np.matmul(da.transpose(0, 2, 1), q, out=dz[:, :, DIM : 2 * DIM])
    np.matmul(a.transpose(0, 2, 1), dm, out=dz[:, :, 2 * DIM : 3 * DIM])
    dz[:, :, 3 * DIM :] = pre.reshape(*x.shape, HIDDEN)
    rest = dz.reshape(-1, dz.shape[2])
    own = np.where(x == PAD, CLASSES, x).ravel()
    # places of one class together, once a place has few columns
    spots = np.arange((CLASSES + 1) * DIM).reshape(-1, DIM).take(own, axis=0)
    d["emb"] = np.bincount(spots.ravel(), (rest @ net.w.T).ravel(), minlength=(CLASSES + 1) * DIM).reshape(-1, DIM).astype(h.dtype)
    w = (rest.T @ p["emb"].take(own, axis=0)).T
    by_place = (np.ones(len(x), h.dtype) @ dz.reshape(len(x), -1)).reshape(x.shape[1], -1)
    w[:, : 3 * DIM] += p["pos"][: x.shape[1]].T @ by_place[:, : 3 * DIM]
    w[:, :DIM] *= DIM**-0.5
    d["qkv"], d["skip"] = w[:, : 3 * DIM], w[:, 3 * DIM :]
    d["pos"] = np.zeros_like(p["pos"])
    d["pos"][: x.shape[1]] = by_place[:, : 3 * DIM] @ net.w[:, : 3 * DIM].T
    return float(-found.mean()), d


def trained(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, rate: float, seed) -> dict[str, np.ndarray]:
    """The weights after a step of Adam on every STEP windows, in an order that the seed tells."""
    # all weights one behind the other, and views of them
    all_p = flat(p)
    p = views(all_p, p)
    m, s, room = (np.zeros_like(all_p) for _ in range(3))
    order = np.random.default_rng(seed).permutation(len(x))
    for n, at in enumerate(range(0, len(order), STEP), 1):
        some = order[at : at + STEP]
        g = flat(gradients(p, x[some], y[some])[1])
        # the rate grows with a step's windows, so that a last, small step does not weigh like a full one
        fix = np.float32(rate * len(some) / STEP * (1 - 0.99**n) ** 0.5 / (1 - 0.9**n))
        m += np.multiply(np.subtract(g, m, out=room), np.float32(0.1), out=room)
        g *= g
        s += np.multiply(np.subtract(g, s, out=g), np.float32(0.01), out=g)
        np.sqrt(s, out=g)
        g += np.float32(1e-8)
        all_p -= np.divide(np.multiply(m, fix, out=room), g, out=room)
    return p


def views(v: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = v[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def unflat(v: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: x.astype(np.float32) for k, x in views(v, like).items()}


def learnt(given: DataFrame, ids: int, cls: np.ndarray, mass: np.ndarray, dtype: str, seed: int) -> dict[str, np.ndarray]:
    """Weights from the training texts. given: h long (a hash of a text and its id), ids binary; ids: how many ids they hold in all.

    A group holds about GROUP_IDS ids and trains by itself; rounds take the groups in turn, and the weights of a round's groups are averaged as whole
    multiples of 1 / GRAIN, so neither their order nor the tasks that held them matter. A task holds one group at a time."""
    spark, p = given.sparkSession, initial(mass, seed)
    rounds = len(RATES)
    groups = max(rounds, -(-ids // GROUP_IDS))
    tasks = min(-(-groups // rounds), 16 * partitions(spark))
    kinds = "groups long, weights binary"

    def packed(n, total):
        return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["groups", "weights"])

    def summed(batches):
        n, acc = 0, 0
        for b in batches:
            for k, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, acc = n + k, acc + np.frombuffer(w, np.int64)
        if n:
            yield packed(n, acc)

    group = F.pmod("h", F.lit(groups))
    for r, rate in enumerate(RATES):
        sent = spark.sparkContext.broadcast((p, cls))  # some 300 KB, of fixed size

        def run(batches, rate=rate, sent=sent):
            keep_freed()
            start, c = sent.value
            n, acc, own, held = 0, 0, None, []

            def finished():
                seqs = [np.frombuffer(x, dtype) for x in held]
                size = np.array([len(x) for x in seqs])
                _, x, y = windows(c[np.concatenate(seqs)], size, PLACES, 0)
                return np.rint(flat(trained(start, x, y, rate, (seed, own))).astype(np.float64) * GRAIN).astype(np.int64)

            for b in batches:
                for g, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if g != own and held:
                        n, acc, held = n + 1, acc + finished(), []
                    own = g
                    held.append(x)
            if held:
                yield packed(n + 1, acc + finished())

        some = given.select(group.alias("group"), "ids", "h").filter(F.col("group") % rounds == r)
        dealt = some.repartitionById(tasks, (F.floor(F.col("group") / rounds) % tasks).cast("int")).sortWithinPartitions("group", "h")
        parts = dealt.select("group", "ids").mapInArrow(run, kinds).repartition(8).mapInArrow(summed, kinds).collect()
        if parts:
            total = sum(np.frombuffer(x.weights, np.int64) for x in parts)
            p = unflat(total / (sum(x.groups for x in parts) * GRAIN), p)
        sent.unpersist()
    return p


def packed_slice(words: Words, numbers: np.ndarray, met: np.ndarray, n: np.ndarray, crc: np.ndarray) -> bytes:
    """The words of some texts: the hashes of those met (the end first), each text's crc and number of words, and the words as places among those met.
    met: how often each word of the table occurs."""
    which = np.flatnonzero(met)
    place = np.empty(len(met), np.uint16 if len(which) <= 1 << 16 else np.uint32)
    place[which] = np.arange(len(which))
    head = np.array([len(n), len(which), place.itemsize], np.int64)
    return b"".join(x.tobytes() for x in (head, words.hash[which], crc.astype(np.int64), n.astype(np.int64), place[numbers]))


def unpacked_slice(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, crcs, numbers of words, words)"""
    docs, met, width = np.frombuffer(raw, np.int64, 3).tolist()
    at = np.cumsum([24, 8 * met, 8 * docs, 8 * docs]).tolist()
    hashes, crc, n = (np.frombuffer(raw, np.int64, k, o) for k, o in zip((met, docs, docs), at))
    return hashes, crc, n, np.frombuffer(raw, np.uint16 if width == 2 else np.uint32, -1, at[3]).astype(np.int64)


def _gather(path: str, folds: int):
    """Rows of kind 0: a word's hash, its count in training texts and in all; kind 1, of each training text: a hash of id and text, its row number, its
    id, and its subword ids; kind 2: an id and its count in training texts; kind 3: number of training texts; kind 4, of each text held out: as kind 1,
    without the hash; kind 5, of each slice of texts: its first row number, and its words, packed. Counts are summed up in the task."""

    def run(batches):
        sub = subwords(path)
        words = Words(sub)
        counts, every = np.zeros(0, np.int64), np.zeros(0, np.int64)
        of_id, docs = np.zeros(sub.size, np.int64), 0
        task = TaskContext.get()
        row = (task.partitionId() if task else 0) << 36

        def out(kind, key, c, n=None, ids=None):
            ids = pa.nulls(len(key), pa.binary()) if ids is None else pa.array(ids, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key, pa.int64()), pa.array(c, pa.int64()), pa.array(c if n is None else n, pa.int64()), ids], names=["kind", "key", "c", "n", "ids"])

        def counted():
            for i in range(1, words.n, 1 << 16):
                part = slice(i, min(i + (1 << 16), words.n))
                yield out(0, words.hash[part], counts[part], every[part])

        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                numbers, n = texts_of(words, part.column(0).to_pylist())
                crc, doc_ids = part.column(1).to_numpy(), part.column(2).to_pylist()
                learn = (crc % folds) != 0
                mine = np.repeat(learn, n)
                counts, every = (np.r_[x, np.zeros(words.n - len(x), np.int64)] for x in (counts, every))
                met = np.bincount(numbers, minlength=words.n)
                every += met
                if learn.any():
                    counts += np.bincount(numbers[mine], minlength=words.n)
                ids, size = words.sequences(numbers)
                size = np.add.reduceat(size, np.cumsum(n) - n)
                of_id += np.bincount(ids[np.repeat(learn, size)], minlength=sub.size)
                docs += int(learn.sum())
                raw = [x.tobytes() for x in np.split(ids.astype(sub.dtype), np.cumsum(size)[:-1])]
                for kind, some in ((1, np.flatnonzero(learn).tolist()), (4, np.flatnonzero(~learn).tolist())):
                    if some:
                        key = [0 if kind == 4 else word_hash(raw[k] + str(doc_ids[k]).encode()) for k in some]
                        yield out(kind, key, [row + k for k in some], [doc_ids[k] for k in some], [raw[k] for k in some])
                yield out(5, [row], [0], None, [packed_slice(words, numbers, met, n, crc)])
                row += len(n)
                if words.full():
                    yield from counted()
                    words.clear()
                    counts, every = np.zeros(0, np.int64), np.zeros(0, np.int64)
        yield from counted()
        some = np.flatnonzero(of_id)
        yield out(2, some, of_id[some])
        if docs:
            yield out(3, [0], [docs])

    return run


def _score(dtype: str, sent):
    """From rows of kind 1 and 4: row number, id and score of each text."""

    def run(batches):
        keep_freed()
        weights, cls, within = sent.value[:3]
        net = Net(weights)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                b = whole.slice(lo, 256)
                raw = b.column(2).to_pylist()
                size = np.array([len(x) for x in raw]) // np.dtype(dtype).itemsize
                ids = np.frombuffer(b"".join(raw), dtype)
                of = np.repeat(np.arange(len(size)), size)
                who, x, y = windows(cls[ids], size, PLACES, CONTEXT)
                score = np.bincount(who, net.log_probs(x, y).sum(axis=1), minlength=len(size)) + np.bincount(of, within[ids], minlength=len(size))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score / np.log(10))], names=["rid", "doc_id", "score"])

    return run


def _base(sent, denom: float, ends: int):
    """From rows of kind 5: row number, crc, counts and base score of each text by the words told, and the hashes of its other words."""

    def run(batches):
        keys, counts = sent.value[3:]
        share = np.log10((counts + 0.1) / denom)
        for b in batches:
            for row, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                h, crc, n, numbers = unpacked_slice(raw)
                at = np.minimum(np.searchsorted(keys, h), max(0, len(keys) - 1))
                #: per word: told or not, known, base score
                told = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                known = told & (counts[at] > 0) if len(keys) else told.copy()
                base = np.where(told, share[at], 0.0) if len(keys) else np.zeros(len(h))
                told[0], known[0], base[0] = True, ends > 0, np.log10((ends + 0.1) / denom)
                doc = np.repeat(np.arange(len(n)), n)
                add = lambda v: np.bincount(doc, v[numbers], minlength=len(n))
                away = ~told[numbers]
                rare = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(doc, away, minlength=len(n)))].astype(np.int32)), pa.array(h[numbers[away]]))
                yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(len(n))), pa.array(crc), pa.array(n), pa.array(add(known).astype(np.int64)), pa.array(add(base)), rare], names=["rid", "crc", "n_tokens", "n_known", "base", "rare"])

    return run


def lm_scores(docs: DataFrame, tokenizer_path: str, folds: int = 10, text: str = "text", doc_id: str = "doc_id", seed: int = 11, told: int = TOLD) -> DataFrame:
    """A row for each row of docs: doc_id, held_out boolean (crc32 of the id as text modulo folds is 0), n_tokens, n_known, train_tokens long,
    base_score double, score double.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, and one end. base_score is the sum over tokens of log10((c + 0.1) / (N + 0.1
    (V + 1))) by the counts in all documents that are not held out; n_known counts tokens with c > 0. score is the model's log10 probability of the
    text's subword ids and its end. A null text counts as empty (the end alone); null ids are held out; repeated rows each count and get their row;
    an empty table gives none. A very long text is scored in windows as any other; in training it belongs to one group. Without training documents the
    model stays as it started and N and V are 0. Words are looked up by 64-bit hashes. Other columns are not read.

    Texts are read once, to gather: the subword ids of all and their words are written, and what follows reads those. The ids of training texts are dealt
    to their groups once.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t"), id_crc(doc_id).alias("crc"))
    gathered = written(own.select("t", "crc", "doc_id").mapInArrow(_gather(tokenizer_path, folds), "kind byte, key long, c long, n long, ids binary"), "gathered", "zstd")
    vocabulary = written(gathered.filter("kind = 0").groupBy("key").agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "vocabulary")
    n_words, v_words = vocabulary.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    ends = int(gathered.filter("kind = 3").agg(F.sum("c")).first()[0] or 0)
    total, kinds = (n_words or 0) + ends, v_words + (ends > 0)
    denom = float(total + 0.1 * (kinds + 1))
    sub = subwords(tokenizer_path)
    # ids' counts are as many as the vocabulary
    of_id = np.zeros(sub.size)
    for r in gathered.filter("kind = 2").groupBy("key").agg(F.sum("c").alias("c")).collect():
        of_id[r.key] = r.c
    cls, within, mass = classes_of(of_id)
    weights = learnt(gathered.filter("kind = 1").select(F.col("key").alias("h"), "ids"), int(of_id.sum()), cls, mass, sub.dtype, seed)
    # the most frequent of all documents, so that no word that is joined is frequent in those held out
    top, frequent = most_frequent(vocabulary, "n", told)
    top = top.sort_by("key")
    sent = spark.sparkContext.broadcast((weights, cls, within, top.column("key").to_numpy(), top.column("c").to_numpy()))  # some 5 MB, of fixed size
    rid = F.col("c").alias("rid")
    scored = written(gathered.filter("kind in (1, 4)").select(rid, F.col("n").alias("doc_id"), "ids").mapInArrow(_score(sub.dtype, sent), "rid long, doc_id long, score double"), "scored")
    based = written(gathered.filter("kind = 5").select("key", "ids").mapInArrow(_base(sent, denom, ends), "rid long, crc long, n_tokens long, n_known long, base double, rare array<long>"), "based")
    removed(gathered)
    looked = based.select("rid", F.explode("rare").alias("key"))
    c = F.col("c")
    late = looked.join(vocabulary.filter(~frequent), "key").groupBy("rid").agg(F.sum(F.log10((c + 0.1) / F.lit(denom))).alias("more"), F.count_if(c > 0).alias("more_known"))
    out = based.drop("rare").join(scored, "rid").join(late, "rid", "left")
    more = lambda name, to: F.col(name) + F.coalesce(to, F.lit(0))
    return out.select("doc_id", (F.col("crc") % folds == 0).alias("held_out"), "n_tokens", more("n_known", "more_known").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), more("base", "more").alias("base_score"), "score")
