"""Quality, nearest neighbours, language model, mixing, pipeline."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from tests.conftest import DATA

from querncore.llm import lm, mixing, nearest, quality
from tests.llm.conftest import EDGE, SCHEMA, rows_of

# --- quality


def test_quality_on_held_out_labels(spark):
    d, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.quality(d, labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(got[i].score, y) for i, y in truth.items() if i in got and got[i].held_out]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.97 and np.mean([s >= 0.3 for s in good]) > 0.98


def test_quality_edges(spark, edge, empty):
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, 0), (None, 1, 1), (9, None, 0)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        got = quality.quality(edge, given).collect()
        assert len(got) == len(EDGE) and all(0 <= r.score <= 1 for r in got)
        assert quality.quality(empty, given).count() == 0
    assert all(r.score == 0.5 for r in quality.quality(edge, labels.limit(0)).collect())


def test_scores_do_not_depend_on_batches():
    import pyarrow as pa

    texts = [t for _, t, _ in EDGE]
    m = quality.fit([f"good words number {k}" for k in range(40)] + [f"### {k} ###" for k in range(40)], [1] * 40 + [0] * 40)
    together = m.scores(pa.array(texts, pa.string()))
    assert np.allclose(together, [m.scores(pa.array([t], pa.string()))[0] for t in texts])
    assert m.scores(pa.array(["good words number 99"]))[0] > 0.5 > m.scores(pa.array(["### 7 ###"]))[0]


# --- nearest neighbours


def brute_nearest(rows, k, is_query):
    best = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            best[i] = min(best.get(i, tuple(v)), tuple(v))
    out = []
    for q, v in best.items():
        if is_query(q):
            found = sorted((-float((np.array(v, float) * np.array(w, float)).sum()), i) for i, w in best.items() if i != q and len(w) == len(v))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("n,queries,candidates", [(300, 1024, 16384), (300, 4, 37), (3, 4, 37)])
def test_nearest_is_exact(spark, n, queries, candidates):
    rng = np.random.default_rng(n)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 1, 8)]) for i in range(n)]
    rows += [(1000 + k, rows[0][1]) for k in range(30)] + [(2000, [1.0, 2.0]), (2010, [2.0, 1.0])] + [(rows[1][0], rows[1][1])]
    rows += [(3000, None), (3010, [0.0] * 8), (3020, [float("nan")] * 8), (3030, [None] + [1.0] * 7), (3040, [float("inf")] * 8), (3050, []), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, block int, dim int")
    got = sorted(map(tuple, nearest.nearest(df, "vec_id % 10 = 0", 5, queries=queries, candidates=candidates).collect()))
    want = brute_nearest(rows, 5, lambda q: q % 10 == 0)
    assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)


def test_nearest_of_nothing(spark):
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id % 20 = 0").count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x, y = rng.normal(0, 3, (50, 17)), rng.normal(0, 1e-3, (60, 17))
    (cx, sx, ex), (cy, sy, ey) = nearest.quantised(x), nearest.quantised(y)
    dots = (cx.astype(float) @ cy.astype(float).T) * sx[:, None] * sy[None, :]
    slack = (np.linalg.norm(x, axis=1) + ex)[:, None] * ey[None, :] + ex[:, None] * np.linalg.norm(y, axis=1)[None, :]
    assert (np.abs(x @ y.T - dots) <= slack * (1 + 1e-9) + 1e-12).all()


# --- language model


def base_scores(rows, folds=10):
    low = lambda t: (t or "").encode().lower().split()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % folds == 0
    train = [low(t) for i, t, *_ in rows if not held(i)]
    c = Counter(w for t in train for w in t)
    if train:
        c[None] = len(train)
    total = sum(c.values())
    denom = total + 0.1 * (len(c) + 1)
    return sorted(((i, held(i), len(low(t)) + 1, sum(c.get(w, 0) > 0 for w in [*low(t), None]), total, round(sum(math.log10((c.get(w, 0) + 0.1) / denom) for w in [*low(t), None]), 4)) for i, t, *_ in rows), key=str)


@pytest.mark.parametrize("told", [5, 1 << 18])
def test_base_scores_equal_brute_force(spark, edge, piece_model, told):
    got = lm.lm_scores(edge, piece_model, told=told).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=str) == base_scores(EDGE)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_lm_of_nothing(empty, spark, piece_model):
    assert lm.lm_scores(empty, piece_model).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    only = lm.lm_scores(spark.createDataFrame(rows_of((held, "some words", "a")), SCHEMA), piece_model).first()
    assert only.train_tokens == 0 and only.n_known == 0 and math.isfinite(only.score)


def test_windows_score_each_target_once():
    for places, context in ((lm.PLACES, lm.CONTEXT), (lm.PLACES, 0), (4, 1)):
        n = np.array([1, 2, 3, 7, places, places + 1, 100])
        given = np.arange(n.sum()) % 900
        who, x, y = lm.windows(given, n, places, context)
        assert y[y != lm.PAD].tolist() == given.tolist()
        assert np.bincount(np.repeat(who, (y != lm.PAD).sum(axis=1)), minlength=len(n)).tolist() == n.tolist()


def random_weights(seed=1):
    r = np.random.default_rng(seed)
    return {k: r.normal(0, 0.4, v.shape) for k, v in lm.initial(np.ones(lm.CLASSES)).items()}


def plain_log_prob(p, before, target):
    """Of one class behind those of its window, by plain loops over places."""
    e = p["emb"][before]
    q, k, v = (((e + p["pos"][: len(before)]) @ p["qkv"])[:, i * lm.DIM : (i + 1) * lm.DIM] for i in range(3))
    weight = np.exp([float(q[-1] @ k[j]) / math.sqrt(lm.DIM) for j in range(len(before))])
    h = np.tanh((weight[:, None] * v).sum(axis=0) / weight.sum() @ p["o"] + e[-1] @ p["skip"] + p["b"])
    h[0] = 1
    group, member = divmod(int(target), lm.MEMBERS)
    soft = lambda z, i: z[i] - math.log(np.exp(z).sum())
    return soft(h @ p["g"], group) + soft(h @ p["c"][group], member)


def test_gradients_and_causality():
    rng = np.random.default_rng(1)
    p = random_weights()
    x, y = rng.integers(0, lm.CLASSES, (3, 8)), rng.integers(0, lm.CLASSES, (3, 8))
    y[0, 5:] = x[0, 5:] = lm.PAD
    _, d = lm.gradients(p, x, y)
    for k in p:
        at = tuple(int(rng.integers(0, n)) for n in p[k].shape)
        at = (int(x[1, 2]), 3) if k == "emb" else (int(y[1, 1]) // lm.MEMBERS, 3, int(y[1, 1]) % lm.MEMBERS) if k == "c" else (2, 3) if k == "pos" else at
        e, old = 1e-5, p[k][at]
        p[k][at] = old + e
        up = lm.gradients(p, x, y)[0]
        p[k][at] = old - e
        down = lm.gradients(p, x, y)[0]
        p[k][at] = old
        assert abs((up - down) / (2 * e) - d[k][at]) < 1e-6
    net = lm.Net(p)
    a = net.log_probs(x, y)
    assert abs(-a.sum() / (y != lm.PAD).sum() - lm.gradients(p, x, y)[0]) < 1e-6
    later = x.copy()
    later[:, 6:] = (later[:, 6:] + 1) % lm.CLASSES
    later[0, 5:] = lm.PAD
    assert np.allclose(net.log_probs(later, y)[:, :6], a[:, :6])


@pytest.mark.parametrize("scale", [1, 30])
def test_batches_equal_plain_loops(scale):
    """Also with weights so large that exponents have to be kept in range."""
    rng = np.random.default_rng(2)
    p = random_weights(2)
    for k in ("g", "c"):
        p[k] *= scale
    n = np.array([5, lm.PLACES + 20, 1])
    given = rng.integers(0, lm.CLASSES, n.sum())
    who, x, y = lm.windows(given, n, lm.PLACES, lm.CONTEXT)
    got = lm.Net(p).log_probs(x, y)
    for w, i in zip(*np.nonzero(y != lm.PAD)):
        assert got[w, i] == pytest.approx(plain_log_prob(p, x[w, : i + 1], y[w, i]), abs=1e-8)


def test_probabilities_of_ids_sum_to_one():
    cls, within, mass = lm.classes_of(np.arange(5000)[::-1] ** 2 % 977)
    x = np.tile([[5, 7, 9, 1]], (lm.CLASSES, 1))
    y = np.full((lm.CLASSES, 4), lm.PAD)
    y[:, 3] = np.arange(lm.CLASSES)
    of_class = lm.Net(random_weights(3)).log_probs(x, y)[:, 3]
    assert abs(np.exp(of_class[cls] + within).sum() - 1) < 1e-6
    start = lm.Net({k: v * 0 if k not in "gc" else v for k, v in lm.initial(mass).items()})
    assert np.allclose(np.exp(start.log_probs(x, y)[:, 3]), mass / mass.sum(), rtol=0.6)


def test_places_of_context_give_no_answers(monkeypatch):
    """Windows behind a text's first: their context is looked at, but nothing is worked out for it."""
    n = np.array([lm.PLACES + 90, 3])
    given = np.random.default_rng(4).integers(0, lm.CLASSES, n.sum())
    who, x, y = lm.windows(given, n, lm.PLACES, lm.CONTEXT)
    net, attention, answered = lm.Net(random_weights(4)), lm.Net.attention, []

    def told(self, x, *skip):
        z, a, total = attention(self, x, *skip)
        answered.append(a.shape[0] * a.shape[1])
        return z, a, total

    monkeypatch.setattr(lm.Net, "attention", told)
    got = net.log_probs(x, y)
    first = np.r_[True, who[1:] != who[:-1]]
    assert sum(answered) == first.sum() * lm.PLACES + (~first).sum() * (lm.PLACES - lm.CONTEXT) < x.size
    assert ((got != 0) == (y != lm.PAD)).all()


def test_known_words_are_looked_up_once(piece_model):
    looks = []

    class Word(bytes):
        def __hash__(self):
            looks.append(self)
            return bytes.__hash__(self)

    words = lm.Words(lm.subwords(piece_model))
    first = words.add([b"one", b"two", b"one"])
    assert first.tolist() == [1, 2, 1] and words.n == 3
    again = words.add([Word(w) for w in (b"two", b"one", b"two")])
    assert again.tolist() == [2, 1, 2] and len(looks) == 3
    assert words.hash[1:3].tolist() == [lm.word_hash(w) for w in (b"one", b"two")]
    assert words.sequences(np.array([2, 0, 1]))[0].tolist() == [*words.sub.ids([b"two"])[0], words.sub.end, *words.sub.ids([b"one"])[0]]


def test_training_lowers_the_loss():
    rng = np.random.default_rng(2)
    y = np.cumsum(rng.integers(1, 3, (60 * lm.STEP, 8)), axis=1) % 20
    x = np.c_[np.full(len(y), lm.CLASSES), y[:, :-1]]
    start = lm.initial(np.bincount(y.ravel(), minlength=lm.CLASSES) + 0.1)
    before, after = (lm.gradients(p, x[:512], y[:512])[0] for p in (start, lm.trained(start, x, y, 8e-3, 1)))
    assert after < 0.5 * before


def test_all_training_texts_are_learnt_from(spark, piece_model, monkeypatch):
    import pyarrow as pa

    sub = lm.subwords(piece_model)
    texts = [" ".join(f"learn{k % 50}" for k in range(1800)), "held out", None]
    batch = pa.RecordBatch.from_pydict({"t": texts, "crc": [21, 20, 22], "doc_id": [1, 2, 3]})
    rows = [r for b in lm._gather(piece_model, 10)([batch]) for r in b.to_pylist()]
    ids = [np.frombuffer(r["ids"], sub.dtype).tolist() for r in rows if r["kind"] == 1]
    want = [i for w in texts[0].split() for i in sub.ids([w.encode()])[0]] + [sub.end]
    assert ids == [want, [sub.end]]
    counted = {r["key"]: r["c"] for r in rows if r["kind"] == 2}
    assert counted == Counter(want + [sub.end]) and [r["c"] for r in rows if r["kind"] == 3] == [2]
    _, _, y = lm.windows(np.array(want), np.array([len(want)]), lm.PLACES, 0)
    assert y[y != lm.PAD].tolist() == want


def test_texts_are_read_once(spark, edge, piece_model):
    from pyspark.sql import functions as F

    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def told(text):
        read.add(1)
        return text

    rows = edge.withColumn("text", told("text"))
    got = lm.lm_scores(rows, piece_model, told=5).collect()
    assert read.value == len(EDGE)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=str) == base_scores(EDGE)


def test_packed_words(piece_model):
    words = lm.Words(lm.subwords(piece_model))
    lm.texts_of(words, ["some words before"])
    for texts in (["a b a", None, "c"], [" ".join(f"w{k}" for k in range(70_000)), "w5 w69999"], [None]):
        numbers, n = lm.texts_of(words, texts)
        met = np.bincount(numbers, minlength=words.n)
        h, crc, size, places = lm.unpacked_slice(lm.packed_slice(words, numbers, met, n, np.arange(len(n)) + 2**32 - 5))
        assert size.tolist() == n.tolist() and crc.tolist() == [2**32 - 5 + k for k in range(len(n))]
        assert h[0] == 0 and (places == 0).tolist() == (numbers == 0).tolist() and h[places].tolist() == words.hash[numbers].tolist()


def test_scores_do_not_depend_on_partitions_and_repeat_those_of_whole_texts(spark, piece_model, monkeypatch):
    monkeypatch.setattr(lm, "GROUP_IDS", 20_000)
    d = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    kept = {}
    learnt = lm.learnt
    monkeypatch.setattr(lm, "learnt", lambda *a: kept.setdefault("p", learnt(*a)))
    got = {r.doc_id: r for r in lm.lm_scores(d, piece_model).collect()}
    first = kept.pop("p")
    other = {r.doc_id: r.score for r in lm.lm_scores(d.repartition(7), piece_model).collect()}
    assert all(np.array_equal(first[k], v) for k, v in kept["p"].items())
    assert all(abs(other[i] - r.score) < 1e-5 * abs(r.score) for i, r in got.items())
    # two whole texts by plain loops
    rows = [(r.doc_id, r.text) for r in d.collect()]
    sub, of_id = lm.subwords(piece_model), np.zeros(lm.subwords(piece_model).size)
    seq = {i: [x for w in lm.lowered(t) for x in sub.ids([w])[0]] + [sub.end] for i, t in rows}
    for i, s in seq.items():
        if not got[i].held_out:
            np.add.at(of_id, s, 1)
    cls, within, _ = lm.classes_of(of_id)
    p = {k: v.astype(np.float64) for k, v in first.items()}
    for i in [i for i, s in seq.items() if 40 < len(s) < 150][:2]:
        c, total, step = [lm.CLASSES, *cls[seq[i]].tolist()], 0.0, lm.PLACES - lm.CONTEXT
        for k in range(len(seq[i])):
            begin = 0 if k < lm.PLACES else (k - lm.CONTEXT) // step * step
            total += plain_log_prob(p, np.array(c[begin : k + 1]), c[k + 1]) + within[seq[i][k]]
        assert got[i].score == pytest.approx(total / math.log(10), rel=1e-4)


def test_attention_beats_the_base_on_texts_held_out(spark, piece_model):
    got = lm.lm_scores(spark.read.parquet(f"{DATA}/sf0.1/documents.parquet"), piece_model).filter("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got) + 0.1 * sum(r.n_tokens for r in got)
    assert np.mean([r.score > r.base_score for r in got]) > 0.55


# --- mixing


def brute_targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, cap=2.0):
    """Deals share times all sizes by weight; a target stops at cap times its size, the excess is dealt again among the others."""
    target, open_, left = [0.0] * len(sizes), {k for k, n in enumerate(sizes) if n}, share * sum(sizes)
    while open_ and left > 1e-9:
        total = sum(weights[k % len(weights)] for k in open_)
        above = {k for k in open_ if left * weights[k % len(weights)] / total > cap * sizes[k]}
        if not above:
            for k in open_:
                target[k] = left * weights[k % len(weights)] / total
            break
        for k in above:
            target[k] = cap * sizes[k]
            left -= target[k]
        open_ -= above
    return target


@pytest.mark.parametrize("seed", [None, 1, 2])
def test_targets_share_and_stop(spark, seed):
    rng = np.random.default_rng(seed)
    names = ["a", "b", "c", None] if seed is None else sorted({f"s{rng.integers(10**6)}" for _ in range(200)} | {"\uffee", "\U0001f600"}, key=lambda s: s.encode()) + [None]
    sizes = [100, 1000, 50, 10] if seed is None else [int(x) for x in rng.pareto(0.7, len(names)) * 10]
    df = spark.createDataFrame(list(zip(names, sizes)), "source string, n long").repartition(5)
    got = sorted(map(tuple, mixing.source_targets(df).collect()))
    assert [(k, s, n) for k, s, n, _ in got] == [(k, s, n) for k, (s, n) in enumerate(zip(names, sizes))]
    assert [t for *_, t in got] == pytest.approx(brute_targets(sizes))
    if seed is None:
        assert [t for *_, t in got] == pytest.approx([200, 1420, 100, 20])
    none = spark.createDataFrame([], "source string, n long")
    assert mixing.source_targets(none).count() == 0 and [r.target for r in mixing.source_targets(spark.createDataFrame([("a", 0)], "source string, n long")).collect()] == [0.0]


def test_flight_keeps_its_sums():
    rng = np.random.default_rng(5)
    p, s = rng.random(500), rng.integers(0, 900, 500).astype(float)
    q = mixing.flight(p, s, np.random.default_rng(1))
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert q.sum() == pytest.approx(p.sum(), abs=1e-6) and (q * s).sum() == pytest.approx((p * s).sum(), rel=1e-6)
    landed = mixing.flight(p, s, np.random.default_rng(1), land=True)
    assert set(landed) <= {0.0, 1.0} and abs((landed * s).sum() - (p * s).sum()) <= 2 * s.max()


def test_inclusion_probabilities_are_respected():
    p, s = np.array([0.2, 0.5, 0.8, 0.3, 0.7]), np.array([5.0, 1.0, 3.0, 2.0, 8.0])
    mean = np.mean([mixing.flight(p, s, np.random.default_rng(k), land=True) for k in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.035


@pytest.mark.parametrize("block", [50, 4000])
def test_mix_meets_targets(spark, block):
    rows = [(k, "w " * (k % 37), "abcd"[min(3, k % 9)] if k % 50 else None) for k in range(1200)]
    df = spark.createDataFrame(rows_of(*rows), SCHEMA)
    got = mixing.mix(df, block=block).collect()
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(7), block=block).collect()}
    assert {r.doc_id: r.taken for r in got} == again and len(got) == len(rows)
    assert all(r.size == k % 37 and 0 <= r.taken <= 2 * r.size for k, r in ((r.doc_id, r) for r in got))
    source = {k: s for k, _, s in rows}
    for s in set(source.values()):
        own = [r for r in got if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * 37 and own[0].source_size == sum(r.size for r in own)


def test_mixed_rows_are_taken_as_often_as_the_mix_says(spark, edge, empty):
    rows = [(k, "w " * (k % 37), "abcd"[min(3, k % 9)] if k % 50 else None) for k in range(600)] + [(None, "null id", "a"), (7, "same id", "b")] + [(900, "repeated row", "c")] * 9
    df = spark.createDataFrame(rows_of(*rows), SCHEMA)
    took = Counter()
    for r in mixing.mix(df, block=50).collect():
        took[r.doc_id, r.size] += r.copies
    got = mixing.mixed_rows(df.repartition(5), block=50)
    assert got.columns == df.columns
    assert Counter((r.doc_id, len((r.text or "").split())) for r in got.collect()) == +took
    again = mixing.mixed_rows(df.repartition(2), block=50).collect()
    assert Counter(again) == Counter(got.collect())
    clash = spark.createDataFrame([(1, "a b c", "s", 5, 6, 7, 8, 9)], "doc_id long, text string, source string, copies int, _copy int, _k1 int, _times int, key0 int")
    assert mixing.mixed_rows(clash).columns == clash.columns and mixing.mixed_rows(clash).count() <= 2
    assert mixing.mixed_rows(empty).count() == 0 and mixing.mixed_rows(edge).columns == edge.columns


def test_many_copies_of_one_row(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MADE", 7)
    df = spark.createDataFrame(rows_of(*[(1, "two words", "a")] * 40), SCHEMA)
    assert mixing.mixed_rows(df).count() == sum(r.copies for r in mixing.mix(df).collect()) == 60


def test_mix_edges(edge, empty):
    got = mixing.mix(edge).collect()
    assert len(got) == len(EDGE) and mixing.mix(empty).count() == 0
    assert sorted(r.size for r in got)[:4] == [0, 0, 0, 0]


# --- pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = str(DATA / "sf0.001")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == columns and {r.doc_id for r in docs.select("doc_id").collect()} <= before
        n.append(docs.count())
    assert n[1] < n[0] and n[2] < n[1] and n[3] > n[2]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert out.count() == n[3] and out.filter("not round_trip").count() == 0


def test_pipeline_links_copies_between_80_and_90_percent(spark):
    import corpus_pipeline

    base = [f"a{k}" for k in range(400)]
    edited = [f"e{k}" if k % 50 == 25 else w for k, w in enumerate(base)]
    texts = [base, base[:340], edited, base[:300]]  # similarity to the first, five words: 0.85, 0.82, 0.75

    def similarity(a, b, width):
        a, b = ({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} for w in (a, b))
        return len(a & b) / len(a | b)

    assert all(similarity(base, t, 5) >= 0.8 and similarity(base, t, 3) < 0.9 for t in texts[1:3]) and similarity(base, texts[3], 5) < 0.8
    alone = [f"b{k}" for k in range(90)]
    rows = rows_of(*((k, " ".join(t), "a") for k, t in enumerate([base, base[:340], edited, alone, [*alone[:60], *base[:20]]])))
    kept = corpus_pipeline.jaccard_join(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sorted(r.doc_id for r in kept) == [0, 3, 4]
    rows = rows_of((0, " ".join(base), "a"), (1, " ".join(texts[3]), "a"))
    assert corpus_pipeline.jaccard_join(spark, spark.createDataFrame(rows, SCHEMA), "").count() == 2


def test_registered_queries_run(spark):
    from querncore.llm import queries

    names = {q.split("_")[0] for q in queries.queries()}
    assert names == {f"op{k}" for k in range(1, 14)} | {"pipeline"}
