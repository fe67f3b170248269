"""Fingerprints, Jaccard join, records, token counts, unigram encoding, licences: edge cases and brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tests.conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from querncore.llm import fingerprints, hashing, jaccard_join, licenses, records, token_counts, unigram
from tests.llm.conftest import EDGE, LONG, SCHEMA, rows_of, sample

TEXT = st.text(st.sampled_from("abcAB \n\té▁😀.,'"), max_size=60)


# --- hashing


@settings(deadline=None, max_examples=50)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_are_those_of_bytes_split(texts):
    for first, t in hashing.slices(pa.array(texts, pa.string()), fold=True, size=20):
        for k in range(len(t.offsets) - 1):
            want = (texts[first + k] or "").encode().split()
            got = [bytes(t.raw[a:b]) for a, b in zip(t.starts[t.bounds[k] : t.bounds[k + 1]], t.ends[t.bounds[k] : t.bounds[k + 1]])]
            assert got == want


def test_hashes_depend_on_bytes_alone_and_fold_ascii():
    _, t = next(hashing.slices(pa.array(["Ab é x", "x AB É é"]), fold=True))
    h = t.words().tolist()
    assert h[0] == h[4] and h[1] == h[6] and h[2] == h[3] and h[5] != h[6]


def thue_morse(n):
    """A word of 2**n letters, and the one with its letters exchanged: sums over powers modulo 2**64 cannot tell them apart."""
    word = "a"
    for _ in range(n):
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


@pytest.mark.parametrize("n", [3, 7, 10])
def test_hashes_tell_words_apart_that_sums_of_powers_do_not(n):
    _, t = next(hashing.slices(pa.array([" ".join(thue_morse(n)), "ab", "ba", "ab\0"]), fold=True))
    assert len(set(t.words().tolist())) == 5


def test_different_long_words_are_different_texts(spark):
    a, b = thue_morse(10)
    rows = [(k, " ".join([w, *"c d e f g h".split()]), "s") for k, w in enumerate((a, b))]
    df = spark.createDataFrame(rows_of(*rows), SCHEMA)
    assert [r.component_id for r in jaccard_join.jaccard_components(df).orderBy("doc_id").collect()] == [0, 1]
    assert len({r.fingerprint for r in fingerprints.fingerprints(df).collect()}) == 2


# --- fingerprints


def test_sketches_recover_every_difference():
    rng = np.random.default_rng(3)
    for n, d in ((0, 0), (5, 3), (400, 90), (3000, 2500)):
        common = rng.integers(1, 1 << 63, n, dtype=np.uint64)
        a, b = np.unique(np.r_[common, rng.integers(1, 1 << 63, d, dtype=np.uint64)]), np.unique(np.r_[common, rng.integers(1, 1 << 63, d // 2, dtype=np.uint64)])
        z = lambda x: (np.zeros(len(x), np.int64), x)
        assert [int(x[0]) for x in fingerprints.differences(z(a), z(b), 1)] == [len(np.setdiff1d(a, b)), len(np.setdiff1d(b, a))]


def test_likeness_comes_from_fingerprints_then_larger_sketches():
    rng = np.random.default_rng(5)
    common = [rng.integers(1, 1 << 63, n, dtype=np.uint64) for n in (0, 10, 2000, 2000, 70_000)]
    a, b = ([np.unique(np.r_[c, rng.integers(1, 1 << 63, k, dtype=np.uint64)]) for c, k in zip(common, ks)] for ks in ((0, 5, 3, 900, 4), (0, 2, 8, 700, 1)))
    column = lambda xs: (np.repeat(np.arange(len(xs)), [len(x) for x in xs]), np.concatenate(xs))
    first, second = (fingerprints.strings(*column(x), len(x)) for x in (a, b))
    want = [len(np.intersect1d(x, y)) / len(np.union1d(x, y)) if len(x) else 1.0 for x, y in zip(a, b)]
    alone = fingerprints.fingerprint_likeness(first, second)
    assert np.isnan(alone[3]) and alone[[0, 1, 2, 4]].tolist() == [want[k] for k in (0, 1, 2, 4)]
    assert fingerprints.likeness(first, second, column(a), column(b)).tolist() == want


def test_digests_that_cells_never_give_up_are_told_one_by_one():
    twice = np.array([7, 7, 9, 11], np.uint64)
    a, b = (np.zeros(4, np.int64), twice), (np.zeros(2, np.int64), np.array([9, 13], np.uint64))
    assert [x.tolist() for x in fingerprints.differences(a, b, 1, 12)] == [[3], [1]]


def test_columns_of_fingerprints_are_compared(spark):
    base = "".join(f"line {k}\n" for k in range(40))
    rows = [(1, base, "a"), (2, base.replace("line 7\n", "another line\n"), "a"), (3, None, "a")]
    df = fingerprints.fingerprints(spark.createDataFrame(rows_of(*rows), SCHEMA)).select("doc_id", "fingerprint")
    pairs = df.alias("a").join(df.alias("b"), F.expr("a.doc_id <= b.doc_id")).select("a.doc_id", F.col("b.doc_id").alias("other"), fingerprints.likeness_of("a.fingerprint", "b.fingerprint").alias("near"))
    got = {(r.doc_id, r.other): r.near for r in pairs.collect()}
    assert got[1, 1] == got[3, 3] == 1 and 0.8 < got[1, 2] < 1
    assert spark.range(1).select(fingerprints.likeness_of(F.lit(None).cast("string"), F.lit("")).alias("x")).first().x is None


def edited_texts(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        c = len(t) // 3
        out.append((i, len(t), hashlib.sha256((t[: len(t) - c] + nxt[:c]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("rows", [EDGE, EDGE[:1], [(k, f"text {k} " * (k % 5), "a") for k in range(97)]])
def test_fingerprints_edit_as_stated(spark, rows):
    df = spark.createDataFrame(rows_of(*rows), SCHEMA).repartition(5)
    got = fingerprints.fingerprints(df).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == edited_texts(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_fingerprint_likeness(spark):
    rows = [(i, t, s) for i, t, s in sample(150)]
    df = spark.createDataFrame(rows_of(*rows), SCHEMA)
    got = {r.doc_id: r for r in fingerprints.fingerprints(df).collect()}
    by = {}
    for i, t, _ in rows:
        by.setdefault(t, set()).add(got[i].fingerprint)
    assert all(len(x) == 1 for x in by.values()) and len(set().union(*by.values())) == len(by)
    order = sorted(rows, key=lambda r: -r[0])
    own = lambda t: set(zip(*map(np.ndarray.tolist, fingerprints.digests(next(hashing.slices(pa.array([t]), fold=False))[1]))))
    for k, (i, t, _) in enumerate(order):  # by the sets of digests
        following = order[(k + 1) % len(order)][1]
        for near, other in ((got[i].near_next, following), (got[i].near_edited, t[: len(t) - len(t) // 3] + following[: len(t) // 3])):
            x, y = own(t), own(other)
            assert near == len(x & y) / len(x | y)
    long = [r for r in got.values() if r.n_chars > 400]
    assert np.mean([0.3 < r.near_edited < 0.8 for r in long]) > 0.95 and np.mean([r.near_next for r in long]) < 0.1


def test_fingerprints_of_nothing(empty):
    assert fingerprints.fingerprints(empty).count() == 0


# --- Jaccard join


def brute_components(rows, percent=90, width=3):
    def words(t):
        return (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()

    sets = []
    for i, t, *_ in rows:
        w = words(t)
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            a, b = sets[x], sets[y]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(x)] = find(y)
    least = {}
    for x, (i, *_) in enumerate(rows):
        r = find(x)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(least[r], i)
    return sorted(((rows[x][0], len(sets[x]), least[find(x)] if sets[x] else rows[x][0]) for x in range(len(rows))), key=str)


def joined(spark, rows, **how):
    df = spark.createDataFrame(rows_of(*[(i, t, "s") for i, t, *_ in rows]), SCHEMA).repartition(3)
    return sorted((tuple(r) for r in jaccard_join.jaccard_components(df, **how).collect()), key=str)


def near_copies(seed, groups=6, copies=9):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    rows = []
    shared = [rng.choice(vocabulary) for _ in range(60)]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 30, 150]))] + (shared if rng.random() < 0.5 else [])
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((len(rows) + rng.randint(0, 1) * 1000, " ".join(w)))
    return rows


def test_components_equal_all_pairs(spark):
    rows = near_copies(1, 12, 9)
    assert joined(spark, rows) == brute_components(rows)


def test_components_at_the_border_and_edges(spark):
    ten = " ".join(f"w{k}" for k in range(12))  # ten shingles
    rows = [(1, ten), (2, ten + " x"), (3, "x " + ten + " y"), (4, ten.upper()), (5, "a b"), (6, "A  b"), (7, "b a"), *[(i, t) for i, t, _ in EDGE]]
    assert joined(spark, rows) == brute_components(rows)


def test_components_with_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "FREQUENT", 2)
    monkeypatch.setattr(jaccard_join, "TOLD", 50)
    rows = near_copies(5, 5, 7)
    assert joined(spark, rows, percent=80) == brute_components(rows, 80)


def test_components_with_long_lists(spark, monkeypatch):
    """Lists dealt over tasks, blocks of a few entries."""
    for name, value in (("FREQUENT", 2), ("HOT", 3), ("BLOCK", 4), ("INSIDE", 2)):
        monkeypatch.setattr(jaccard_join, name, value)
    rows = near_copies(8, 6, 12)
    assert joined(spark, rows, percent=80) == brute_components(rows, 80)


@pytest.mark.parametrize("percent,width", [(90, 1), (80, 2)])
def test_answers_derived_from_leaders(spark, percent, width):
    """Groups whose leaders are not linked, but some of whose other sets are: chains of copies, each a little further off."""
    rng = random.Random(percent)
    rows = []
    for g in range(9):
        base = [f"g{g}w{k}" for k in range(100)]
        for step in range(9):
            w = list(base)
            for k in range(step * 2):
                w[k * 3 % 100] = f"g{g}x{k}" if rng.random() < 0.9 else f"g{g}y{k}"
            rows.append((rng.randrange(10_000), " ".join(w)))
    assert joined(spark, rows, percent=percent, width=width) == brute_components(rows, percent, width)


def test_pairs_of_a_large_group_grow_with_its_sets(spark, monkeypatch):
    """Copies of one text, each with a few words of its own, some with so many that they are linked with no other: few pairs are compared."""
    asked, compared = [], jaccard_join.compared

    def counted(pairs, *rest):
        out = compared(pairs, *rest)
        asked.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "compared", counted)
    for copies in (60, 180):
        rng, rows = random.Random(3), []
        for k in range(copies):
            w = [f"w{j}" for j in range(300)]
            for j in rng.sample(range(300), rng.choice([2, 3, 4, 5, 12, 13])):
                w[j] = f"own{k}-{j}"
            rows.append((k, " ".join(w)))
        asked.clear()
        got = joined(spark, rows)
        assert got == brute_components(rows) and len({r[2] for r in got}) > copies // 10
        assert sum(asked) <= 10 * copies, asked


def test_components_of_nothing(empty, spark):
    assert jaccard_join.jaccard_components(empty).count() == 0


def hidden_link():
    """Texts a, b, c of 200 words that share their index lists in this order: a and b are neighbours and differ by 22 words, but by 20 bits;
    a and c, no neighbours, differ by 20 words and are linked."""

    def hashes(words):
        return next(jaccard_join.sets_of(pa.array([" ".join(words)]), 1))[1]

    def apart(x, y):
        return sum((p ^ q).bit_count() for p, q in zip(jaccard_join.bitmap(hashes(x)), jaccard_join.bitmap(hashes(y))))

    rng = random.Random(4)
    for t in range(100_000):
        if t % 500 == 0:
            words = sorted((f"h{t}-{k}" for k in range(1000)), key=lambda w: int(hashes([w])[0]))
            a, others = words[:200], words[200:]
        fresh = rng.sample(others, 21)
        b, c = a[:189] + fresh[:11], a[:179] + a[189:] + fresh[11:]
        ids = [jaccard_join.set_id(hashes(x)) for x in (a, b, c)]
        if ids == sorted(ids) and apart(a, b) == 20 and apart(a, c) == 20 and apart(b, c) > 20:
            return [(k, " ".join(x)) for k, x in enumerate((a, b, c))]


def test_link_behind_a_nearer_neighbour_is_found(spark):
    rows = hidden_link()
    want = brute_components(rows, 90, 1)
    assert [r[2] for r in want] == [0, 1, 0] and joined(spark, rows, percent=90, width=1) == want


def kept_sources(spark, *rows, percent=90, width=3, parts=3):
    df = spark.createDataFrame(rows_of(*rows), SCHEMA)
    kept = jaccard_join.keep_one(df.repartition(parts), percent, width)
    assert kept.columns == df.columns
    return sorted(r.source for r in kept.collect())


def brute_kept(rows, percent=90, width=3):
    """How many rows stay: one of each component, and all without words."""
    number = [(k, t, s) for k, (_, t, s) in enumerate(rows)]
    return len({c for k, n, c in brute_components(number, percent, width)})


def test_keep_one_keeps_one_of_each_group(spark):
    rows = [(i, t, str(k)) for k, (i, t, _) in enumerate(EDGE)] + [(5, EDGE[0][1], "a"), (30, LONG, "b")]
    kept = kept_sources(spark, *rows)
    # rows 0, 1, 2 and "a" are one group, "b" is a copy of row 10; rows without words (4, 5, 6, 7) all stay
    assert len(kept) == brute_kept(rows) == 11
    assert set(kept) - {"0", "1", "a"} == {"3", "4", "5", "6", "7", "8", "9", "10", "11", "12"}


def test_keep_one_with_repeated_and_null_ids(spark):
    text = lambda c: " ".join(f"{c}{k}" for k in range(50))
    rows = [(None, text("a"), "1"), (None, text("b"), "2"), (4, text("c"), "3"), (4, text("d"), "4"), (3, text("e"), "5"), (5, text("e"), "6"), (5, text("f"), "7"), (8, "", "8"), (8, None, "9"), (None, text("e"), "10"), (3, text("e"), "11")]
    kept = kept_sources(spark, *rows)
    assert len(kept) == brute_kept(rows) == 8 and set(kept) - {"5", "11"} == {"1", "2", "3", "4", "7", "8", "9"}
    assert kept == kept_sources(spark, *rows, parts=1)
    unrelated = [(i, text(c), c) for i, c in ((None, "p"), (None, "q"), (1, "r"), (1, "s"))]
    assert kept_sources(spark, *unrelated) == ["p", "q", "r", "s"]
    assert kept_sources(spark, (None, text("t"), "1"), (3, text("t"), "2"), (None, text("u"), "3")) == ["2", "3"]


def test_keep_one_of_rows_that_repeat_wholly(spark, empty):
    text = " ".join(f"w{k}" for k in range(50))
    assert kept_sources(spark, *[(7, text, "a")] * 5, (9, text, "b"), *[(8, None, "c")] * 2) == ["a", "c", "c"]
    assert jaccard_join.keep_one(empty).count() == 0


def test_keep_one_with_clashing_columns(spark):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(1, text, 5, 6, 7, 8, 9), (2, text, 5, 6, 7, 8, 9), (2, text, 5, 6, 7, 8, 9), (3, None, 5, 6, 7, 8, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _k1 long, _K2 int, _n int, key0 int, stays int")
    kept = jaccard_join.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


# --- records


def test_records_round_trip(spark, edge, word_bpe):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(word_bpe)
    want = [(i, [*tok.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, _ in EDGE]
    want.sort(key=lambda r: (r[0] is not None, r[0] or 0, np.array(r[1], "<u2").tobytes()))
    manifest = records.write_records(edge, word_bpe, end=1, shards=4)
    got = records.read_records(manifest).orderBy("start").collect()
    start = 0
    for (i, ids), r in zip(want, got, strict=True):
        raw = np.array(ids, "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (i, start, len(ids), zlib.crc32(raw), raw)
        start += len(ids)
    first = manifest.orderBy("shard").first()
    assert records.read_at(first.path, first.n_docs - 1)[0] == [r.doc_id for r in got][first.n_docs - 1]


def test_damaged_records_are_noticed(tmp_path):
    import io

    good = records.frame(records.payload_of(7, np.array([1, 2], "<u2")))
    assert records.parsed(records.read_frame(io.BytesIO(good)))[1].tolist() == [1, 2]
    for k in (0, 9, 15, len(good) - 1):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            records.read_frame(io.BytesIO(bytes(bad)))
    with pytest.raises(ValueError):
        records.read_frame(io.BytesIO(good[:-3]))


def test_records_of_nothing(empty, word_bpe):
    assert records.read_records(records.write_records(empty, word_bpe)).count() == 0


@settings(deadline=None, max_examples=200)
@given(st.text(st.characters(codec="utf-8"), max_size=40) | TEXT | st.text(st.sampled_from("abİſßé'sT½²ºµ×<|>endofx \x1c\x85\xa0"), max_size=30))
def test_words_encode_as_texts(text):
    import public_tokenizers

    e = records.encoder(public_tokenizers.path("word_bpe_49k.json"))
    assert e.encode([text], 1)[0].tolist() == [*e.tok.encode(text, add_special_tokens=False).ids, 1]


# --- token counts


@settings(deadline=None, max_examples=200)
@given(st.text(st.characters(codec="utf-8"), max_size=40) | TEXT)
def test_counts_equal_the_library(text):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    c = token_counts.counter(path)
    assert c.counts([text]) == [len(sp.encode(text))]
    assert sum(c.merged(w) for w in c.words(text)) == len(sp.encode(text))


def test_token_counts(edge, empty, piece_model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_model)
    got = sorted((tuple(r) for r in token_counts.token_counts(edge, piece_model).collect()), key=str)
    want = [(i, len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t, _ in EDGE]
    assert got == sorted(want, key=str)
    assert token_counts.token_counts(empty, piece_model).count() == 0


# --- unigram


def plain_best(m, word):
    """The best score by trying every cut."""
    scores = dict(zip([p for p, _ in m.pieces], m.score))
    best = [0.0] + [-1e18] * len(word)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - 20), j):
            p = word[i:j]
            s = scores.get(p, m.worst if j - i == 1 else None)
            if s is not None:
                best[j] = max(best[j], best[i] + s)
    return best[-1]


@settings(deadline=None, max_examples=100)
@given(st.text(st.sampled_from("theaionslyé▁\n日😀 "), max_size=30))
def test_viterbi_is_best_and_decodes(text):
    import public_tokenizers

    m = unigram.model(public_tokenizers.path("piece_bpe_32k.model"))
    ids = np.frombuffer(m.encode(text), "<u4")
    assert m.decode(ids) == text.replace("▁", " ")
    score = {i: s for i, s in zip(m.ids, m.score)}
    for w in m.pattern.findall("▁" + text.replace(" ", "▁")) if text else []:
        ids, total, k = m.segment(w), 0.0, 0
        while k < len(ids):
            if ids[k] in score:
                total, k = total + score[ids[k]], k + 1
            else:  # byte pieces of one character
                n = next(n for n in (1, 2, 3, 4) if _decodes(bytes(i - m.bytes_at for i in ids[k : k + n])))
                total, k = total + m.worst, k + n
        assert abs(total - plain_best(m, w)) < 1e-6


def _decodes(raw):
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def test_double_array_holds_its_keys_alone():
    keys = ["a", "ab", "abc", "b", "bcd", "é", "日本"]
    t = unigram.DoubleArray(keys)

    def find(key):
        s = 0
        for ch in key:
            c = t.codes.get(ch)
            if c is None:
                return None
            n = t.base[s] + c
            if n >= len(t.check) or t.check[n] != s:
                return None
            s = n
        e = t.base[s]
        return -1 - t.base[e] if e > 0 and t.check[e] == s and t.base[e] < 0 else None

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert [find(k) for k in ("c", "bc", "abcd", "日", "zz")] == [None] * 5


def test_encode_texts(edge, empty, piece_model):
    got = unigram.encode_texts(edge, piece_model).collect()
    assert len(got) == len(EDGE)
    assert Counter(r.round_trip for r in got) == Counter("▁" not in (t or "") for _, t, _ in EDGE)
    assert unigram.encode_texts(empty, piece_model).count() == 0


# --- licences


def test_licences_of_documents(spark):
    import duckdb

    rows = duckdb.sql(f"select doc_id, text, source from '{DATA}/sf0.01/documents.parquet'").fetchall()
    got = {r.doc_id: {f.family for f in r.found} for r in licenses.license_scan(spark.createDataFrame(rows_of(*rows), SCHEMA)).collect()}
    notes = {"mit": "Released under the MIT License.", "apache-2.0": "Licensed under the Apache License, Version 2.0.", "gpl-3.0": "GNU General Public License, version 3.", "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0."}
    for family, note in notes.items():
        want = {i for i, t, _ in rows if note in (t or "")}
        assert want and {i for i, f in got.items() if family in f} == want
    texts = {i: t or "" for i, t, _ in rows}
    assert all(f == ({"unknown"} if "All rights reserved." in texts[i] else set()) for i, f in got.items() if not any(n in texts[i] for n in notes.values()))


def families(spark, *texts):
    got = {r.doc_id: [(f.paragraph, f.family) for f in r.found] for r in licenses.license_scan(spark.createDataFrame(rows_of(*((k, t, "s") for k, t in enumerate(texts))), SCHEMA)).collect()}
    return [got[k] for k in range(len(texts))]


def test_licences_wrapped_over_lines(spark):
    gpl = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or"""
    bsd = """// Redistribution and use in source and binary forms, with or without\r
// modification, are permitted provided that the following conditions are\r
// met:"""
    got = families(spark, gpl, bsd, "one\ntwo\nReleased under the\nMIT License.", "Released under the\n\nMIT License.")
    assert got[:3] == [[(0, "gpl-3.0")], [(0, "bsd")], [(2, "mit")]] and got[3] != [(0, "mit")]


def test_licences_side_by_side(spark):
    got = families(
        spark,
        "Released under the MIT License. Licensed under CC BY 4.0.",
        "Licensed under the Apache License, Version 2.0 or the MIT License",
        "It comes under the Apache License, Version 2.0 or the MIT License at your option.",
        "Released under the BSD License.\nReleased under the ISC License. Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        " ".join(licenses.TEMPLATES["mit"][-2:]),
    )
    assert [[f for _, f in x] for x in got] == [["mit", "cc-by-4.0"], ["apache-2.0", "mit"], ["apache-2.0", "mit"], ["bsd", "isc", "cc-by-nc-4.0"], ["cc-by-nc-4.0"], ["mit"]]
    assert [p for p, _ in got[3]] == [0, 1, 1]


def test_licences_cut_damaged_and_unknown(spark, edge, empty):
    rows = [
        (1, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "s"),
        (2, "x y Licensed under the terms of the vendor agreement. z", "s"),
        (3, "We released under the bridge a public general.", "s"),
        (4, "one\ntwo\nReleased under the\nMIT License.", "s"),
        (5, "head\nLICENSED UNDER CC-BY 4.0 and more words here to go on", "s"),
    ]
    got = {r.doc_id: [(f.paragraph, f.family) for f in r.found] for r in licenses.license_scan(spark.createDataFrame(rows_of(*rows), SCHEMA)).collect()}
    assert got[1] == [(0, "mit")] and got[2] == [(0, "unknown")] and got[3] == [] and got[5] == [(1, "cc-by-4.0")]
    assert licenses.license_scan(edge).count() == len(EDGE) and licenses.license_scan(empty).count() == 0
