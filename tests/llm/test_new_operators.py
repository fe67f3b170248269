"""Centroid clustering, WARC archives, importance resampling; the queries that have SQL, against it."""

from __future__ import annotations

import gzip
import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from tests.conftest import DATA

from querncore.llm import centroids, queries, resampling, warc
from tests.llm.conftest import EDGE

SF = DATA / "sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, str(SF))
    cur = con.execute(queries.oracle_sql()[name])
    head = [d[0] for d in cur.description]
    assert sorted(head) == sorted(df.columns)
    assert sorted(repr(tuple(r)) for r in df.select(*head).collect()) == sorted(map(repr, cur.fetchall()))


# --- centroid clustering


def brute_clusters(rows, k, rounds, dims, scale=64, seed=1):
    """(id, cluster, distance) by all distances, and the final centroids."""
    ok = lambda v: v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if ok(v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cs = [v for _, v in first]
    for n in range(rounds + 1):
        got = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs)) for _, v in kept]
        if n < rounds:
            for j in range(len(cs)):
                own = [v for (_, v), (_, c) in zip(kept, got) if c == j]
                if own:
                    cs[j] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, c, d) for (i, _), (d, c) in zip(kept, got)], cs


def vectors(n, dims, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(i % 5, 0.7, dims)]) for i in range(n)]
    rows += [rows[3], rows[3], (rows[4][0], rows[5][1]), (None, rows[6][1])]  # repeated rows, an id with two vectors, no id
    rows += [(900 + i, [float(i % 2)] * dims) for i in range(40)]  # ties
    return rows + [(1000, None), (1001, []), (1002, [1.0] * (dims - 1)), (1003, [float("nan")] * dims), (1004, [None] + [1.0] * (dims - 1)), (1005, [float("inf")] * dims), (1006, [1e30] * dims)]


@pytest.mark.parametrize("n,dims,k,rounds", [(300, 4, 16, 3), (60, 2, 5, 0), (8, 3, 16, 2), (200, 1, 16, 3)])
def test_clusters_equal_all_distances(spark, n, dims, k, rounds):
    rows = vectors(n, dims, n)
    df = spark.createDataFrame([(i, v, 9, [1]) for i, v in rows], "vec_id long, embedding array<float>, cluster int, v array<int>").repartition(5)
    got = centroids.cluster(df, k=k, rounds=rounds, dims=dims).collect()
    want, cs = brute_clusters([r for r in rows if r[0] != 1006], k, rounds, dims)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got) == sorted((str(i), c, d) for i, c, d in want)
    inertia = Counter()
    for _, c, d in want:
        inertia[c] += d
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (inertia[r.cluster], sum(inertia.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, cs[r.cluster])).encode()).hexdigest()


def test_clusters_of_nothing(spark):
    for rows in ([], [(1, None)], [(None, [1.0] * 64)]):
        assert centroids.cluster(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).count() == 0


def test_sort_means_leaves_far_centroids_alone():
    rng = np.random.default_rng(0)
    c = rng.integers(-5000, 5000, (40, 8)).astype(np.int64)
    last = rng.integers(0, 40, 2000)
    x = c[last] + rng.integers(-300, 300, (2000, 8))
    which, distance, made = centroids.assign(x, last, c, *centroids.sorted_means(c))
    apart = ((x[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert (which == apart.argmin(axis=1)).all() and (distance == apart.min(axis=1)).all() and made < 2000 * 4


# --- importance resampling


def brute_resample(docs, target, n, buckets, least, percent, seed=2024):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
    feats = lambda w: [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    own = [(i, words(t)) for i, t in docs]
    s, t = Counter(b for _, w in own for b in feats(w)), Counter(b for x in target for b in feats(words(x)))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, w in own:
        f = feats(w)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = k + 1
    return sorted(repr(tuple(r[:5])) for r in out)


@pytest.mark.parametrize("n,places,least,percent", [(1, 4096, 20, 10), (1, 3, 2, 50), (2, 3, 2, 50), (3, 1, 1, 100), (3, 4096, 3, 40)])
def test_resampling_equals_plain_counts(spark, edge, n, places, least, percent):
    target = ["the quick brown fox", "Word1 and 1 ÉTÉ", None, ""]
    t = spark.createDataFrame([(k, x, "z") for k, x in enumerate(target)], "item_id long, text string, w string")
    got = resampling.resample(edge, t, n=n, buckets=101, least=least, percent=percent, places=places).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_resample([(i, x) for i, x, _ in EDGE], target, n, 101, least, percent)


def test_resampling_of_nothing(spark, edge, empty):
    t = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(empty, t).count() == 0
    got = resampling.resample(edge, t).collect()
    assert len(got) == len(EDGE) and sum(r.rank is not None for r in got) == 0  # a tenth of the two long ones


def test_a_long_text_is_many_chunks(spark):
    text = " ".join(f"w{k % 7}" for k in range(1000))
    df = spark.createDataFrame([(1, text), (2, "a")], "doc_id long, text string")
    c = resampling.chunks(df, 3, 50, places=64).collect()
    assert len(c) == 17 and sum(r.n_words for r in c) == 1001 and sum(len(r.buckets) for r in c) == 1000 + 999 + 998 + 1 and max(len(r.buckets) for r in c) <= 3 * 64


# --- WARC


PAGES = [
    (1, "http://a.example/1", "x" * 1500),
    (2, "http://a.example/2", "x" * 1500),
    (9, "http://a.example/9", "x" * 1500),
    (3, "http://a.example/3", "y" * 999),
    (4, "http://a.example/4", "y" * 999),
    (5, None, None),
    (6, "http://a.example/\r\nWARC-Type: resource", ""),
    (7, "http://é.example/", "é" * 500),
    (8, "http://é.example/", "é" * 500),
    (10, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40),
    (11, "u", "long " * 400_000),
    (12, "v", "\x00\r\n\r\n\r\n"),
    (None, "w", "x" * 1500),
    (None, "w", "z" * 2000),
    (None, "w", "z" * 2000),
    (13, "r", "r" * 3000),
    (13, "r", "r" * 3000),
]


def brute_records(rows):
    top = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            top[h] = max(i, top.get(h, i))
    out = []
    for i, _, h in rows:
        body = (h or "").encode()
        revisit = len(body) >= 1000 and h in top and i != top[h]
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", top[h] if revisit else None))
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def archives(spark, tmp_path_factory):
    df = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, payload string, n int").repartition(3)
    return df, [warc.write_warc(df, "file://" + str(tmp_path_factory.mktemp("w") / k), level=k, archive_bytes=most) for k, most in (("0", 3000), ("4", 500), ("9", 1 << 30))]


FIELDS = "record_type string, source_id long, payload_bytes long, payload_digest string, refers_to_source_id long"


@pytest.mark.parametrize("k", range(3))
def test_archives_read_back(spark, archives, k):
    _, paths = archives
    for range_bytes in (700, 1 << 25):
        r = warc.registered(spark).read.format("warc").schema(FIELDS).option("verify", "true").option("range_bytes", range_bytes).load(paths[k])
        got = r.filter("record_type IN ('response', 'revisit')").select("source_id", "payload_bytes", "payload_digest", "record_type", "refers_to_source_id").collect()
        assert sorted(repr(tuple(x)) for x in got) == brute_records(PAGES)
    whole = warc.read_warc(spark, paths[k], where="record_type = 'response'").collect()
    held = {(i, (h or "").encode()) for i, _, h in PAGES}
    assert {(r.source_id, bytes(r.payload)) for r in whole} <= held and all(r.payload_bytes == len(r.payload) for r in whole)
    ids = {r.record_id: r.source_id for r in whole}
    assert all(ids[r.refers_to] == r.refers_to_source_id for r in warc.read_warc(spark, paths[k]).filter("record_type = 'revisit'").collect())
    assert {r.target_uri for r in whole if r.source_id == 6} == {"http://a.example/%0D%0AWARC-Type: resource"} and {r.target_uri for r in whole if r.source_id == 5} == {None}


def test_predicates_reach_the_headers(spark, archives):
    path = archives[1][1]
    whole = warc.read_warc(spark, path)
    rows = whole.collect()
    for cond, test in [
        ("record_type = 'revisit'", lambda r: r.record_type == "revisit"),
        ("source_id > 8", lambda r: r.source_id is not None and r.source_id > 8),
        ("source_id IS NULL", lambda r: r.source_id is None),
        ("source_id NOT IN (1, 2)", lambda r: r.source_id is not None and r.source_id not in (1, 2)),
        ("source_id <=> 5", lambda r: r.source_id == 5),
        ("NOT (source_id = 5)", lambda r: r.source_id is not None and r.source_id != 5),
        ("target_uri LIKE 'http://a%' AND record_type IN ('response', 'warcinfo')", lambda r: (r.target_uri or "").startswith("http://a") and r.record_type != "revisit"),
        ("payload_bytes > 1000 AND record_type = 'response'", lambda r: r.record_type == "response" and r.payload_bytes > 1000),
        ("source_id = 1 OR source_id = 2", lambda r: r.source_id in (1, 2)),
    ]:
        key = lambda r: (r.record_type, r.record_id)
        want = sorted(map(key, filter(test, rows)))
        assert sorted(map(key, warc.read_warc(spark, path, where=cond).collect())) == want, cond
        assert sorted(map(key, whole.filter(cond).collect())) == want, cond
    assert whole.count() == len(rows)
    parts = [warc.read_warc(spark, path, where=f"record_type = '{k}'") for k in ("response", "revisit", "warcinfo")]
    assert parts[0].union(parts[1]).union(parts[2]).union(whole).count() == 2 * len(rows)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Filter " not in plan(warc.read_warc(spark, path, where="record_type = 'revisit' AND target_uri LIKE 'http://a%'"))
    assert "Filter " in plan(whole.filter("record_type = 'revisit'"))


def test_unwanted_payloads_stay_as_they_are(archives, spark):
    """Only the first bytes of a record are asked for until its block is."""
    data = warc.member(warc.record("response", 1, "u", "00" * 20, 5_000_000, np.random.default_rng(0).bytes(5_000_000), None, "d"), 4)
    asked = []

    def get(at, n):
        asked.append(n)
        return data[at : at + n]

    headers, body = warc.one_record(0, len(data), get, True)
    assert headers["source-id"] == "1" and sum(asked) <= warc.LOOK
    assert warc.declared(body(warc.LOOK)) == 5_000_000 and sum(asked) <= 3 * warc.LOOK
    _, body = warc.one_record(0, len(data), get, True)
    assert len(body(None).split(warc.END, 1)[1]) == 5_000_000


def test_archives_from_elsewhere(spark, tmp_path):
    """No index, no manifest: members of their own, one member for all, and plain text; a damaged payload is told."""
    records = [warc.record("response", k, f"http://x/{k}", hashlib.sha1(p).hexdigest(), len(p), p, None, "2020-01-01T00:00:00Z") for k, p in enumerate([b"", b"one", b"\r\n\r\n" * 5, bytes(range(256)) * 9000])]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, records)))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(b"".join(records)))
    (tmp_path / "c.warc").write_bytes(b"".join(records))
    for verify in (True, False):
        got = warc.read_warc(spark, str(tmp_path), FIELDS, verify=verify).collect()
        assert sorted((r.source_id, r.payload_bytes) for r in got) == sorted([(0, 0), (1, 3), (2, 20), (3, 256 * 9000)] * 3)
    one = warc.read_warc(spark, str(tmp_path / "c.warc"), "source_id long, payload binary").filter("source_id = 3").collect()
    assert [bytes(r.payload) for r in one] == [bytes(range(256)) * 9000]
    (tmp_path / "c.warc").write_bytes(b"".join(records).replace(b"one", b"two"))
    with pytest.raises(Exception, match="does not match its digest"):
        warc.read_warc(spark, str(tmp_path / "c.warc"), FIELDS, verify=True).collect()
    (tmp_path / "c.warc").write_bytes(b"".join(records)[:-5000])
    with pytest.raises(Exception, match="cut off"):
        warc.read_warc(spark, str(tmp_path / "c.warc"), FIELDS, verify=True).collect()


def test_unnamed_archives_are_not_read(spark, archives):
    """What a lost attempt has left is in no manifest."""
    df, paths = archives
    path = paths[2]
    before = warc.read_warc(spark, path, FIELDS).count()
    with open(path.removeprefix("file://") + "/left.warc.gz", "wb") as f:
        f.write(b"half an archive")
    assert warc.read_warc(spark, path, FIELDS).count() == before
    warc.write_warc(df.limit(0), path)
    assert warc.read_warc(spark, path, FIELDS).count() == before


def test_no_pages(spark):
    path = warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_warc(spark, path).filter("record_type != 'warcinfo'").count() == 0
