"""Sources, sinks and streams on inline data."""

from __future__ import annotations

import gzip
import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from querncore.sinks import runs
from querncore.sources import html, records

PAGE = """<html><head><base href="/x/"><title> Acme  Co </title><link rel="icon" href="i.ico" sizes="16x16"><link rel=apple-touch-icon href=/t.png>
<link rel="mask-icon" href="m.svg"><link rel="manifest" href="/m.json"><meta property="og:image" content="https://cdn.example.com/b.png">
<script type="application/ld+json">{"@graph":[{"@type":"Organization","logo":{"url":"/l.svg"}}]}</script><script type="application/ld+json">{bad</script></head>
<body><header><a href="/"><img class="site-logo" src="logo.png" data-src="lazy.png" srcset="a.png 1x, b.png 2x" alt="Acme"></a></header>
<div class="clients"><img src="/client-logo.png"></div><noscript><img src="/n.png"></noscript><picture><source srcset="p.webp"></picture>
<a href="/press-kit">Press kit</a><a href="/about">About</a><a href="javascript:void(0)">no</a><a href="/"><svg aria-label="Acme logo"><path/></svg></a></body></html>"""


def test_html_rows():
    rows = html.page_rows(PAGE, "https://acme.example.com/page")
    by = {(r["kind"], r["source"]): r["url"] for r in rows}
    assert by["candidate", "html-icon"] == "https://acme.example.com/x/i.ico"
    assert by["candidate", "apple"] == "https://acme.example.com/t.png"
    assert by["candidate", "schema"] == "https://acme.example.com/l.svg"
    assert by["candidate", "noscript-img"] == "https://acme.example.com/n.png"
    assert by["candidate", "dom-picture"] == "https://acme.example.com/x/p.webp"
    assert by["link", "brand-page"] == "https://acme.example.com/press-kit" and by["link", "high-intent"] == "https://acme.example.com/about"
    assert ("candidate", "inline-svg") in by and by["manifest", "manifest"].endswith("/m.json")
    logo = next(r for r in rows if r["url"].endswith("/x/logo.png"))
    assert logo["home_linked"] and logo["positive_token"] and logo["region"] == "header" and not logo["negative_context"]
    assert next(r for r in rows if r["url"].endswith("client-logo.png"))["negative_context"]
    assert {r["url"].rsplit("/", 1)[1] for r in rows if r["source"] == "dom-img"} >= {"logo.png", "lazy.png", "a.png", "b.png"}
    assert rows[-1]["alt"] == "Acme Co" and [r["place"] for r in rows] == list(range(len(rows)))


@pytest.mark.parametrize("bad", [None, "", "<", "<a href=", "<svg><a>", "<!-- x", "</p></div>"])
def test_html_never_fails(bad):
    html.page_rows(bad, "https://a.example.com/")


@pytest.mark.parametrize("v,want", [("null", None), ("//b.example.com/x", "https://b.example.com/x"), ("https://u:p@b.example.com/", None), ("http://localhost/x", None), ("data:image/png;base64,x", None), ("../y#z", "https://a.example.com/y")])
def test_resolved(v, want):
    assert html.resolved(v, "https://a.example.com/d/p") == want


def test_parse_pages_passes_nulls(spark):
    df = spark.createDataFrame([(1, "https://a.example.com/", None), (2, "https://a.example.com/", "<title>x</title>")], "page_id long, url string, html string")
    assert [(r.page_id, r.kind) for r in html.parse_pages(df).collect()] == [(2, "title")]


def test_zip_members(spark):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("logo/a.svg", "<svg/>" * 50)
        z.writestr("../evil.svg", "x")
        z.writestr(zipfile.ZipInfo("plain.png"), b"123")
    df = spark.createDataFrame([("p", bytearray(buf.getvalue())), ("q", bytearray(b"no zip")), ("r", None)], "path string, content binary")
    got = {r.name: r for r in records.read_zip_members(df).collect()}
    assert bytes(got["logo/a.svg"].bytes) == b"<svg/>" * 50 and bytes(got["plain.png"].bytes) == b"123"
    assert not got["../evil.svg"].safe and got["../evil.svg"].bytes is None


def test_image_headers():
    ico = struct.pack("<HHH", 0, 1, 2) + struct.pack("<BBBBHHII", 16, 16, 0, 0, 1, 32, 0, 0) + struct.pack("<BBBBHHII", 0, 0, 0, 0, 1, 8, 0, 0)
    cases = {b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 7, 9): ("png", 7, 9), b"GIF89a" + struct.pack("<HH", 3, 4): ("gif", 3, 4), ico: ("ico", 256, 256), b"\xff\xd8\xff\xe0\0\4xx\xff\xc0\0\x11\x08" + struct.pack(">HH", 5, 6): ("jpeg", 6, 5), b"<?xml?><svg>": ("svg", None, None), b"zz": (None, None, None)}
    for raw, want in cases.items():
        assert records.image_header(raw) == want


def test_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1}\n\n{"k": 2}\nnot json\n')
    got = records.read_json_lines_numbered(spark, str(tmp_path / "a.jsonl"), "k int").orderBy("line").collect()
    assert [(r.line, r.problem) for r in got] == [(1, None), (3, None), (4, "not JSON")]
    with pytest.raises(Exception):
        records.read_jsonl(spark, str(tmp_path / "a.jsonl"), "k int").collect()
    m = spark.createDataFrame([(1, '{"icons": [{"src": "a.png", "sizes": "any"}, {"src": ""}]}'), (2, "{bad")], "i int, t string")
    assert [(r.i, r.src, r.purpose) for r in records.manifest_icons(m, "t", ["i"]).collect()] == [(1, "a.png", "any")]
    s = spark.createDataFrame([(1, '{"icons": [{"url": "u", "width": 3, "height": 4, "format": "png"}, {"url": "v", "error": "x"}]}')], "i int, t string")
    assert [(r.url, r.sizes, r.type) for r in records.service_icons(s, "t", ["i"]).collect()] == [("u", "3x4", "image/png")]
    x = spark.createDataFrame([(1, '<urlset xmlns="http://x"><url><loc>https://a/1</loc><lastmod>2024-01-01</lastmod></url><url><loc>https://a/2</loc></url></urlset>'), (2, "<!DOCTYPE html>")], "i int, t string")
    assert [(r.kind, r["loc"]) for r in records.sitemap_entries(x, "t", ["i"]).collect()] == [("urlset", "https://a/1"), ("urlset", "https://a/2")]
    b = spark.createDataFrame([(bytearray(gzip.compress(b"<urlset/>")),), (bytearray(b"<html>"),), (None,)], "c binary")
    assert [r.t for r in b.select(records.sitemap_text("c").alias("t")).collect()] == ["<urlset/>", None, None]
    txt = spark.createDataFrame([("a", "v=BIMI1; l=x"), ("a", "other"), ("b", "v=BIMI1"), ("b", "v=bimi1"), ("c", "z")], "d string, r string")
    assert sorted((r.d, r.status) for r in records.assertion_status(txt, ["d"], "r").collect()) == [("a", "found"), ("b", "ambiguous"), ("c", "not_found")]
    h = spark.createDataFrame([("10.0.0.1",), ("8.8.8.8",), ("::1",), ("::ffff:192.168.1.1",), ("a.example.com",), (None,)], "h string")
    assert [r.x for r in h.select(records.private_address(F.col("h")).alias("x")).collect()] == [True, False, True, True, False, False]


def test_run_folder_and_asset_store(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "quoted", text')], "k int, v string")
    runs.write_run(rows, rows, rows, str(tmp_path / "run"))
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "run/failures")).first().v == 'a "quoted", text'
    a = spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"x"),), (bytearray(b"y"),)], "bytes binary")
    runs.store_assets(a, str(tmp_path / "store"))
    runs.store_assets(a.unionByName(spark.createDataFrame([(bytearray(b"z"),)], "bytes binary")), str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 3
    with pytest.raises(ValueError):
        runs.merge_by_key(rows, rows.unionByName(rows), "k", str(tmp_path / "m"))
    assert "| 1 |" in runs.markdown(rows, "t")


def test_streams_equal_batch(spark, tmp_path):
    from querncore.operators import budgets
    from querncore.streaming import limits

    e = spark.createDataFrame([("ab"[k % 2], k, 1e9 + k * 7 % 40) for k in range(40)], "u string, i int, s double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    e.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = limits.first_event_limit(stream, "u", "ts", "i", 10.0, 3).writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.u, r.i, r.allowed) for r in spark.table("limited").collect())
    want = sorted((r.u, r.i, r.allowed) for r in budgets.first_event_limit(e, "u", "ts", "i", 10.0, 3).collect())
    assert got == want
    q = limits.windowed_metrics(stream, "ts", ["u"], "i", "10 seconds").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.n for r in spark.table("windows").collect()) == 40


def test_observations_of_rendered_pages(spark, tmp_path):
    import json

    from querncore.operators import dedupe

    pages = [
        {"url": "https://a.test/", "domain": "a.test", "company": "A", "candidates": [{"kind": "external", "url": "https://a.test/x.png", "evidence": {"alt": "one", "cssBackground": {"size": "1px"}}}, {"kind": "external", "url": "https://a.test/x.png", "evidence": {"alt": "two", "cssBackground": {"size": "1px"}}}, None, {"kind": "external", "url": "https://a.test/x.png", "evidence": {"alt": "three"}}, {"kind": "inline-svg", "inlineSvg": "<svg/>", "evidence": {}}, {"kind": "external", "url": "data:x"}]},
        {"url": "https://b.test/", "candidates": []},
        {"url": "https://c.test/"},
    ]
    (tmp_path / "o.jsonl").write_text("\n".join(map(json.dumps, pages)))
    rows = records.read_observations(spark, str(tmp_path))
    assert [r.at for r in rows.orderBy("at").collect()] == [0, 1, 3, 4, 5]
    survivors, evidence = dedupe.merge_rendered(rows, ["page"], "at")
    assert [(r.at, r.inline_svg) for r in survivors.orderBy("at").collect()] == [(0, None), (3, None), (4, "<svg/>")]
    assert [(r.at, r.place, json.loads(r.evidence).get("alt")) for r in evidence.orderBy("at", "place").collect()] == [(0, 0, "one"), (0, 1, "two"), (3, 0, "three"), (4, 0, None)]
