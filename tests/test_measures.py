"""Pixel measures, clipping, the SVG policy, role metrics and stage gating on inline rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from querncore.functions import pixels, svg
from querncore.operators import replay


def image(fill=(255, 255, 255, 255), box=None, color=(0, 0, 0, 255)):
    px = np.zeros((32, 32, 4), np.uint8)
    px[:] = fill
    if box:
        top, left, bottom, right = box
        px[top:bottom, left:right] = color
    return px


def test_measures(spark):
    made = [image(box=(8, 8, 24, 24)), image((0, 0, 0, 0)), image((0, 0, 0, 0), (12, 0, 20, 32), (255, 255, 255, 255))]
    df = spark.createDataFrame([(k, bytearray(i.tobytes())) for k, i in enumerate(made)] + [(9, None), (10, bytearray(b"x"))], "k int, p binary")
    got = {r.k: r.m for r in df.select("k", pixels.measured("p").alias("m")).collect()}
    assert got[0].foreground_occupancy == 0.25 and got[0].box_occupancy == 0.25 and got[0].contrast == 1.0 and got[0].canvas_background == "opaque"
    assert got[0].score == pytest.approx(100 * (0.3 + 0.25 * 0.17 / 0.24 + 0.3 + 0.15), abs=0.06)
    assert got[1].score == 0 and got[1].box_aspect is None and got[1].canvas_background == "transparent"
    assert got[2].horizontal_contact and not got[2].vertical_contact and got[2].contrast_light == 0 and got[2].contrast_dark == 1 and got[2].box_aspect == 4
    assert got[0].hash == "00003c3c3c3c0000" and (got[0].red, got[0].green, got[0].blue) == (192, 192, 192)
    assert got[9].score is None and got[10].hash is None
    d = df.filter("k < 2").select(pixels.measured("p")["raster"].alias("r")).agg(F.collect_list("r").alias("r")).select(pixels.raster_distance(F.col("r")[0], F.col("r")[1]).alias("d"))
    assert d.first().d == pytest.approx(16 * 15 / 64)


def test_content_box():
    assert pixels.content_box(image(box=(8, 4, 24, 28))) == (24, 16)
    assert pixels.content_box(image()) is None


def test_clipping(spark):
    rows = [(100, 100, 4.0, True, False, True, "dom-img"), (100, 100, 4.0, True, False, False, "schema"), (400, 100, 1.0, True, True, True, "dom-img"), (64, 64, 1.3, True, False, True, "schema")]
    df = spark.createDataFrame(rows, "width int, height int, box_aspect double, horizontal_contact boolean, vertical_contact boolean, wordmark boolean, source string")
    assert [round(r.x, 2) for r in df.select(pixels.clipping_risk().alias("x")).collect()] == [1.0, 0.55, 0.0, 0.65]


@pytest.mark.parametrize(
    "markup,want",
    [
        ('<svg xmlns="http://www.w3.org/2000/svg"><path d="M0 0" style="fill:url(#a)"/></svg>', "safe"),
        ('<svg><image href="data:image/png;base64,AAAA"/></svg>', "safe"),
        ("<svg><style>.a{fill:red}</style></svg>", "safe"),
        ("<svg><script/></svg>", "element"),
        ('<svg onload="x()"/>', "handler"),
        ('<svg><use href="https://a.example/x#y"/></svg>', "reference"),
        ('<svg><path style="fill:url(https://a.example)"/></svg>', "style"),
        ("<svg><style>@import 'x';</style></svg>", "style"),
        ("<!DOCTYPE svg [<!ENTITY a 'b'>]><svg/>", "doctype"),
        ("<svg><g></svg>", "malformed"),
        ("<svg/><svg/>", "malformed"),
        ("<html/>", "root"),
        ("<svg xmlns='urn:x'/>", "namespace"),
        ("<svg>" + "<g>" * 300 + "</g>" * 300 + "</svg>", "depth"),
        ("", "empty"),
    ],
)
def test_svg_policy(markup, want):
    assert svg.verdict(markup.encode()) == want


@pytest.mark.parametrize(
    "markup,want",
    [
        ('<svg><g style="transform:translate3d(1px,0,0) rotateY(4deg);fill:none"/></svg>', "safe"),
        ('<svg><g style="position:fixed"/></svg>', "style"),
        ("<svg><style>.a{background:red}</style></svg>", "style"),
        ('<svg><g xmlns="http://www.w3.org/2000/svg"/></svg>', "namespace"),
        ('<svg viewBox="0 0 1 1" aria-label="x" data-a.b="y"/>', "safe"),
        ('<svg srcdoc="x"/>', "attribute"),
        ('<svg stop="x"/>', "attribute"),
    ],
)
def test_svg_allow_lists(spark, markup, want):
    assert svg.verdict(markup.encode(), {"viewbox", "style", "xmlns"}) == want
    df = spark.createDataFrame([(bytearray(markup.encode()),), (None,)], "c binary")
    assert [r.v for r in df.select(svg.svg_verdict_with({"viewbox", "style", "xmlns"})("c").alias("v")).collect()] == [want, "empty"]


def test_role_metrics(spark):
    e = spark.createDataFrame([("a",), ("b",), ("c",)], "entity string")
    c = spark.createDataFrame([("a", "1", "icon", True, True, "correct", True, False), ("a", "2", "icon", True, False, "correct", True, True), ("b", "3", "icon", False, False, "wrong", False, False)], "entity string, candidate string, role string, correct boolean, best boolean, identity string, any_theme boolean, both_themes boolean")
    s = spark.createDataFrame([("a", "icon", "2"), ("b", "icon", "3"), ("c", "icon", "9")], "entity string, role string, candidate string")
    got = {r.role: r for r in replay.role_metrics(e, c, s, ["icon", "wide"]).collect()}
    i = got["icon"]
    assert (i.selected, i.role_correct, i.wrong_identity, i.best_selected, i.usable_on_both_themes) == (3, 1, 1, 0, 1)
    assert i.role_precision == pytest.approx(1 / 3) and i.conditional_rank_recall == 1.0 and i.best_hit_rate == 0.0
    assert got["wide"].answer_rate == 0.0 and got["wide"].role_precision is None


def test_stages_and_displacement(spark):
    e = spark.range(6).withColumnRenamed("id", "k")
    got = {r.k: r.stage for r in replay.staged(e, [lambda d: d.filter("k % 2 = 0"), lambda d: d.filter("k < 4")], "k").collect()}
    assert got == {0: 1, 2: 1, 4: 1, 1: 2, 3: 2}
    control = spark.createDataFrame([("a", "icon", 1), ("b", "icon", 2)], "e string, r string, v int")
    treatment = spark.createDataFrame([("a", "icon", 1), ("a", "wide", 5), ("b", "icon", 3)], "e string, r string, v int")
    rows = sorted(map(tuple, replay.treatment_unless_displacing(control, treatment, ["e", "r"], "v").collect()))
    assert rows == [("a", "icon", 1, "treatment"), ("a", "wide", 5, "treatment"), ("b", "icon", 2, "control")]


def test_small_rules(spark):
    df = spark.createDataFrame([(["source:x +16", "home linked +12", "tiny edge -15", "odd"], None, 500, 90, 1000, False, 403, "x"), ([], "p", 200, 100, 1000, True, None, "getaddrinfo ENOTFOUND")], "r array<string>, crop_path string, box_width int, box_height int, viewport_width int, identity_evidence boolean, status int, m string")
    got = df.select(replay.reason_points(F.col("r")).alias("p"), replay.crop_gate().alias("g"), replay.failure_kind(F.col("status"), F.col("m")).alias("f")).collect()
    assert [r.p for r in got] == [13, 0] and [r.f for r in got] == ["blocked_interstitial", "dns"]
    assert got[0].g == ["missing-crop", "width-out-of-range", "missing-identity-evidence"] and got[1].g == []
    t = spark.createDataFrame([("A man in a red shirt with the logo on his back",), ("Acme logo",), (None,)], "t string")
    assert [r.x for r in t.select(replay.describes_embedded_logo(F.col("t")).alias("x")).collect()] == [True, False, False]


def test_svg_attributes_by_default():
    assert svg.verdict(b'<svg viewBox="0 0 1 1"><stop stop-color="red" rendering-intent="auto" color-profile="auto"/></svg>') == "safe"
    assert svg.verdict(b'<svg><stop color="red" stop="x"/></svg>') == "attribute"
