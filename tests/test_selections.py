"""Selections and captured instances: cases with stated results, among them empty tables and nulls."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from querncore.functions import capture
from querncore.operators import selection

LABELS = "entity int, k int, identity string, roles array<string>, usability_light string, usability_dark string"


def test_dates_with_a_precision(spark):
    rows = [("+2024-02-00T00:00:00Z", 10), ("+2023-00-00T00:00:00Z", 9), ("+2023-02-29T00:00:00Z", 11), ("+2023-02-28T00:00:00Z", 11), ("2023-02-28", 11), (None, 9), ("+2023-02-28T00:00:00Z", 8), ("+0000-02-28T00:00:00Z", 9)]
    got = spark.createDataFrame(rows, "t string, p int").select(capture.precision_interval(F.col("t"), F.col("p")).alias("x")).collect()
    assert [r.x and tuple(r.x) for r in got] == [(date(2024, 2, 1), date(2024, 2, 29)), (date(2023, 1, 1), date(2023, 12, 31)), None, (date(2023, 2, 28), date(2023, 2, 28)), None, None, None, None]


def test_outcomes_and_population(spark):
    people = spark.createDataFrame([(1,), (2,), (3,)], "entity int")
    cands = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "entity int, k int")
    labels = spark.createDataFrame([(1, 10, "correct", ["icon"], "good", "conditional"), (1, 11, "correct", ["icon"], "good", "good"), (2, 20, "wrong", None, None, None)], LABELS)
    picks = spark.createDataFrame([(1, "icon", 10), (1, "wide", 11), (2, "icon", 20), (2, "favicon", 21)], "entity int, role string, k int")
    rows = selection.outcomes(people, picks, labels, "entity", "k", ["icon", "wide", "favicon"])
    got = {(r.entity, r.role): r.outcome for r in rows.collect()}
    assert got == {(1, "icon"): "correct_role", (1, "wide"): "correct_brand_wrong_role", (1, "favicon"): "no_selection", (2, "icon"): "wrong", (2, "wide"): "no_selection", (2, "favicon"): "wrong", **{(3, r): "no_selection" for r in ("icon", "wide", "favicon")}}
    p = selection.population(people, cands, rows, labels, "entity", "k").first()
    assert (p.entities, p.with_candidates, p.with_any_positive, p.correct_domains, p.wrong_domains) == (3, 2, 1, 1, 1)
    assert [round(x, 9) for x in (p.candidate_set_coverage, p.top1_role_correctness, p.visual_usability, p.wrong_brand_safety)] == [5, 5, 2.5, 0]
    assert selection.availability(rows, "k").first().availability == 50.0
    none = selection.population(people.limit(0), cands.limit(0), rows.limit(0), labels.limit(0), "entity", "k").first()
    assert none.entities == 0 and none.total is None


def test_order_siblings_and_instances(spark):
    rows = spark.createDataFrame([(1, True, 9, 5.0, 9), (2, None, 0, 3.0, 1), (3, False, 0, 3.0, 2), (4, False, 1, None, 0)], "k int, padded_wordmark boolean, points int, score double, bytes int")
    for role, want in (("icon", [4, 3, 2, 1]), ("wide", [1, 4, 3, 2])):
        assert [r.k for r in rows.orderBy(*selection.role_order(role, F.col("points"), F.col("score"), "k")).collect()] == want
    both, wide = ["icon", "wide"], ["wide"]
    family = [(1, "f", "dark", "white", 100.0, 50.0, "opaque", "icon", both), (2, "f", "dark", "white", 201.0, 100.0, "transparent", "icon", both), (3, "f", "dark", "white", 210.0, 100.0, "transparent", "icon", both), (4, "f", "unknown", "white", 100.0, 50.0, "opaque", "icon", both)]
    family += [(0, "f", "dark", "white", 200.0, 100.0, "transparent", "wide", wide), (5, "f", "dark", "white", 100.0, 50.0, "opaque", "favicon", None)]  # one that may not be an icon; a role that none may take
    family = spark.createDataFrame(family, "k int, family string, theme string, color string, width double, height double, background string, role string, predicted_roles array<string>")
    assert sorted(tuple(r) for r in selection.transparent_siblings(family, family, ["family"], "k").collect()) == [(0, 2), (1, 2)]
    seen = spark.createDataFrame([(1, 1, "u", "h"), (2, 1, "v", "h"), (3, 1, None, None)], "instance int, entity int, url string, hash string")
    cands = spark.createDataFrame([(7, 1, "u", None), (8, 1, "w", "h"), (9, 1, "u", "h"), (5, 1, None, None)], "candidate int, entity int, url string, hash string")
    got = {r.instance: (r.candidate, r.confidence) for r in selection.mapped_instances(seen, cands, ["entity"], "candidate").collect()}
    assert got == {1: (7, "exact"), 2: (8, "derived"), 3: (None, "unmapped")}


def test_boxes_keys_and_forms(spark):
    one = spark.range(1)
    box = capture.clamped_box(F.lit(-5.0), F.lit(20.0), F.lit(300.0), F.lit(None).cast("double"), F.lit(100.0), F.lit(10.0))
    assert tuple(one.select(box.alias("b")).first().b) == (0.0, 10.0, 100.0, 0.0)
    zero = F.lit(0.5)
    key = capture.visual_key(F.lit(1), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("ab"), F.lit("nav"), [zero, zero, zero, zero])
    assert one.select(key.alias("k")).first().k == "1\0other\0svg:ab\0nav\x001\x001\x001\x001"
    got = one.select(capture.percent_decoded(F.lit("%")).alias("a"), capture.percent_decoded(F.lit("a+%41")).alias("b"), capture.data_url_bytes(F.lit("data:;base64,QQ==")).alias("c")).first()
    assert (got.a, got.b, bytes(got.c)) == (None, "a+A", b"A")


def test_events_that_may_leave(spark):
    rules = {"done": {"outcome": ["ok"]}, "begun": {}}
    rows = spark.createDataFrame([("done", {"outcome": "ok", "url": "secret"}), ("done", {"outcome": "secret"}), ("begun", {"outcome": "ok"}), ("other", {"outcome": "ok"})], "name string, fields map<string,string>")
    assert [r.x for r in rows.select(selection.allowed_event(F.col("name"), F.col("fields"), rules).alias("x")).collect()] == [{"outcome": "ok"}, {}, {}, None]
