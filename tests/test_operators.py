"""Operators on inline rows: the cases that the catalogue's stand-ins cannot show."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from querncore.functions import ids, pages, scoring
from querncore.operators import budgets, dedupe, evaluation, joins, labels, quality, ranking, sampling

CANDIDATE = {
    "source": "string", "url": "string", "sizes": "string", "type": "string", "declared_width": "double", "declared_height": "double", "width": "int", "height": "int",
    "content_width": "int", "content_height": "int", "positive_token": "boolean", "home_linked": "boolean", "dom_region": "string", "negative_context": "boolean", "banner": "boolean",
    "theme": "string", "color": "string", "background": "string", "scalable": "boolean", "high_resolution": "boolean", "agrees_with_company": "boolean", "exact_company_label": "boolean", "generic_reason": "string",
    "clipping_risk": "double", "likely_clipped": "boolean", "stacked": "boolean", "explicit_symbol": "boolean", "wide_words": "boolean", "canvas_background": "string",
    "foreground_occupancy": "double", "box_occupancy": "double", "contrast_light": "double", "contrast_dark": "double", "suitability": "double", "identity_verified": "boolean",
    "eligible_roles": "array<string>", "wide_evidence": "boolean",
}


def candidates(spark, *rows):
    return spark.createDataFrame([tuple(r.get(k) for k in CANDIDATE) for r in rows], ", ".join(f"{k} {v}" for k, v in CANDIDATE.items()))


def one(df, col):
    return df.select(col.alias("x")).first().x


def test_declared_pixels_and_priority(spark):
    df = candidates(spark, {"source": "html-icon", "url": "https://a.example/i.png", "sizes": "16x16 32x32"})
    assert one(df, scoring.declared_pixels()) == 1024
    assert one(df, scoring.discovery_priority()) == 16 * 10 + 20
    svg = candidates(spark, {"source": "schema", "url": "https://a.example/i.svg", "home_linked": True, "dom_region": "nav", "positive_token": True})
    assert one(svg, scoring.discovery_priority()) == 300 + 90 + 80 + 55 + 40
    bad = candidates(spark, {"source": "social-banner", "url": "u", "banner": True})
    assert one(bad, scoring.discovery_priority()) == -300 - 200 - 300


@pytest.mark.parametrize(
    "row,queue",
    [
        ({"source": "dom-img", "url": "u"}, None),
        ({"source": "dom-img", "url": "u", "positive_token": True}, "icon"),
        ({"source": "dom-img", "url": "u", "home_linked": True, "declared_width": 200.0, "declared_height": 100.0}, "wide"),
        ({"source": "apple", "url": "u", "sizes": "180x180"}, "favicon"),
        ({"source": "schema", "url": "u"}, "wide"),
        ({"source": "social-banner", "url": "u"}, None),
    ],
)
def test_provisional_queue(spark, row, queue):
    assert one(candidates(spark, row), scoring.provisional_queue()) == queue


def scored(df):
    df = df.withColumn("role_scores", scoring.role_scores())
    return df.withColumn("predicted_roles", scoring.predicted_roles())


def test_scores_and_roles(spark):
    icon = {"source": "apple", "url": "https://a.example/touch.png", "width": 180, "height": 180, "high_resolution": True}
    wide = {"source": "schema", "url": "https://a.example/logo.svg", "width": 400, "height": 100, "scalable": True, "wide_evidence": True}
    vetoed = icon | {"generic_reason": "known generic asset"}
    got = scored(candidates(spark, icon, wide, vetoed)).select("role_scores", "predicted_roles").collect()
    assert got[0].role_scores.icon == 20 + 8 + 28 + 5 and got[0].predicted_roles == ["icon", "favicon"]
    assert got[1].role_scores.wide == 30 + 15 + 7 + 30 and got[1].predicted_roles == ["wide"]
    assert got[2].role_scores.icon == 0 and got[2].predicted_roles == []


def test_clipped_and_barely_wide_marks_are_not_chosen(spark):
    clipped = {"source": "schema", "url": "u/logo", "width": 400, "height": 100, "wide_evidence": True, "likely_clipped": True, "clipping_risk": 0.9}
    glyph = {"source": "schema", "url": "u/logo", "width": 200, "height": 100, "wide_evidence": True}
    named = glyph | {"wide_words": True}
    got = [r.predicted_roles for r in scored(candidates(spark, clipped, glyph, named)).collect()]
    assert got == [[], [], ["wide"]]


def test_icon_rejections_and_effective_score(spark):
    df = scored(candidates(spark, {"source": "html-icon", "url": "u", "width": 96, "height": 96, "canvas_background": "transparent", "foreground_occupancy": 0.01, "box_occupancy": 0.5, "contrast_light": 0.02, "contrast_dark": 0.5}))
    assert one(df, scoring.icon_rejections()) == ["negligible foreground occupancy"]
    assert one(df, scoring.icon_rejections("light")) == ["negligible foreground occupancy", "insufficient contrast on light surface"]
    assert one(df, scoring.icon_effective()) == one(df, F.col("role_scores.icon")) + 4


def test_variants_and_preferences(spark):
    df = candidates(spark, {"source": "schema", "url": "u", "contrast_light": 0.5, "contrast_dark": 0.1, "theme": "dark", "color": "any", "background": "opaque"})
    none = F.lit(None).cast("array<string>")
    assert one(df, scoring.variant_theme(F.lit("x"), none, F.lit("transparent"))) == "light"
    assert one(df, scoring.variant_theme(F.lit("logo-white.svg"), none, F.lit("opaque"))) == "dark"
    assert one(df, scoring.variant_theme(F.lit("x"), F.array(F.lit("dark"), F.lit("light")), F.lit("opaque"))) == "any"
    assert one(df, scoring.variant_color(F.lit("logo_black.svg"), F.lit(None).cast("string"))) == "black"
    assert one(df, scoring.preference_score({"theme": "dark", "color": "white", "background": "transparent"})) == 2 + 1 - 2


def test_company_agreement(spark):
    df = spark.createDataFrame([("Acme Widgets, Inc.", "acme widgets logo"), ("Acme", "acmeish"), ("Inc", "inc")], "c string, t string")
    assert [r.x for r in df.select(scoring.company_agreement(F.col("t"), F.col("c")).alias("x")).collect()] == [True, False, False]


def test_kappa_edges(spark):
    k = lambda a, b: evaluation.kappa(spark.createDataFrame(list(zip(a, b)), "a string, b string"), "a", "b").first()
    assert k("aabb", "abbb").kappa == 0.5
    assert (k("aaaa", "aaaa").status, k("aaaa", "aaaa").kappa) == ("single_category", None)
    assert k([None], ["a"]).status == "insufficient_data"
    assert k("abab", "abab").kappa == 1.0


def test_incomplete_labels_withhold_the_score(spark):
    rows = spark.createDataFrame([(True, True, 1.0, False), (False, None, 0.0, False)], "covered boolean, correct boolean, usability double, wrong boolean")
    assert evaluation.score_card(rows, F.lit(1.0)).first().value is None
    full = evaluation.score_card(rows.fillna({"correct": False}), F.lit(1.0)).first()
    assert full.complete and full.value == 15 + 15 + 10 + 10 + 10


def test_order_of_rows_does_not_matter(spark):
    rows = [(k % 3, "abc"[k % 3 - 1], float(k % 7), k) for k in range(60)]
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "e int, q string, v double, i int")
        got = sorted(map(tuple, ranking.capped_queues(df, ["e"], "q", {"a": 2, "b": 3, "c": 1}, 5, [F.desc("v"), F.asc("i")]).collect()))
        assert want in (None, got)
        want = got


def test_capped_queue_equals_a_plain_walk(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", "c", None]), rng.randint(0, 9), i) for i in range(80)]
    caps, chosen, later, counts = {"a": 6, "b": 8, "c": 4}, [], [], {}
    for q, v, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        if q and counts.get(q, 0) < caps[q] and len(chosen) < 16:
            counts[q] = counts.get(q, 0) + 1
            chosen.append(i)
        elif q:
            later.append(i)
    chosen += later[: 16 - len(chosen)]
    df = spark.createDataFrame([(0, *r) for r in rows], "e int, q string, v int, i int")
    got = ranking.capped_queues(df, ["e"], "q", caps, 16, [F.desc("v"), F.asc("i")]).orderBy("place").collect()
    assert [r.i for r in got] == chosen


def test_splits_are_exact_and_stable(spark):
    df = spark.range(0, 997).select(F.col("id").cast("string").alias("id"))
    a = {r.id: (r["at"], r.benchmark_split, r.capture_shard, r.qa_overlap) for r in sampling.assign_splits(df, "id", "s").collect()}
    b = {r.id: (r["at"], r.benchmark_split, r.capture_shard, r.qa_overlap) for r in sampling.assign_splits(df.repartition(7), "id", "s").collect()}
    assert a == b and sorted(v[0] for v in a.values()) == list(range(997))
    assert [sum(v[1] == s for v in a.values()) for s in ("development", "validation", "evaluation")] == [598, 199, 200]
    assert sum(v[3] for v in a.values()) == 199


def test_near_pairs_equal_all_pairs(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([3, 5, 8, 60, 64, 100, 112, 1000]) + rng.randint(0, 6), rng.randint(1, 40)) for i in range(120)]
    near = lambda x, y: abs(x - y) <= max(4, 0.12 * max(x, y))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and near(a[1], b[1]) and near(a[2], b[2])}
    df = spark.createDataFrame([(0, *r) for r in rows], "g int, i int, x int, y int")
    assert {(r.a, r.b) for r in joins.near_pairs(df, ["g"], "x", "y", "i").collect()} == want


def test_catalogue_refuses_an_unbounded_table(spark):
    with pytest.raises(ValueError):
        joins.catalog_match(spark.range(3).withColumnRenamed("id", "f"), "f", spark.range(10).withColumnRenamed("id", "c"), "c", "c", limit=5)


def test_adjudications_check_what_they_correct(spark):
    held = spark.createDataFrame([(1, "correct"), (2, "wrong")], "id int, v string")
    fixes = spark.createDataFrame([(1, "correct", "wrong"), (2, "correct", "ambiguous"), (3, "wrong", "correct")], "id int, original string, corrected string")
    fixed, conflicts = labels.apply_adjudications(held, fixes, "id", "v")
    assert sorted(map(tuple, fixed.collect())) == [(1, "wrong"), (2, "wrong")]
    assert sorted(map(tuple, conflicts.collect())) == [(2, "changed_since"), (3, "no_label")]


def test_first_event_window(spark):
    e = spark.createDataFrame([("a", k, float(s)) for k, s in enumerate([0, 1, 2, 9, 10, 11, 25])], "u string, i int, s double").withColumn("ts", F.timestamp_seconds("s"))
    got = budgets.first_event_limit(e, "u", "ts", "i", 10.0, 3).orderBy("i").collect()
    assert [r.allowed for r in got] == [True, True, True, False, True, True, True]
    assert [r.remaining for r in got] == [2, 1, 0, 0, 2, 1, 2]


def test_cache_replay_evicts_by_use_and_by_age(spark):
    rows = [(0, "a", 0.0, 6), (0, "b", 1.0, 4), (0, "a", 2.0, 6), (0, "c", 3.0, 4), (0, "a", 4.0, 6), (0, "b", 5.0, 4), (0, "a", 30.0, 6)]
    df = spark.createDataFrame(rows, "s int, k string, t double, n int")
    got = [r.hit for r in budgets.cache_replay(df, "s", "k", "t", "n", 20.0, 10).orderBy("t").collect()]
    assert got == [False, False, True, False, True, False, False]


def test_greedy_variants_and_sheets(spark):
    df = spark.createDataFrame([(0, "x", "s1", 1), (0, "x", "s2", 2), (0, "y", "s1", 3), (0, "y", "s2", 4)], "e int, a string, g string, o int")
    assert [r.o for r in dedupe.greedy_variants(df, ["e"], "a", "g", "o").orderBy("o").collect()] == [1, 4]
    rows = spark.createDataFrame([("b", e, o) for e, n in ((1, 10), (2, 10), (3, 10), (4, 30), (5, 1)) for o in range(n)], "batch string, e int, o int")
    got = dedupe.pack_sheets(rows, "batch", "e", "o").groupBy("sheet").agg(F.count("*").alias("n"), F.countDistinct("e").alias("k")).collect()
    assert sum(r.n for r in got) == 61 and all(r.n <= 24 and r.k <= 4 for r in got)


def test_families(spark):
    urls = ["https://a.example/l.png?w=10", "https://a.example/l.png?w=20&v=1", "https://a.example/l_64x64.png", "https://a.example/l@2x.png", "https://a.example/m.png#x"]
    df = spark.createDataFrame([(0, i, u) for i, u in enumerate(urls)], "e int, i int, u string")
    got = dedupe.families(df, ["e"], pages.family_url(F.col("u")), "i").orderBy("i").collect()
    assert [(r.family, r.representative) for r in got] == [(1, 0), (2, 1), (1, 0), (1, 0), (3, 4)]


def test_replay_and_upsert(spark):
    c = spark.createDataFrame([("h1", "u1", "r1"), ("h2", "u2", "r2"), ("h3", "s2", "r3"), ("h4", "u4", "s2")], "h string, u string, r string")
    seen = spark.createDataFrame([("h1", "s1"), ("h9", "s2")], "h string, u string")
    assert [r.h for r in joins.replay_novel(c, seen, "h", ["u", "r"]).collect()] == ["h2"]
    base, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, joins.upsert(base, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_quality_rules(spark):
    df = spark.createDataFrame([(1, "a", True), (1, "b", True), (2, None, False)], "k int, v string, f boolean")
    got = quality.violations(df, [quality.required("v_missing", "k", "v"), quality.unique("k_twice", "k"), quality.exactly_one("one_best", ["k"], F.col("f"))])
    assert sorted(map(tuple, got.collect())) == [("k_twice", "1"), ("one_best", "1"), ("one_best", "2"), ("v_missing", "2")]


def test_digest_is_stable(spark):
    df = spark.createDataFrame([([("a", 1), ("b", 2)],)], "r array<struct<k: string, v: int>>")
    assert one(df, ids.rows_digest(F.col("r"))) == one(df.repartition(3), ids.rows_digest(F.col("r")))
    assert one(df, ids.fnv1a32(F.lit(""))) == 2166136261 and one(df, ids.fnv1a32(F.lit("a"))) == 0xE40C292C
