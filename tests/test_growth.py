"""What keeps a query's time in line with its rows: what is worked out once a row, compiled, and over how many tasks."""

from __future__ import annotations

import random
import unicodedata

import pytest
from pyspark.sql import functions as F
from tests.conftest import DATA

from querncore.functions.columns import settled
from querncore.functions.names import folded
from querncore.operators import dedupe, joins
from querncore.plans import candidates, icon_choice, qualification, reviews, selections  # noqa: F401  each deals features

SF = str(DATA / "sf0.001")


def plan_of(df) -> str:
    df.sparkSession.conf.set("spark.sql.debug.maxToStringFields", "10000")
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_near_pairs_are_those_of_brute_force_over_many_tasks(spark):
    rng = random.Random(7)
    rows = [(i, "ab"[i % 2], rng.choice([0.0, 3.5, 33.3, 33.4, 37.8, 38.0, 900.0, 1022.0, 1022.8, -5.0, -1.0]) + rng.choice([0, 0, 0.5, 4.0]), rng.uniform(-9, 90)) for i in range(300)] + [(300, "a", None, 1.0), (301, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double")
    near = lambda p, q: abs(p - q) <= max(4.0, 0.12 * max(p, q))
    whole = [r for r in rows if r[1] and r[2] is not None]
    want = {(p[0], q[0]) for p in whole for q in whole if p[0] < q[0] and p[1] == q[1] and near(p[2], q[2]) and near(p[3], q[3])}
    pairs = joins.near_pairs(df, ["g"], "x", "y", "id")
    got = [(r.a, r.b) for r in pairs.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert pairs.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism  # a small table's pairs are no single task's


def test_features_are_dealt_alike_and_without_decimals(spark):
    assert candidates.IN_SPARK
    numbers = spark.range(-400, 3000).selectExpr("CAST(floor(id / 10) AS BIGINT) AS l_orderkey", "CAST(pmod(id, 10) AS INT) AS l_linenumber")
    pairs = list(candidates.IN_SPARK.items())
    differ = numbers.selectExpr(*(f"count_if(NOT (({a}) <=> ({b}))) AS c{n}" for n, (a, b) in enumerate(pairs))).first()
    assert not any(differ)
    assert "decimal" not in plan_of(candidates.candidates(spark, SF)) and "decimal" not in plan_of(reviews.labels(spark, SF))


def test_settled_works_nothing_out_inside_the_generator(spark):
    df = settled(spark.range(3).selectExpr("id", "id * 2 AS b"))
    assert [tuple(r) for r in df.orderBy("id").collect()] == [(0, 0), (1, 2), (2, 4)]
    generated = [line for line in plan_of(df).splitlines() if "Generate" in line]
    assert generated and not any("struct" in line or "* 2" in line for line in generated)


def test_precision_intervals_are_worked_out_once_for_the_disposition(spark):
    plan = plan_of(selections.claim_dispositions(spark, SF))
    assert "Generate" in plan and "regexp_extract" not in plan and "gettimestamp" not in plan


def test_candidates_are_scored_once(spark):
    scores = lambda df: plan_of(df).count("logo|brand|wordmark")
    once = scores(candidates.scored(spark, SF))
    assert once and scores(selections.role_comparator(spark, SF)) == once and scores(selections.transparent_sibling(spark, SF)) == once


def test_repeats_of_a_number_go_before_scoring(spark):
    assert "first(source" not in plan_of(icon_choice.icon_pick(spark, SF))  # whole scored rows are not shuffled to find repeats
    k = F.expr(candidates.K).alias("k")
    want = spark.read.parquet(f"{SF}/lineitem.parquet").select(k).distinct()
    got = candidates.numbered(spark, SF).select(k)
    assert got.count() == want.count() and not got.exceptAll(want).count()


@pytest.mark.parametrize(("block", "long"), [(1, 1), (7, 1), (7, 60), (4096, 60), (7, 1 << 20)])
def test_evidence_is_numbered_alike_in_one_pass_and_by_blocks(spark, block, long):
    rng = random.Random(block + long)
    rows = [(rng.choice(["p", "p", "p", "q", None]), rng.randrange(200), "img", f"https://a/{min(rng.randrange(40), 9)}", None, None, f"e{n}") for n in range(400)]
    rows += [("p", 5, "img", "https://a/9", None, None, "e"), ("p", 5, "img", "https://a/9", None, None, "e")]
    want: dict = {}
    for entity, at, _, url, _, _, evidence in sorted(rows, key=lambda r: (r[1], r[6])):
        want.setdefault((entity, url), []).append((at, evidence))
    df = spark.createDataFrame(rows, "entity string, at long, kind string, url string, inline_svg string, css_background string, evidence string").repartition(3)
    got = dedupe.merge_rendered(df, ["entity"], "at", block, long)[1]
    assert sorted(repr(tuple(r)) for r in got.collect()) == sorted(repr((key[0], many[0][0], k, e)) for key, many in want.items() for k, (_, e) in enumerate(many))


def test_evidence_of_assets_that_are_not_long_is_shuffled_once_and_with_short_keys(spark):
    plan = qualification.rendered_evidence(spark, SF)._jdf.queryExecution().executedPlan().toString()
    once, _, rest = plan.partition("LeftAnti")  # the plan down to where assets of full bins go
    assert rest and once.count("Exchange hashpartitioning(_asset") == 1 and "unhex" in rest


def test_texts_go_to_python_only_where_they_are_not_ascii(spark):
    texts = [None, "", "plain ASCII", "Société", "ﬁne № ２", "é" * 3000] * 60  # several slices of a batch
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", folded(F.col("t")).alias("f"))
    want = {k: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not 0x300 <= ord(c) <= 0x36F) for k, t in enumerate(texts)}
    assert {r.k: r.f for r in df.coalesce(1).collect()} == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    evaluated = next(line for line in plan.splitlines() if "EvalPython" in line)
    assert "Pandas" not in evaluated and "RLIKE" in plan and "x00" in plan


def test_texts_of_labels_are_read_once_each_and_not_inside_lambdas(spark):
    plan = plan_of(reviews.quarantined_labels(spark, SF))
    assert 0 < plan.count("from_json") <= 4  # flags, best roles, roles, defects
