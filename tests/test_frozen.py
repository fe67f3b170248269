"""Frozen replays: digests, refusal, profiles, exclusions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from querncore.operators import frozen

ROWS = "entity string, role string, candidate string, score double, place int, predicted boolean, source string, favicon_rank double, home_linked boolean, dom_region string, positive_token boolean, agrees_with_company boolean, themes array<string>, width double, height double, url string, source_url string, generic_reason string"
NAMES = [x.split()[0] for x in ROWS.split(", ")]


def row(entity, role, candidate, score, place=0, **told):
    c = {"predicted": True, "source": "schema", "url": "https://a.test/x", "source_url": "https://www.a.test/"} | told | {"entity": entity, "role": role, "candidate": candidate, "score": score, "place": place}
    return tuple(c.get(n) for n in NAMES)


BACK = {"predicted": False, "positive_token": True, "dom_region": "nav", "width": 200.0, "height": 100.0, "generic_reason": "foreign named logo"}
TABLE = [
    row("a", "icon", "a1", 60.0, 1),
    row("a", "icon", "a2", 60.0, 0),
    row("a", "icon", "a3", 99.0, predicted=False),
    row("b", "icon", "b1", 60.0, source="apple"),
    row("b", "icon", "b2", 55.0),
    row("c", "icon", "c1", 60.0, source="apple", positive_token=True, dom_region="header"),
    row("c", "icon", "c2", 55.0),
    row("d", "favicon", "d1", 90.0, favicon_rank=1.0),
    row("d", "favicon", "d2", 50.0, favicon_rank=2.0),
    row("e", "wide", "e1", 80.0, themes=["light"]),
    row("e", "wide", "e2", 76.0, 1, themes=["dark", "light"]),
    row("e", "wide", "e3", 75.9, themes=["dark", "light"]),
    row("f", "wide", "f1", 90.0),
    row("f", "wide", "f2", 0.0, **BACK),
    row("g", "wide", "g2", 0.0, **BACK | {"source_url": "https://b.test/"}),
    row("h", "wide", "h2", 0.0, **BACK | {"generic_reason": "hero image"}),
    row(None, "icon", "n1", None),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(TABLE, ROWS).repartition(3)


def won(df):
    return {(r.entity, r.role): r.candidate for r in df.collect()}


def test_each_profile_changes_its_own_slots(rows):
    plain = won(frozen.winners(rows, []))
    assert plain == {("a", "icon"): "a2", ("b", "icon"): "b1", ("c", "icon"): "c1", ("d", "favicon"): "d1", ("e", "wide"): "e1", ("f", "wide"): "f1", (None, "icon"): "n1"}
    for profile, change in {"stored": {}, "favicon-tiny-v1": {("d", "favicon"): "d2"}, "icon-evidence-v1": {("b", "icon"): "b2"}, "wide-theme-v1": {("e", "wide"): "e2"}, "wide-header-recovery-v1": {("f", "wide"): "f2"}}.items():
        assert won(frozen.winners(rows, [profile])) == plain | change, profile
    with pytest.raises(ValueError, match="no such profiles"):
        frozen.winners(rows, ["icon-evidence-v9"])


def test_digest_of_a_table(spark, rows):
    d = frozen.table_digest(rows)
    assert d == frozen.table_digest(rows.repartition(7).select(*reversed(rows.columns)))
    for other in (rows.limit(16), rows.union(rows.limit(1)), rows.withColumn("place", F.col("place") + 0.0), rows.withColumn("score", F.when(F.col("candidate") == "e3", 75.8).otherwise(F.col("score"))), rows.withColumn("themes", F.when(F.col("candidate") == "e1", F.array(F.lit("dark"))).otherwise(F.col("themes"))), rows.withColumnRenamed("score", "points")):
        assert frozen.table_digest(other) != d
    assert frozen.table_digest(rows.limit(0)) == frozen.table_digest(rows.filter("false"))


def test_replay_of_the_frozen_rows_alone(spark, rows):
    before = frozen.winners(rows, []).select("entity", "role", "candidate").union(spark.createDataFrame([("z", "icon", "z1")], "entity string, role string, candidate string"))
    good = {"candidates": frozen.table_digest(rows), "selections": frozen.table_digest(before)}
    after, record = frozen.frozen_rerank(rows, ["favicon-tiny-v1", "wide-theme-v1"], before, good, 12)
    assert record["changed_selected_slots_by_role"] == {"favicon": 1, "wide": 1, "icon": 1} and record["changed_selected_slots"] == 3 and record["result_count"] == 7
    assert record["inputs"] == good and record["output"] == frozen.table_digest(after) and record["ranking_version"] == 12
    assert {tuple(r) for r in frozen.changes(before, after).collect()} == {("d", "favicon", "d1", "d2"), ("e", "wide", "e1", "e2"), ("z", "icon", "z1", None)}
    with pytest.raises(ValueError, match="not the frozen rows: candidates$"):
        frozen.frozen_rerank(rows.filter("candidate != 'a1'"), [], before, good, 12)
    with pytest.raises(ValueError, match="candidates, selections"):
        frozen.frozen_rerank(rows, [], before, {}, 12)


def test_veto_profiles(rows):
    profiles = {"strict": [("small", F.col("width") < 300), ("unplaced", F.col("dom_region") == "nav")], "none": []}
    kept, out = frozen.veto_profile(rows, profiles, "strict")
    assert kept.count() == len(TABLE) - 3 and {r.candidate: r.reasons for r in out.collect()} == dict.fromkeys(("f2", "g2", "h2"), ["small", "unplaced"])
    assert frozen.veto_profile(rows, profiles, "none")[0].count() == len(TABLE)
    with pytest.raises(ValueError, match="no such profile"):
        frozen.veto_profile(rows, profiles, "other")
