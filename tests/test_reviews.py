"""Labels in one form or in quarantine, runs put together, canonical texts, exact percentiles: edges and plain versions."""

from __future__ import annotations

import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from querncore.functions.canonical import canonical
from querncore.operators import label_forms, merging
from querncore.operators.percentiles import exact_percentiles

# --- labels

LABEL = "n int, label_kind string, entity_id string, candidate_id string, visual_instance_id string, role string, reviewer_id string, review_pass string, run_key string, capture_key string, safe boolean, told map<string,string>"
NO_BEST = {"icon": False}


def label(kind="candidate", told=None, entity="e1", candidate="c1", visual=None, role=None, safe=False):
    return (kind, entity, candidate, visual, role, None, None, None, None, safe, told)


#: A label, its fault, and what of its form is told.
LABELS = [
    (label(told=None), None, {"roles": [], "best_for_role": []}),
    (label(told={}), None, {}),
    (label("sheet"), "invalid_label_kind", {}),
    (label(None), "invalid_label_kind", {}),
    (label(entity=""), "entity_id_required", {}),
    (label(entity=None), "entity_id_required", {}),
    (label(told={"identity": "correct", "identity-correctness": "correct"}), "duplicate_key", {}),
    (label("missing_role", {"cause": "not_missing", "missing-cause": "not_missing"}, candidate=None, role="icon"), "duplicate_key", {}),
    (label(told={"identity-correctness": "wrong"}), None, {"identity": "wrong"}),
    (label(told={"brand_mark_decision": "Unclear"}), None, {"identity": "ambiguous"}),
    (label(told={"brand_mark_decision": "perhaps"}), "invalid_brand_mark_decision", {}),
    (label(told={"brand_mark_decision": "yes", "identity": "correct"}), "duplicate_identity", {}),
    (label(told={"identity": "right"}), "invalid_identity", {}),
    (label(told={"identity": ""}), "invalid_identity", {}),
    (label(told={"identity": None}), None, {"identity": None}),
    (label(told={"roles": '["wide","icon","wide"]'}), None, {"roles": ["icon", "wide"], "best_for_role": []}),
    (label(told={"applicable-roles": "favicon"}), None, {"roles": ["favicon"]}),
    (label(told={"roles": '["logo"]'}), "invalid_roles", {}),
    (label(told={"best-role": "wide"}), None, {"roles": ["wide"], "best_for_role": ["wide"]}),
    (label(told={"best_for_role": '{"wide":true,"icon":"true","other":false}', "roles": "[]"}), None, {"roles": [], "best_for_role": ["icon", "wide"]}),
    (label(told={"best_for_role": '{"wide":1}'}), "invalid_best_for_role", {}),
    (label(told={"best_for_role": '{"logo":true}'}), "invalid_best_for_role", {}),
    (label(told={"usability-dark": "good", "usability_light": "bad"}), "invalid_usability_light", {}),
    (label(told={"first_party": "yes"}), "unknown_key", {}),
    (label(told={"some-thing": "x"}), "unknown_key", {}),
    (label(told={"display_name": "x", "instance_box": "[]"}), None, {}),
    (label(told={"quality_defects": "none"}), None, {"quality_defects": []}),
    (label(told={"quality-defects": '["blurry"]'}), None, {"quality_defects": ["blurry"]}),
    (label(candidate=None), "candidate_id_required", {}),
    (label("visual_instance", {"visual-role": "Social-Card", "region": "browser-chrome", "first-party": "no"}, candidate=None, visual="v1"), None, {"visual_role": "social_card", "region": "browser_chrome", "role": "social_card"}),
    (label("visual_instance", {"visual_role": "logo"}, visual="v1"), "invalid_visual_role", {}),
    (label("visual_instance", {}), "visual_instance_id_required", {}),
    (label("visual_instance", {}, visual="v1", role="wide"), "invalid_role", {}),
    (label("missing_role", {"cause": "removed-by-dedupe"}, candidate=None, role="wide"), None, {"missing_cause": "removed_by_url_or_byte_dedupe"}),
    (label("missing_role", {"missing": "false"}, candidate=None, role="wide"), None, {"missing_cause": "not_missing"}),
    (label("missing_role", {}, candidate=None), "role_required", {}),
    (label("missing_role", {"role": "wide"}, candidate=None), None, {"role": "wide"}),
    (label("entity", {"identity_status": "current"}), "target_not_allowed", {}),
    (label("entity", {"identity-status": "current", "graphic_logo_present": "true"}, candidate=None), None, {"identity_status": "current"}),
    (label("entity", {"graphic_logo_present": "perhaps"}, candidate=None), "invalid_graphic_logo_present", {}),
    (label("entity", {"roles": "icon"}, candidate=None), "unknown_key", {}),
    (label("review_attestation", {"visual_evidence_reviewed": "true", "review_workflow": "positive_first", "visual_instance_count": "3"}, candidate=None), None, {"visual_instance_count": "3"}),
    (label("review_attestation", {"visual_evidence_reviewed": "false", "review_workflow": "positive_first", "visual_instance_count": "3"}, candidate=None), "attestation_incomplete", {}),
    (label("review_attestation", {"visual_evidence_reviewed": "true", "review_workflow": "positive_first", "visual_instance_count": "2.5"}, candidate=None), "invalid_visual_instance_count", {}),
    (label(told={"identity": "wrong", "roles": "icon", "usability_light": "good"}, safe=True), None, {"roles": [], "usability_light": "unusable", "usability_dark": "unusable", "best_for_role": []}),
    (label(told={"identity": "wrong", "roles": "icon", "usability_light": "good"}), None, {"roles": ["icon"], "usability_light": "good"}),
    (label(told={"identity": "ambiguous", "best_role": "icon"}, safe=True), None, {"roles": ["icon"], "best_for_role": []}),
    (label(told={"identity": "correct", "roles": "wide", "best_for_role": '["icon"]', "usability_light": "good"}, safe=True), "best_role_not_eligible", {}),
    (label(told={"identity": "correct", "roles": "icon", "best_for_role": '["icon"]', "usability_light": "unusable"}, safe=True), "best_role_not_eligible", {}),
    (label(told={"identity": "correct", "roles": "icon", "best_for_role": '["icon"]', "usability_dark": "conditional"}, safe=True), None, {"best_for_role": ["icon"]}),
    (label(told={"quality_defects": '["Preview unavailable"]'}, safe=True), "evidence_limit_defect", {}),
]


@pytest.fixture(scope="module")
def judged(spark):
    df = spark.createDataFrame([(k, *row) for k, (row, _, _) in enumerate(LABELS)], LABEL).withColumn("fault", F.lit("an old one"))
    return df, {r.n: r for r in label_forms.judged(df, F.col("safe")).collect()}


@pytest.mark.parametrize("k", range(len(LABELS)))
def test_label(judged, k):
    got, (row, fault, form) = judged[1][k], LABELS[k]
    assert got.fault == fault, row
    for name, want in form.items():
        assert (got[name] if name in ("roles", "best_for_role", "quality_defects", "role") else got.said[name]) == want, (name, row)


def test_every_label_leaves_by_one_of_two_ways(judged):
    kept, out = label_forms.parted(judged[0].drop("fault"), F.col("safe"))
    a, b = [r.n for r in kept.collect()], [r.n for r in out.collect()]
    assert sorted(a + b) == list(range(len(LABELS))) and b == [k for k, (_, f, _) in enumerate(LABELS) if f]
    assert out.columns == [*judged[0].drop("fault").columns, "fault"]


def test_ids_of_labels(judged):
    def fnv(text):
        h = 2166136261
        for c in text:
            h = (h ^ ord(c)) * 16777619 % 2**32
        return f"{h:08x}"

    got = judged[1][0]
    assert got.target_key == "target-" + fnv("\0".join(["target", "candidate", "e1", "", "c1", ""]))
    assert got.label_id == "label-" + fnv("\0".join(["label", "visual-review-packet-v2", "run", "capture", "default", "unassigned", got.target_key]))


# --- runs


def brute_merge(records, owners):
    runs = {}
    for run, e in owners:
        if e is not None:
            runs.setdefault(e, set()).add(run)
    n = Counter((t, k) for _, t, _, k in records)
    out = []
    for run, t, e, k in records:
        fault = "overlapping_ownership" if e is not None and len(runs.get(e, ())) > 1 else "outside_owned" if e is not None and runs.get(e) != {run} else "duplicate_key" if n[t, k] > 1 else None
        out.append((run, t, e, k, fault))
    return sorted(map(repr, out))


def test_merge_equals_plain_rules(spark):
    rng = random.Random(3)
    owners = [(e % 3, e) for e in range(30) if e % 7] + [(1, 3), (2, 3), (0, None), (1, 1)]
    records = [(rng.choice([e % 3, e % 3, 1]), rng.choice("ab"), e, k) for k in range(200) for e in [k % 31]] + [(0, "a", None, 900), (1, "a", None, 900), (2, None, 1, None), (None, "a", 1, 5)]
    r = spark.createDataFrame(records, "run int, record_type string, entity int, key int")
    o = spark.createDataFrame(owners, "run int, entity int")
    got = merging.judged(r, o).collect()
    assert sorted(repr((x.run, x.record_type, x.entity, x.key, x._fault)) for x in got) == brute_merge(records, owners)
    kept, counts = merging.merged(r, o).count(), merging.per_type(r, o).collect()
    assert sum(sum((c.merged, c.overlapping, c.outside, c.duplicate)) for c in counts) == len(records) and sum(c.merged for c in counts) == kept
    told = merging.conflicts(r, o).collect()
    assert {(c.entity, tuple(c.runs)) for c in told if c.kind == "overlapping_ownership"} == {("3", ("0", "1", "2"))}
    assert merging.merged(r.limit(0), o).count() == 0 and merging.merged(r.filter("entity IS NOT NULL"), o.limit(0)).count() == 0


# --- canonical texts


def stable(v):
    if isinstance(v, list):
        return "[" + ",".join(sorted(map(stable, v))) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{stable(v[k])}" for k in sorted(v)) + "}"
    return json.dumps(v, ensure_ascii=False)


def test_canonical_texts(spark):
    kind = T._parse_datatype_string("struct<b:array<struct<z:int,a:string>>,a:map<string,array<int>>,c:double,d:boolean,e:array<array<string>>>")
    rows = [
        {"b": [{"z": 1, "a": 'q"\n\\é'}, {"z": None, "a": "x"}], "a": {"k": [3, 1, 2], "j": None}, "c": 1.5, "d": True, "e": [["b", "a"], []]},
        {"b": [{"z": None, "a": "x"}, {"z": 1, "a": 'q"\n\\é'}], "a": {"j": None, "k": [2, 3, 1]}, "c": 1.5, "d": True, "e": [[], ["a", "b"]]},
        {"b": [], "a": {}, "c": None, "d": False, "e": None},
        {"b": None, "a": None, "c": None, "d": None, "e": [None]},
    ]
    df = spark.createDataFrame([(k, r) for k, r in enumerate([*rows, None])], T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", kind)]))
    got = [r.t for r in df.select("k", canonical(F.col("v"), kind).alias("t")).orderBy("k").collect()]
    assert got[0] == got[1] and got[4] == "null" and [got[k] for k in (0, 2, 3)] == [stable(rows[k]) for k in (0, 2, 3)]


# --- percentiles


@pytest.mark.parametrize("ranges", [None, 1, 3, 300])
def test_percentiles_equal_sorted_values(spark, ranges):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([float(rng.randrange(50)), rng.gauss(0, 100), 7.0])) for _ in range(3000)]
    rows += [("c", None), ("d", 5.0), ("e", float("nan")), ("e", float("inf")), ("e", -1.0), *[("f", 7.0)] * 2000]
    df = spark.createDataFrame([(g, v, 1) for g, v in rows], "g string, v double, _v int")
    wanted = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}

    def plain(values):
        values = sorted(v for v in values if v is not None and math.isfinite(v))
        return tuple(values[max(0, math.ceil(f * len(values)) - 1)] for f in wanted.values()) if values else None

    groups = {g: plain([v for h, v in rows if h == g]) for g in {g for g, _ in rows}}
    got = {r.g: tuple(r)[1:] for r in exact_percentiles(df, ["g"], "v", wanted, ranges).collect()}
    assert got == {g: p for g, p in groups.items() if p}
    assert [tuple(r) for r in exact_percentiles(df, [], "v", wanted, ranges).collect()] == [plain([v for _, v in rows])]
    assert exact_percentiles(df.limit(0), ["g"], "v", wanted, ranges).count() == 0
