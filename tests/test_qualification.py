"""Gates, stages, rendered observations, names: flawless tables, one flaw at a time, and plain versions."""

from __future__ import annotations

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from querncore.functions.names import folded, normalized_name
from querncore.operators import dedupe, gates

FP = "sha256:" + "a" * 64
KINDS = {
    "results": "cohort string, entity int, ranking_version int",
    "assignments": "cohort string, entity int",
    "candidates": "cohort string, entity int, candidate string",
    "selections": "cohort string, entity int, role string, candidate string",
    "labels": "cohort string, entity int, candidate string, role string, identity string, safety_class string, fingerprint string, safety_prompt string, safety_fingerprint string",
}


def label(e, c, role=None, identity="correct", safety="correct_brand", fp=FP, prompt=None, sfp=None):
    return ("x", e, c, role, identity, safety, fp, prompt, sfp)


NEGATIVE = label(1, "b", identity="wrong", safety="wrong_brand", prompt=gates.SAFETY_PROMPT, sfp=FP)
GOOD = {
    "results": [("x", 1, 12), ("x", 2, 12)],
    "assignments": [("x", 1), ("x", 2)],
    "candidates": [("x", 1, "a"), ("x", 1, "b"), ("x", 2, "a")],
    "selections": [("x", 1, "icon", "a"), ("x", 1, "wide", "a"), ("x", 2, "icon", None)],
    "labels": [label(1, "a"), NEGATIVE, label(2, "a")],
}
ALL = {"selected_slot_score", "exhaustive_surface", "runtime_replay"}
SURFACE = {"exhaustive_surface", "runtime_replay"}
#: A change of a table, and the gates that fail then.
FLAWS = [
    ({}, set()),
    ({"results": [("x", 1, 12), ("x", 2, 11)]}, {"results_of_current_ranking", "runtime_replay"}),
    ({"results": [("x", 1, 12), ("x", 3, 12)]}, {"results_assigned", "assignments_answered", *ALL}),
    ({"results": [*GOOD["results"], ("x", 1, 12)]}, {"assignments_answered", *ALL}),
    ({"assignments": [("x", 1), ("x", 2), ("x", 2)]}, {"results_assigned", *ALL}),
    ({"candidates": [*GOOD["candidates"], ("x", 2, "a")]}, {"candidates_once", *ALL}),
    ({"candidates": [*GOOD["candidates"], ("x", 2, "c")]}, {"candidates_labelled", *ALL}),
    ({"labels": [*GOOD["labels"], label(2, "z")]}, {"labels_of_candidates", *ALL}),
    ({"labels": [*GOOD["labels"], label(2, "a")]}, {"canonical_labels_once", *ALL}),
    ({"labels": [*GOOD["labels"], label(1, "a", "icon"), label(1, "a", "icon")]}, {"role_labels_once", *ALL}),
    ({"labels": [*GOOD["labels"], label(1, "a", "icon")]}, set()),
    ({"labels": [label(1, "a", fp="sha256:1"), *GOOD["labels"][1:]]}, {"labels_fingerprinted", *SURFACE}),
    ({"labels": [label(1, "a", safety="unclassified_negative"), *GOOD["labels"][1:]]}, {"labels_with_concrete_safety", *SURFACE}),
    ({"labels": [label(1, "a", safety=None), *GOOD["labels"][1:]]}, {"labels_with_concrete_safety", *SURFACE}),
    ({"labels": [GOOD["labels"][0], (*NEGATIVE[:-1], "sha256:" + "b" * 64), GOOD["labels"][2]]}, {"negatives_reviewed", *SURFACE}),
    ({"labels": [GOOD["labels"][0], (*NEGATIVE[:-2], "v0", FP), GOOD["labels"][2]]}, {"negatives_reviewed", *SURFACE}),
    ({"selections": [("x", 1, "icon", "q")]}, {"selections_of_candidates", "selected_slots_labelled", "selected_slots_canonical", *ALL}),
    ({"labels": [label(1, "a", "icon"), label(1, "a", "wide")]}, {"candidates_labelled", "selected_slots_canonical", *SURFACE}),
    ({"labels": [label(1, "a", "icon")]}, {"candidates_labelled", "selected_slots_canonical", "selected_slots_labelled", *ALL}),
    ({"labels": []}, {"candidates_labelled", "selected_slots_canonical", "selected_slots_labelled", *ALL}),
]


def test_gates_one_flaw_at_a_time(spark):
    tables = {n: [(f"{k}", *row[1:]) for k, (flaw, _) in enumerate(FLAWS) for row in (GOOD | flaw)[n]] for n in KINDS}
    got = gates.gates(**{n: spark.createDataFrame(rows, KINDS[n]).repartition(2) for n, rows in tables.items()}, current_version=12).collect()
    for k, (flaw, fails) in enumerate(FLAWS):
        own = [r for r in got if r.cohort == str(k)]
        assert len(own) == 17 and {r.gate for r in own if not r.passed} == fails, flaw
        assert all(r.passed == (r.found == r.expected) for r in own)


def test_gates_of_nothing(spark):
    assert gates.gates(**{n: spark.createDataFrame([], k) for n, k in KINDS.items()}, current_version=1).count() == 0


def test_stage_coverage(spark):
    assigned = spark.createDataFrame([(1,), (2,), (2,), (None,)], "entity int")
    stages = spark.createDataFrame([(1, "a", "open"), (1, "a", "complete"), (2, "a", "complete"), (1, "b", "complete"), (3, "b", "complete"), (3, "b", "open"), (1, "z", "complete")], "entity int, stage string, status string")
    got = {r.stage: tuple(r)[1:] for r in gates.stage_coverage(assigned, stages, ["a", "b", "c"]).collect()}
    assert got == {"a": (2, 2, 0, 0, True), "b": (2, 1, 1, 2, False), "c": (2, 0, 2, 0, False)}


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_rendered_observations_merge_in_order(spark, block):
    rng = random.Random(block)
    rows = []
    for at in range(300):
        kind = rng.choice(["inline-svg", "external", "img", None])
        rows.append((rng.choice(["p", "p", "p", "q", None]), at, kind, rng.choice(["https://a/1", "http://a/2", "ftp://a", None]), rng.choice(["<svg/>", None]) if kind == "inline-svg" else None, rng.choice([None, "{}"]), f"e{at}"))
    rows += [("p", 5, "img", "https://a/1", None, None, "e5b"), ("p", 5, "img", "https://a/1", None, None, "e5b")]
    want: dict = {}
    for r in sorted(rows, key=lambda r: (r[1], r[6])):
        e, at, kind, url, svg, css, ev = r
        if kind == "external" and not (url or "").startswith("http"):
            continue
        key = (e, f"svg:{svg or ''}" if kind == "inline-svg" else f"url:{url or ''}:{css or 'null'}")
        want.setdefault(key, (r, []))[1].append(ev)
    df = spark.createDataFrame(rows, "entity string, at long, kind string, url string, inline_svg string, css_background string, evidence string").repartition(3)
    survivors, evidence = dedupe.merge_rendered(df, ["entity"], "at", block)
    assert sorted(map(repr, (tuple(r) for r in survivors.collect()))) == sorted(repr(r) for r, _ in want.values())
    told = sorted(repr(tuple(r)) for r in evidence.collect())
    assert told == sorted(repr((r[0], r[1], k, ev)) for r, many in want.values() for k, ev in enumerate(many))
    assert dedupe.merge_rendered(df.limit(0), ["entity"], "at")[1].count() == 0


NAMES = {
    "Société Générale S.A.": "societe generale s a", "ACME Inc": "acme", "Acme Co. Ltd, Inc.": "acme", "Inc": "inc", "Co Inc": "co", "ﬁne № ２": "fine o 2", "": "", "   ": "", "Über-Straße GmbH": "uber stra e", "Å̈ngström": "angstrom", "日本 7": "7", "Incorporated Company of X": "incorporated company of x", "İstanbul AG": "istanbul",
}


def test_names(spark):
    df = spark.createDataFrame([(k,) for k in [*NAMES, None]], "n string")
    got = {r.n: r.m for r in df.select("n", normalized_name(F.col("n")).alias("m")).collect()}
    assert got == NAMES | {None: ""}


def test_folding_equals_unicode(spark):
    texts = ["é ô ﬃ Ⅷ ½ ㎏", "x" * 5000 + "é", None, "", "\x00é", "".join(chr(c) for c in range(0xC0, 0x250))]
    got = [r.f for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", folded(F.col("t")).alias("f")).orderBy("k").collect()]
    assert got == [None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not 0x300 <= ord(c) <= 0x36F) for t in texts]
