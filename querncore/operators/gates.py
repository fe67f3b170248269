"""Whether labels qualify a cohort's ranking: a table of gates, each with what was found, what was expected and a verdict.

Tables (all with cohort): results (entity, ranking_version), assignments (entity), candidates (entity, candidate), selections (entity, role, candidate), labels (entity, candidate, role, identity,
safety_class, fingerprint, safety_prompt, safety_fingerprint; role null: a canonical label of the candidate, else one of the candidate in that role).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Safety classes that tell something, the form of fingerprints, and the review that negatives go through.
CONCRETE_SAFETY = ("correct_brand", "wrong_brand", "related_brand", "not_logo", "unjudgeable")
FINGERPRINT = "^sha256:[a-f0-9]{64}$"
SAFETY_PROMPT = "visual-label-safety-v1-exhaustive-negatives"


def said(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def per_cohort(df: DataFrame, **counts: Column) -> DataFrame:
    return df.groupBy("cohort").agg(*(c.alias(n) for n, c in counts.items()))


def gates(results: DataFrame, assignments: DataFrame, candidates: DataFrame, selections: DataFrame, labels: DataFrame, current_version: int) -> DataFrame:
    """cohort, gate, found, expected, passed: a row for each gate of each cohort that any table names.

    Counts: results_assigned (results whose entity is assigned), assignments_answered, candidates_once (keys of candidates), labels_of_candidates, canonical_labels_once, role_labels_once,
    selections_of_candidates, selected_slots_labelled, candidates_labelled, labels_fingerprinted, labels_with_concrete_safety, negatives_reviewed, selected_slots_canonical, results_of_current_ranking.
    Verdicts, whose found and expected count the gates they rest on: selected_slot_score, exhaustive_surface, runtime_replay.

    Each table is counted once, by keys in parts before keys are shuffled; keys meet in one union, so no table is joined to another by a cohort or an entity alone.
    A null key never matches. Cohorts without a table's rows have zeros there.
    """
    key = ["cohort", "entity", "candidate"]
    one, zero = F.lit(1), F.lit(0)
    flag = lambda c: said(c).cast("int")
    names = ["c", "l", "fp", "safe", "neg", "neg_ok", "r", "s_rows"]

    def side(df: DataFrame, **told: Column) -> DataFrame:
        return df.select(*key, *(told.get(n, zero).cast("long").alias(n) for n in names))

    wrong = F.col("identity") == "wrong"
    reviewed = (F.col("safety_prompt") == SAFETY_PROMPT) & F.col("safety_fingerprint").rlike(FINGERPRINT) & (F.col("safety_fingerprint") == F.col("fingerprint"))
    canonical = labels.filter("role IS NULL")
    parts = [
        side(candidates, c=one),
        side(canonical, l=one, fp=flag(F.col("fingerprint").rlike(FINGERPRINT)), safe=flag(F.col("safety_class").isin(*CONCRETE_SAFETY)), neg=flag(wrong), neg_ok=flag(wrong & reviewed)),
        side(labels.filter("role IS NOT NULL"), r=one),
        side(selections.filter("candidate IS NOT NULL"), s_rows=one),
    ]
    keys = reduce(DataFrame.unionByName, parts).groupBy(*key).agg(*(F.sum(n).alias(n) for n in names))
    whole = F.col("entity").isNotNull() & F.col("candidate").isNotNull()
    there = (F.col("c") > 0) & whole
    by_key = per_cohort(
        keys,
        n_candidates=F.sum("c"), n_keys=F.count_if((F.col("c") > 0)), n_labels=F.sum("l"), n_role_labels=F.sum("r"), n_label_keys=F.count_if(F.col("l") > 0), labels_there=F.sum(F.when(there, F.col("l") + F.col("r")).otherwise(0)), n_selected=F.sum("s_rows"),
        selected_there=F.sum(F.when(there, F.col("s_rows")).otherwise(0)), labelled=F.count_if(there & (F.col("l") > 0)), fingerprinted=F.sum("fp"), concrete=F.sum("safe"), negatives=F.sum("neg"), reviewed=F.sum("neg_ok"), selected_canonical=F.sum(F.when(whole & (F.col("l") > 0), F.col("s_rows")).otherwise(0)),
    )
    slot = [*key, "role"]
    has = canonical.select(*key, F.lit(1).alias("canonical")).distinct()
    slots = selections.filter("candidate IS NOT NULL").select(*slot, one.alias("s"), zero.alias("x")).unionByName(labels.filter("role IS NOT NULL").select(*slot, zero.alias("s"), one.alias("x")))
    slots = slots.groupBy(*slot).agg(F.sum("s").alias("s"), F.sum("x").alias("x")).join(has, key, "left")
    by_slot = per_cohort(slots, slots=F.sum("s"), slots_labelled=F.sum(F.when((F.col("x") > 0) | F.col("canonical").isNotNull(), F.col("s")).otherwise(0)), role_label_keys=F.count_if(F.col("x") > 0))
    ends = results.select("cohort", "entity", one.alias("r"), zero.alias("a"), flag(F.col("ranking_version") == current_version).alias("v")).unionByName(assignments.select("cohort", "entity", zero.alias("r"), one.alias("a"), zero.alias("v")))
    ends = ends.groupBy("cohort", "entity").agg(*(F.sum(c).alias(c) for c in "rav"))
    known = F.col("entity").isNotNull()
    by_entity = per_cohort(ends, results=F.sum("r"), assigned=F.sum("a"), results_assigned=F.sum(F.when(known & (F.col("a") == 1), F.col("r")).otherwise(0)), answered=F.sum(F.when(known & (F.col("r") == 1), F.col("a")).otherwise(0)), current=F.sum("v"))

    all_ = by_key.join(by_slot, "cohort", "full_outer").join(by_entity, "cohort", "full_outer")
    all_ = all_.select("cohort", *(F.coalesce(c, F.lit(0)).alias(c) for c in all_.columns if c != "cohort"))
    pairs = {
        "results_assigned": ("results_assigned", "results"),
        "assignments_answered": ("answered", "assigned"),
        "candidates_once": ("n_keys", "n_candidates"),
        "labels_of_candidates": ("labels_there", F.col("n_labels") + F.col("n_role_labels")),
        "canonical_labels_once": ("n_label_keys", "n_labels"),
        "role_labels_once": ("role_label_keys", "n_role_labels"),
        "selections_of_candidates": ("selected_there", "n_selected"),
        "selected_slots_labelled": ("slots_labelled", "slots"),
        "candidates_labelled": ("labelled", "n_keys"),
        "labels_fingerprinted": ("fingerprinted", "n_labels"),
        "labels_with_concrete_safety": ("concrete", "n_labels"),
        "negatives_reviewed": ("reviewed", "negatives"),
        "selected_slots_canonical": ("selected_canonical", "n_selected"),
        "results_of_current_ranking": ("current", "results"),
    }
    shown = lambda c: F.col(c) if isinstance(c, str) else c
    passed = {g: shown(a) == shown(b) for g, (a, b) in pairs.items()}
    sound = ["results_assigned", "assignments_answered", "candidates_once", "labels_of_candidates", "canonical_labels_once", "role_labels_once", "selections_of_candidates"]
    surface = [*sound, "candidates_labelled", "labels_fingerprinted", "labels_with_concrete_safety", "negatives_reviewed", "selected_slots_canonical"]
    # where a cohort has canonical labels at all, they have to cover every candidate
    partial = F.when(F.col("n_labels") > 0, passed["candidates_labelled"] & passed["selected_slots_canonical"]).otherwise(True)
    verdicts = {"selected_slot_score": [*(passed[g] for g in [*sound, "selected_slots_labelled"]), partial], "exhaustive_surface": [passed[g] for g in surface], "runtime_replay": [passed[g] for g in [*surface, "results_of_current_ranking"]]}
    gate = lambda n, a, b, ok: F.struct(F.lit(n).alias("gate"), a.cast("long").alias("found"), b.cast("long").alias("expected"), ok.alias("passed"))
    out = [gate(g, shown(a), shown(b), passed[g]) for g, (a, b) in pairs.items()]
    for name, conds in verdicts.items():
        n = reduce(lambda x, y: x + y, (c.cast("long") for c in conds))
        out.append(gate(name, n, F.lit(len(conds)), n == len(conds)))
    return all_.select("cohort", F.explode(F.array(*out)).alias("g")).select("cohort", "g.*")


def stage_coverage(assigned: DataFrame, stages: DataFrame, wanted: list[str]) -> DataFrame:
    """A row for each stage wanted: stage, assigned, complete, missing, unknown (rows of entities that no one was assigned), passed. assigned: entity; stages: entity,
    stage, status. An entity has completed a stage once any of its rows says so."""
    rows = stages.filter(F.col("stage").isin(wanted)).groupBy("entity", "stage").agg(F.bool_or(F.col("status") == "complete").alias("done"), F.count("*").alias("n"))
    owed = assigned.filter("entity IS NOT NULL").select("entity").distinct().select("entity", F.explode(F.array(*map(F.lit, wanted))).alias("stage"), F.lit(1).alias("owed"))
    both = owed.join(rows, ["entity", "stage"], "full_outer")
    done = F.count_if(F.col("owed").isNotNull() & said(F.col("done")))
    n = F.count("owed")
    out = both.groupBy("stage").agg(n.alias("assigned"), done.alias("complete"), (n - done).alias("missing"), F.coalesce(F.sum(F.when(F.col("owed").isNull(), F.col("n"))), F.lit(0)).alias("unknown"))
    return out.withColumn("passed", (F.col("missing") == 0) & (F.col("unknown") == 0))
