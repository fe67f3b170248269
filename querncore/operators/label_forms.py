"""Reviewers' labels in one form: aliases of keys and choices are resolved, legacy fields folded in, and every row is accepted or quarantined with its fault.

A label: label_kind, entity_id, candidate_id, visual_instance_id, role, reviewer_id, review_pass, run_key, capture_key (strings) and told, map<string,string> of what the
reviewer said: plain texts, or JSON for arrays, objects, numbers and booleans (as ``from_json(..., 'map<string,string>')`` gives them).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querncore.functions import ids
from querncore.functions.columns import settled

# Kinds of labels with the keys that each may hold, choices of keys, other spellings, what is no part of a label.
ROLES = ["icon", "wide", "favicon", "stacked", "other"]
VISUAL_ROLES = ["symbol", "wordmark", "horizontal_lockup", "stacked_lockup", "favicon", "social_card", "badge", "partner_logo", "ui_control", "content_image", "other"]
USABILITY = ["good", "conditional", "unusable"]
KEYS = {
    "entity": ["identity_status", "graphic_logo_present", "text_only_brand_present", "confidence", "note"],
    "candidate": ["identity", "roles", "best_for_role", "usability_light", "usability_dark", "safety_class", "provenance_quality", "quality_defects", "reject_reason", "confidence", "note"],
    "visual_instance": ["identity", "visual_role", "region", "theme", "visibility", "first_party", "mapping_confidence", "confidence", "note"],
    "missing_role": ["missing_cause", "confidence", "note"],
    "review_attestation": ["visual_evidence_reviewed", "review_workflow", "visual_instance_count"],
}
CHOICES = {
    "identity": ["correct", "wrong", "ambiguous"],
    "identity_status": ["current", "related_rebrand", "wrong_site", "ambiguous", "unreachable"],
    "visual_role": VISUAL_ROLES,
    "region": ["header", "nav", "body", "footer", "metadata", "browser_chrome", "unknown", "other"],
    "theme": ["light", "dark", "both", "unknown"],
    "visibility": USABILITY,
    "mapping_confidence": ["exact", "derived", "suggested", "unmapped"],
    "missing_cause": ["no_graphic_asset_exists", "icon_only_or_stacked_only", "asset_visible_not_discovered", "discovered_not_validated", "removed_by_url_or_byte_dedupe", "excluded_by_budget", "rejected_by_identity_or_evidence", "rejected_by_shape_or_quality", "ranked_below_worse_candidate", "theme_serialization_failure", "page_blocked_or_incomplete", "identity_unsafe_or_ambiguous", "not_missing"],
    "usability_light": USABILITY,
    "usability_dark": USABILITY,
    "safety_class": ["correct_brand", "wrong_brand", "related_brand", "not_logo", "unjudgeable", "unclassified_negative"],
    "provenance_quality": ["visible_exact_use", "structured_first_party", "inferred_first_party", "unsupported"],
    "review_workflow": ["positive_first"],
}
STRICT = {"first_party": ["yes", "no", "ambiguous"], "graphic_logo_present": ["true", "false", "ambiguous"], "text_only_brand_present": ["true", "false", "ambiguous"], "visual_evidence_reviewed": ["true", "false"]}
OTHER_WORDS = {"identity_correctness": "identity", "identity-correctness": "identity", "applicable_roles": "roles", "applicable-roles": "roles", "notes": "note", "cause": "missing_cause"}
OTHER_CAUSES = {"icon_or_stacked_only": "icon_only_or_stacked_only", "removed_by_dedupe": "removed_by_url_or_byte_dedupe", "rejected_identity_or_evidence": "rejected_by_identity_or_evidence", "rejected_shape_or_quality": "rejected_by_shape_or_quality"}
HYPHENATED = ["identity-status", "graphic-logo-present", "text-only-brand-present", "best-role", "best-for-role", "usability-light", "usability-dark", "safety-class", "provenance-quality", "quality-defects", "reject-reason", "visual-role", "first-party", "mapping-confidence", "missing-cause", "horizontal-lockup", "stacked-lockup", "social-card", "partner-logo", "ui-control", "content-image", "browser-chrome", "excluded-by-budget"]
NO_PART = ["display_name", "candidate_id", "visual_instance_id", "instance_box", "screenshot_path", "crop_path", "overlay_path", "missing"]
EVIDENCE_LIMIT = "(?i)no[_ -]?verified[_ -]?raster[_ -]?preview|preview unavailable|evidence limit|not enough evidence"

ALIASES = OTHER_WORDS | OTHER_CAUSES | {c.replace("_", "-"): v for c, v in OTHER_CAUSES.items()} | {h: h.replace("-", "_") for h in HYPHENATED}


def spelled(c: Column) -> Column:
    """The canonical spelling of one of ALIASES, else null. Most texts are no alias: a set tells so at once, where a map would be gone through."""
    table = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    return F.when(c.isin(list(ALIASES)), F.try_element_at(table, c))


def renamed(c: Column) -> Column:
    """The canonical spelling; what has none stays as it is."""
    return F.coalesce(spelled(c), c)


def chosen(c: Column) -> Column:
    """The canonical choice, other spellings in any case; what is no choice stays, to be found by ``off``."""
    return F.coalesce(spelled(c), spelled(F.lower(c)), c)


def off(c: Column, choices: list[str]) -> Column:
    return c.isNotNull() & ~c.isin(choices)


def texts(c: Column) -> Column:
    """An array told as JSON, or the one value told."""
    return F.when(c.isNull(), F.lit(None)).when(F.ltrim(c).startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))


def in_order(roles: Column) -> Column:
    """Each role once, in the order of ROLES, with what is none behind. roles is a column, not worked out here: it is read twice."""
    known = F.array(*map(F.lit, ROLES))
    return F.concat(F.array_intersect(known, roles), F.sort_array(F.array_compact(F.array_except(roles, known))))


def target_key(kind: Column, entity: Column, visual: Column, candidate: Column, role: Column) -> Column:
    own = lambda k, c: F.when(kind == k, F.coalesce(c, F.lit(""))).otherwise("")
    return ids.review_id("target-", ids.joined(F.lit("target"), kind, entity, own("visual_instance", visual), own("candidate", candidate), own("missing_role", role)))


def label_id(run: Column, capture: Column, review_pass: Column, reviewer: Column, target: Column) -> Column:
    return ids.review_id("label-", ids.joined(F.lit("label"), F.lit("visual-review-packet-v2"), run, capture, review_pass, reviewer, target))


def judged(labels: DataFrame, ranker_safe: Column | None = None) -> DataFrame:
    """labels with fault (null where a row is accepted) and the canonical form: target_key, label_id, role, said (map of the plain values), roles, best_for_role
    (roles in order), quality_defects.

    ranker_safe: rows of the workflow that makes wrong marks unusable negatives without roles. A row's first fault counts, in this order: invalid_label_kind,
    entity_id_required, duplicate_key, invalid_brand_mark_decision, duplicate_identity, invalid_best_for_role, invalid_roles, invalid_<key>, unknown_key, what the kind
    demands (candidate_id_required, visual_instance_id_required, role_required, target_not_allowed, attestation_incomplete), evidence_limit_defect, best_role_not_eligible.
    Nothing is written over: columns of these names in labels are replaced. Order of keys, repeats of rows and empty maps do not matter.
    """
    f = F.col
    told = F.coalesce(f("told"), F.create_map().cast("map<string,string>"))
    pairs = F.transform(F.map_entries(told), lambda e: F.struct(renamed(e["key"]).alias("key"), e["value"].alias("value")))
    pairs = F.filter(pairs, lambda e: ~e["key"].isin(NO_PART) & e["value"].isNotNull())
    df = settled(labels.withColumns({"_pairs": pairs, "_missing": F.try_element_at(told, F.lit("missing")) == "false"}))
    keys = f("_pairs.key")
    df = df.withColumn("_twice", F.size(keys) != F.size(F.array_distinct(keys)))
    df = settled(df.withColumn("_said", F.when(~f("_twice"), F.map_from_entries("_pairs"))).drop("_pairs"))
    said = lambda k: F.try_element_at("_said", F.lit(k))
    decision = F.coalesce(said("requested_company_brand_mark"), said("brand_mark_decision"))
    kind = f("label_kind")
    best_text = F.coalesce(said("best_for_role"), said("best_role"))
    listed = F.ltrim(best_text).startswith("{")
    # each text is read once, and what was read is a column before a lambda or several rules use it
    df = settled(
        df.withColumns(
            {
                "_decision": F.when(decision.isNotNull(), F.element_at(F.create_map(*map(F.lit, ["yes", "correct", "no", "wrong", "unclear", "ambiguous"])), F.lower(decision))),
                "_decided": decision.isNotNull(),
                "_listed": listed,
                "_flags": F.map_entries(F.from_json(F.when(listed, best_text), "map<string,string>")),
                "_best": texts(F.when(~listed & (best_text != ""), best_text)),
                "_roles": texts(said("roles")),
                "_defects": F.when(said("quality_defects").isin("", "none"), F.array().cast("array<string>")).otherwise(texts(said("quality_defects"))),
                "_visual": chosen(said("visual_role")),
                "_plain": F.struct(
                    *(chosen(F.coalesce(said(k), F.when((kind == "missing_role") & f("_missing"), "not_missing")) if k == "missing_cause" else said(k)).alias(k) for k in CHOICES if k not in ("identity", "visual_role")),
                    *(said(k).alias(k) for k in STRICT),
                    said("visual_instance_count").alias("visual_instance_count"), said("confidence").alias("confidence"), said("note").alias("note"), said("reject_reason").alias("reject_reason"), said("role").alias("role"), said("identity").alias("identity"),
                ),
            }
        )
    )
    flagged = F.transform(F.filter("_flags", lambda e: e["value"] == "true"), lambda e: e["key"])
    df = settled(df.withColumns({"_best": F.transform(F.when(f("_listed"), flagged).otherwise(f("_best")), chosen), "_roles": F.transform("_roles", chosen)}))
    odd_flags = f("_listed") & F.exists("_flags", lambda e: off(chosen(e["key"]), ROLES) | ~F.coalesce(e["value"].isin("true", "false"), F.lit(False)))
    df = settled(
        df.withColumns(
            {
                "_best": F.when(f("_best").isNotNull(), in_order(f("_best"))).when(kind == "candidate", F.array().cast("array<string>")),
                "_best_off": F.coalesce(odd_flags, F.lit(False)) | F.coalesce(F.exists("_best", lambda r: off(r, ROLES)), F.lit(False)),
                "_roles": in_order(f("_roles")),
            }
        )
    )
    df = df.withColumns({"_roles": F.coalesce("_roles", f("_best")), "_identity": F.coalesce("_decision", chosen(f("_plain.identity")))})
    safe = F.coalesce(ranker_safe, F.lit(False)) & (kind == "candidate") if ranker_safe is not None else F.lit(False)
    wrong = safe & F.coalesce(f("_identity") == "wrong", F.lit(False))
    light, dark = (F.when(wrong, "unusable").otherwise(f(f"_plain.usability_{s}")) for s in ("light", "dark"))
    none = F.array().cast("array<string>")
    df = df.withColumns({"_light": light, "_dark": dark, "_safe": safe, "_roles": F.when(wrong, none).when(safe, F.coalesce("_roles", none)).otherwise(f("_roles"))})
    no_best = f("_safe") & F.coalesce(f("_identity").isin("wrong", "ambiguous") | ((f("_light") == "unusable") & (f("_dark") == "unusable")), F.lit(False))
    role = F.nullif(chosen(F.coalesce("role", f("_plain.role"), F.when(kind == "visual_instance", f("_visual")))), F.lit(""))
    df = settled(df.withColumns({"_best": F.when(no_best, none).otherwise(f("_best")), "_role": role}))
    allowed = F.create_map(*[x for k, names in KEYS.items() for x in (F.lit(k), F.array(*map(F.lit, names)))])
    folded = ["requested_company_brand_mark", "brand_mark_decision", "best_role", "role"]
    unknown = F.exists(F.map_keys("_said"), lambda k: ~k.isin(folded) & ~F.array_contains(allowed[kind], k)) | (f("_decided") & ~F.array_contains(allowed[kind], "identity")) | (f("_roles").isNotNull() & ~F.array_contains(allowed[kind], "roles"))
    aimed = F.coalesce(f("candidate_id").isNotNull() | f("visual_instance_id").isNotNull() | f("_role").isNotNull(), F.lit(False))
    count = f("_plain.visual_instance_count").try_cast("double")
    attested = (f("_plain.visual_evidence_reviewed") == "true") & (f("_plain.review_workflow") == "positive_first") & (count >= 0) & (count == F.floor(count))
    usable = f("_light").isin("good", "conditional") | f("_dark").isin("good", "conditional")
    ineligible = f("_safe") & F.exists("_best", lambda r: ~F.coalesce(F.array_contains(f("_roles"), r) & (f("_identity") == "correct") & usable, F.lit(False)))
    plain = {k: f(f"_plain.{k}") for k in CHOICES if k not in ("identity", "visual_role", "usability_light", "usability_dark")} | {"identity": f("_identity"), "visual_role": f("_visual"), "usability_light": f("_light"), "usability_dark": f("_dark")}
    rules = [
        ("invalid_label_kind", kind.isNull() | ~kind.isin(list(KEYS))),
        ("entity_id_required", F.coalesce("entity_id", F.lit("")) == ""),
        ("duplicate_key", f("_twice")),
        ("invalid_brand_mark_decision", f("_decided") & f("_decision").isNull()),
        ("duplicate_identity", f("_decided") & f("_plain.identity").isNotNull()),
        ("invalid_best_for_role", f("_best_off")),
        ("invalid_roles", F.exists("_roles", lambda r: off(r, ROLES))),
        *((f"invalid_{k}", off(c, CHOICES[k])) for k, c in plain.items()),
        *((f"invalid_{k}", off(f(f"_plain.{k}"), c)) for k, c in STRICT.items()),
        ("invalid_visual_instance_count", f("_plain.visual_instance_count").isNotNull() & ~F.coalesce((count >= 0) & (count == F.floor(count)), F.lit(False))),
        ("invalid_role", F.when(kind == "visual_instance", off(f("_role"), VISUAL_ROLES)).otherwise(off(f("_role"), ROLES))),
        ("unknown_key", unknown),
        ("candidate_id_required", (kind == "candidate") & f("candidate_id").isNull()),
        ("visual_instance_id_required", (kind == "visual_instance") & f("visual_instance_id").isNull()),
        ("role_required", (kind == "missing_role") & f("_role").isNull()),
        ("target_not_allowed", kind.isin("entity", "review_attestation") & aimed),
        ("attestation_incomplete", (kind == "review_attestation") & ~F.coalesce(attested, F.lit(False))),
        ("evidence_limit_defect", f("_safe") & F.exists("_defects", lambda d: d.rlike(EVIDENCE_LIMIT))),
        ("best_role_not_eligible", ineligible),
    ]
    fault = reduce(lambda c, r: c.when(F.coalesce(r[1], F.lit(False)), r[0]), rules[1:], F.when(rules[0][1], rules[0][0]))
    or_else = lambda c, other: F.coalesce(c, F.lit(other))
    target = target_key(kind, f("entity_id"), f("visual_instance_id"), f("candidate_id"), f("_role"))
    said_now = F.struct(*(c.alias(k) for k, c in plain.items()), *(f(f"_plain.{k}").alias(k) for k in (*STRICT, "visual_instance_count", "confidence", "note", "reject_reason")))
    df = df.withColumns({"fault": fault, "target_key": target, "role": f("_role"), "said": said_now, "roles": f("_roles"), "best_for_role": f("_best"), "quality_defects": f("_defects")})
    df = df.withColumn("label_id", label_id(or_else(f("run_key"), "run"), or_else(f("capture_key"), "capture"), or_else(f("review_pass"), "default"), or_else(f("reviewer_id"), "unassigned"), f("target_key")))
    return df.drop(*(c for c in df.columns if c.startswith("_")))


def parted(labels: DataFrame, ranker_safe: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Accepted labels in canonical form, and quarantined ones as they came, with their fault: together every row, each in one of the two."""
    rows = judged(labels, ranker_safe)
    return rows.filter("fault IS NULL").drop("fault", "told"), rows.filter("fault IS NOT NULL").select(*labels.columns, "fault")
