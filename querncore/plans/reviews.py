"""Queries over reviewers' labels and runs that are put together, on stand-ins; the rules are written twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from querncore.functions.canonical import canonical
from querncore.functions.columns import settled
from querncore.operators import label_forms, merging
from querncore.plans.candidates import K, dealt, of_lines
from querncore.plans.catalogue import query, t

RECORDS = """SELECT * FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'candidate' WHEN 1 THEN 'label' ELSE 'mapping' END AS record_type, o_orderkey AS key, CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE o_custkey END AS entity, CASE WHEN o_orderkey % 37 = 0 THEN (o_custkey + 2) % 5 ELSE o_custkey % 5 END AS run, o_totalprice AS price FROM orders)
UNION ALL SELECT 'label', o_orderkey, o_custkey, o_custkey % 5, o_totalprice FROM orders WHERE o_orderkey % 41 = 0"""
OWNERS = "SELECT c_custkey % 5 AS run, c_custkey AS entity FROM customer WHERE c_custkey % 31 <> 0 UNION ALL SELECT (c_custkey + 1) % 5, c_custkey FROM customer WHERE c_custkey % 29 = 0 UNION ALL SELECT c_custkey % 5, c_custkey FROM customer WHERE c_custkey % 7 = 0 AND c_custkey % 31 <> 0"
FAULTS = f"""rec AS ({RECORDS}), own AS ({OWNERS}), o AS (SELECT entity, min(run) AS owner, count(DISTINCT run) AS owners, list_sort(list(DISTINCT run)) AS runs FROM own GROUP BY entity),
j AS (SELECT rec.*, CASE WHEN o.owners > 1 THEN 'overlapping_ownership' WHEN rec.entity IS NOT NULL AND (o.owner IS NULL OR o.owner <> rec.run) THEN 'outside_owned' WHEN count(*) OVER (PARTITION BY record_type, key) > 1 THEN 'duplicate_key' END AS fault FROM rec LEFT JOIN o ON o.entity = rec.entity)"""


def records(spark, sf):
    return spark.sql(RECORDS.replace("FROM orders", "FROM {orders}"), orders=t(spark, sf, "orders"))


def owners(spark, sf):
    return spark.sql(OWNERS.replace("FROM customer", "FROM {customer}"), customer=t(spark, sf, "customer"))


@query(f"WITH {FAULTS} SELECT record_type, key, entity, run, price FROM j WHERE fault IS NULL")
def merged_runs(spark, sf):
    return merging.merged(records(spark, sf), owners(spark, sf)).select("record_type", "key", "entity", "run", "price")


@query(f"""WITH {FAULTS} SELECT 'overlapping_ownership' AS kind, NULL AS record_type, NULL AS key, CAST(entity AS VARCHAR) AS entity, array_to_string(runs, ',') AS runs, owners AS n FROM o WHERE owners > 1
UNION ALL SELECT fault, record_type, CAST(key AS VARCHAR), CAST(entity AS VARCHAR), array_to_string(list_sort(list(DISTINCT run)), ','), count(*) FROM j WHERE fault IN ('outside_owned', 'duplicate_key') GROUP BY fault, record_type, key, entity""")
def merge_conflicts(spark, sf):
    return merging.conflicts(records(spark, sf), owners(spark, sf)).withColumn("runs", F.array_join("runs", ","))


@query(f"WITH {FAULTS} SELECT record_type, count(*) FILTER (fault IS NULL) AS merged, count(*) FILTER (fault = 'overlapping_ownership') AS overlapping, count(*) FILTER (fault = 'outside_owned') AS outside, count(*) FILTER (fault = 'duplicate_key') AS duplicate FROM j GROUP BY record_type")
def merge_counts(spark, sf):
    return merging.per_type(records(spark, sf), owners(spark, sf))


LABEL = {
    "k": K,
    "label_kind": dealt(1, ["candidate", "entity", "visual_instance", "missing_role", "review_attestation", "candidate", "sheet", "candidate"]),
    "entity_id": f"CASE WHEN {K} % 43 = 0 THEN '' ELSE 'e' || l_suppkey END",
    "candidate_id": f"CASE WHEN {K} % 5 <> 4 THEN 'c' || l_partkey END",
    "visual_instance_id": f"CASE WHEN {K} % 8 = 2 AND {K} % 3 > 0 THEN 'v' || l_partkey END",
    "role": dealt(4, [None, None, "icon", None, "social-card"]),
    "safe": f"{K} % 2 = 0",
    "ka": dealt(2, ["identity", "identity-correctness", "brand_mark_decision", None]),
    "va": dealt(3, ["correct", "wrong", "ambiguous", "YES", "no"]),
    "kb": dealt(5, ["roles", "applicable_roles", None, "best-role"]),
    "vb": dealt(7, ['["wide","icon"]', "icon", '["icon","icon","logo"]', "favicon", "[]"]),
    "kc": dealt(3, ["usability_light", "usability-light", None]),
    "vc": dealt(2, ["good", "Unusable", "unusable", "conditional"]),
    "kd": dealt(11, ["note", None, "missing-cause", "confidence", "region", None]),
    "vd": dealt(2, ["x", "removed-by-dedupe", "header", "not_missing"]),
    "ke": dealt(13, ["remark", "display_name", None, None, "identity_correctness"]),
    "ve": dealt(2, ["correct", "wrong"]),
}
PAIRS = ["abcde"[i] for i in range(5)]
JUDGED = f"""c AS MATERIALIZED (SELECT row_number() OVER () AS rid, {', '.join(f'{v} AS {n}' for n, v in LABEL.items())} FROM lineitem),
p AS (SELECT rid, CASE raw WHEN 'identity-correctness' THEN 'identity' WHEN 'identity_correctness' THEN 'identity' WHEN 'applicable_roles' THEN 'roles' WHEN 'best-role' THEN 'best_role' WHEN 'usability-light' THEN 'usability_light' WHEN 'missing-cause' THEN 'missing_cause' ELSE raw END AS key, v FROM (SELECT rid, unnest([{', '.join('k' + x for x in PAIRS)}]) AS raw, unnest([{', '.join('v' + x for x in PAIRS)}]) AS v FROM c) WHERE raw IS NOT NULL AND raw <> 'display_name'),
g AS (SELECT rid, count(*) > count(DISTINCT key) AS twice, list(key) AS keys, {', '.join(f"max(v) FILTER (key = '{n}') AS {n}" for n in ('identity', 'brand_mark_decision', 'roles', 'best_role', 'usability_light', 'missing_cause', 'region'))} FROM p GROUP BY rid),
h AS (SELECT c.k, label_kind AS kind, entity_id, candidate_id, visual_instance_id, role AS told_role, safe AND label_kind = 'candidate' AS safe, coalesce(twice, false) AS twice, coalesce(keys, []) AS keys, CASE lower(brand_mark_decision) WHEN 'yes' THEN 'correct' WHEN 'no' THEN 'wrong' END AS decision, brand_mark_decision IS NOT NULL AS decided, g.identity AS stated,
  usability_light AS light, CASE missing_cause WHEN 'removed-by-dedupe' THEN 'removed_by_url_or_byte_dedupe' ELSE missing_cause END AS cause, region, CASE WHEN g.roles LIKE '[%' THEN CAST(from_json(g.roles, '["VARCHAR"]') AS VARCHAR[]) WHEN g.roles IS NOT NULL THEN [g.roles] END AS r0, CASE WHEN best_role LIKE '[%' THEN CAST(from_json(best_role, '["VARCHAR"]') AS VARCHAR[]) WHEN best_role IS NOT NULL THEN [best_role] END AS b0 FROM c LEFT JOIN g ON g.rid = c.rid),
i AS (SELECT *, coalesce(decision, stated) AS who, list_concat(list_filter(['icon', 'wide', 'favicon', 'stacked', 'other'], lambda x: list_contains(r0, x)), list_filter(list_distinct(r0), lambda x: x = 'logo')) AS r1, CASE WHEN b0 IS NOT NULL THEN list_concat(list_filter(['icon', 'wide', 'favicon', 'stacked', 'other'], lambda x: list_contains(b0, x)), list_filter(list_distinct(b0), lambda x: x = 'logo')) WHEN kind = 'candidate' THEN [] END AS b1,
  CASE WHEN told_role = 'social-card' THEN 'social_card' ELSE told_role END AS role FROM h),
j AS (SELECT *, CASE WHEN safe AND who = 'wrong' THEN 'unusable' ELSE light END AS lit, CASE WHEN safe AND who = 'wrong' THEN 'unusable' END AS dim, CASE WHEN safe AND who = 'wrong' THEN [] WHEN r0 IS NOT NULL THEN r1 WHEN b1 IS NOT NULL THEN b1 WHEN safe THEN [] END AS roles FROM i),
m AS (SELECT *, CASE WHEN safe AND coalesce(who IN ('wrong', 'ambiguous') OR (lit = 'unusable' AND dim = 'unusable'), false) THEN [] ELSE b1 END AS best FROM j),
n AS (SELECT *, CASE WHEN kind = 'sheet' THEN 'invalid_label_kind' WHEN entity_id = '' THEN 'entity_id_required' WHEN twice THEN 'duplicate_key' WHEN decided AND decision IS NULL THEN 'invalid_brand_mark_decision' WHEN decided AND stated IS NOT NULL THEN 'duplicate_identity' WHEN list_contains(b0, 'logo') THEN 'invalid_best_for_role' WHEN list_contains(roles, 'logo') THEN 'invalid_roles'
  WHEN region NOT IN ('header') THEN 'invalid_region' WHEN cause NOT IN ('removed_by_url_or_byte_dedupe', 'not_missing') THEN 'invalid_missing_cause' WHEN who NOT IN ('correct', 'wrong', 'ambiguous') THEN 'invalid_identity' WHEN lit NOT IN ('good', 'conditional', 'unusable') THEN 'invalid_usability_light' WHEN (kind = 'visual_instance' AND role = 'icon') OR (kind <> 'visual_instance' AND role = 'social_card') THEN 'invalid_role'
  WHEN list_contains(keys, 'remark') OR (kind <> 'candidate' AND (list_has_any(keys, ['roles', 'usability_light']) OR roles IS NOT NULL)) OR (kind NOT IN ('candidate', 'visual_instance') AND (decided OR list_contains(keys, 'identity'))) OR (kind <> 'missing_role' AND list_contains(keys, 'missing_cause')) OR (kind <> 'visual_instance' AND list_contains(keys, 'region')) OR (kind = 'review_attestation' AND list_has_any(keys, ['note', 'confidence'])) THEN 'unknown_key'
  WHEN kind = 'candidate' AND candidate_id IS NULL THEN 'candidate_id_required' WHEN kind = 'visual_instance' AND visual_instance_id IS NULL THEN 'visual_instance_id_required' WHEN kind = 'missing_role' AND role IS NULL THEN 'role_required' WHEN kind IN ('entity', 'review_attestation') AND (candidate_id IS NOT NULL OR visual_instance_id IS NOT NULL OR role IS NOT NULL) THEN 'target_not_allowed' WHEN kind = 'review_attestation' THEN 'attestation_incomplete'
  WHEN safe AND len(list_filter(best, lambda b: NOT coalesce(list_contains(roles, b) AND who = 'correct' AND lit IN ('good', 'conditional'), false))) > 0 THEN 'best_role_not_eligible' END AS fault FROM m)"""


def labels(spark, sf):
    c = settled(of_lines(spark, sf, LABEL))
    pairs = F.filter(F.array(*(F.struct(F.col("k" + x).alias("key"), F.col("v" + x).alias("value")) for x in PAIRS)), lambda e: e["key"].isNotNull())
    none = F.lit(None).cast("string")
    return c.withColumn("told", F.map_from_entries(pairs)).withColumns({n: none for n in ("reviewer_id", "review_pass", "run_key", "capture_key")})


@query(f"WITH {JUDGED} SELECT k, kind AS label_kind, who AS identity, array_to_string(roles, ',') AS roles, array_to_string(best, ',') AS best, lit AS usability_light, role, cause AS missing_cause FROM n WHERE fault IS NULL")
def canonical_labels(spark, sf):
    kept, _ = label_forms.parted(labels(spark, sf), F.col("safe"))
    said = F.col("said")
    return kept.select("k", "label_kind", said["identity"].alias("identity"), F.array_join("roles", ",").alias("roles"), F.array_join("best_for_role", ",").alias("best"), said["usability_light"].alias("usability_light"), "role", said["missing_cause"].alias("missing_cause"))


@query(f"WITH {JUDGED} SELECT k, fault FROM n WHERE fault IS NOT NULL")
def quarantined_labels(spark, sf):
    _, out = label_forms.parted(labels(spark, sf), F.col("safe"))
    return out.select("k", "fault")


@query("""SELECT c_custkey, '{"items":[' || coalesce(array_to_string(list_sort(list('{"n":' || n || ',"flags":{"' || l || '":' || CASE WHEN big THEN 'true' ELSE 'false' END || ',"of":null}}')), ','), '') || '],"name":"' || c_name || '"}' AS text, count(*) AS rows
FROM (SELECT c_custkey, c_name, o_orderkey % 4 AS n, 'x' || o_orderstatus AS l, o_orderkey % 2 = 0 AS big FROM customer JOIN orders ON o_custkey = c_custkey) GROUP BY c_custkey, c_name""".replace('\'{"n":\' || n || \',"flags":{"\' || l || \'":\' || CASE WHEN big THEN \'true\' ELSE \'false\' END || \',"of":null}}\'', '\'{"flags":{"of":null,"\' || l || \'":\' || CASE WHEN big THEN \'true\' ELSE \'false\' END || \'},"n":\' || n || \'}\''))
def canonical_values(spark, sf):
    """Orders of a customer as nested values, gathered in any order."""
    flags = F.create_map(F.concat(F.lit("x"), F.col("o_orderstatus")), F.col("o_orderkey") % 2 == 0, F.lit("of"), F.lit(None).cast("boolean"))
    rows = t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), F.struct((F.col("o_orderkey") % 4).alias("n"), flags.alias("flags")).alias("item"))
    by = rows.join(t(spark, sf, "customer").select("c_custkey", "c_name"), "c_custkey").groupBy("c_custkey", "c_name").agg(F.collect_list("item").alias("items"), F.count("*").alias("rows"))  # a customer's orders
    value = by.withColumn("value", F.struct(F.col("c_name").alias("name"), "items"))
    return value.select("c_custkey", canonical(F.col("value"), value.schema["value"].dataType).alias("text"), "rows")
