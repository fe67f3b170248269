"""Queries of gates, stages, rendered observations and names, on stand-ins; the rules are written twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from querncore.functions.names import normalized_name
from querncore.operators import dedupe, gates
from querncore.plans.catalogue import query, t

#: Cohorts of customers, orders as candidates; most of them flawless, each with flaws of its own.
COHORT = "CASE WHEN {0} % 4 = 0 THEN 'a' WHEN {0} % 4 = 1 THEN 'b' ELSE 'c' END"
SHA = "'sha256:' || {0}"
HEX = "'0123456789abcdef0123456789abcdef0123456789abcdef0123456789abcdef'"
TABLES = {
    "results": f"SELECT {COHORT.format('c_custkey')} AS cohort, c_custkey AS entity, CASE WHEN c_custkey % 40 = 1 THEN 11 ELSE 12 END AS ranking_version FROM customer WHERE c_custkey % 38 <> 2",
    "assignments": f"SELECT {COHORT.format('c_custkey')} AS cohort, c_custkey AS entity FROM customer WHERE c_custkey % 46 <> 3",
    "candidates": f"SELECT {COHORT.format('o_custkey')} AS cohort, o_custkey AS entity, o_orderkey AS candidate FROM orders UNION ALL SELECT 'c', o_custkey, o_orderkey FROM orders WHERE o_custkey % 4 > 1 AND o_orderkey % 101 = 0",
    "selections": f"SELECT {COHORT.format('o_custkey')} AS cohort, o_custkey AS entity, CASE WHEN o_orderkey % 2 = 0 THEN 'icon' ELSE 'wide' END AS role, CASE WHEN o_orderkey % 30 <> 5 THEN CASE WHEN o_custkey % 4 = 3 AND o_orderkey % 67 = 1 THEN -o_orderkey ELSE o_orderkey END END AS candidate FROM orders WHERE o_orderkey % 5 = 0",
    "labels": f"""SELECT {COHORT.format('o_custkey')} AS cohort, o_custkey AS entity, CASE WHEN o_custkey % 4 = 1 AND o_orderkey % 89 = 0 THEN o_orderkey + 1 ELSE o_orderkey END AS candidate, CAST(NULL AS STRING) AS role, CASE WHEN o_orderkey % 3 = 0 THEN 'wrong' ELSE 'correct' END AS identity, CASE WHEN o_custkey % 4 > 1 AND o_orderkey % 59 = 0 THEN 'unclassified_negative' ELSE 'not_logo' END AS safety_class,
  CASE WHEN o_custkey % 4 > 1 AND o_orderkey % 61 = 0 THEN 'sha256:x' ELSE {SHA.format(HEX)} END AS fingerprint, CASE WHEN o_orderkey % 3 = 0 THEN 'visual-label-safety-v1-exhaustive-negatives' END AS safety_prompt, CASE WHEN o_custkey % 4 = 1 AND o_orderkey % 51 = 0 THEN 'sha256:' ELSE {SHA.format(HEX)} END AS safety_fingerprint FROM orders WHERE NOT (o_custkey % 4 > 1 AND o_orderkey % 70 = 0)
UNION ALL SELECT 'c', o_custkey, o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'icon' ELSE 'wide' END, 'correct', 'not_logo', NULL, NULL, NULL FROM orders WHERE o_custkey % 4 > 1 AND o_orderkey % 35 = 0""",
}
GATES_SQL = ", ".join(f"{n} AS ({q.replace('STRING', 'VARCHAR')})" for n, q in TABLES.items())


@query(f"""
WITH {GATES_SQL},
k AS (SELECT cohort, entity, candidate, count(*) AS c FROM candidates GROUP BY ALL), canon AS (SELECT * FROM labels WHERE role IS NULL), roled AS (SELECT * FROM labels WHERE role IS NOT NULL), sel AS (SELECT * FROM selections WHERE candidate IS NOT NULL),
co AS (SELECT unnest(['a', 'b', 'c']) AS cohort),
n AS (SELECT cohort, (SELECT count(*) FROM results r WHERE r.cohort = co.cohort) AS results, (SELECT count(*) FROM results r WHERE r.cohort = co.cohort AND EXISTS (SELECT 1 FROM assignments a WHERE a.cohort = r.cohort AND a.entity = r.entity)) AS results_assigned,
 (SELECT count(*) FROM assignments a WHERE a.cohort = co.cohort) AS assigned, (SELECT count(*) FROM assignments a WHERE a.cohort = co.cohort AND EXISTS (SELECT 1 FROM results r WHERE a.cohort = r.cohort AND a.entity = r.entity)) AS answered, (SELECT count(*) FROM results r WHERE r.cohort = co.cohort AND ranking_version = 12) AS current,
 (SELECT count(*) FROM k WHERE k.cohort = co.cohort) AS n_keys, (SELECT coalesce(sum(c), 0) FROM k WHERE k.cohort = co.cohort) AS n_candidates, (SELECT count(*) FROM labels l WHERE l.cohort = co.cohort) AS n_all, (SELECT count(*) FROM labels l JOIN k USING (cohort, entity, candidate) WHERE l.cohort = co.cohort) AS labels_there,
 (SELECT count(*) FROM canon l WHERE l.cohort = co.cohort) AS n_labels, (SELECT count(DISTINCT (entity, candidate)) FROM canon l WHERE l.cohort = co.cohort) AS n_label_keys, (SELECT count(*) FROM roled l WHERE l.cohort = co.cohort) AS n_roled, (SELECT count(DISTINCT (entity, candidate, role)) FROM roled l WHERE l.cohort = co.cohort) AS role_keys,
 (SELECT count(*) FROM sel s WHERE s.cohort = co.cohort) AS n_selected, (SELECT count(*) FROM sel s JOIN k USING (cohort, entity, candidate) WHERE s.cohort = co.cohort) AS selected_there,
 (SELECT count(*) FROM sel s WHERE s.cohort = co.cohort AND EXISTS (SELECT 1 FROM labels l WHERE l.cohort = s.cohort AND l.entity = s.entity AND l.candidate = s.candidate AND coalesce(l.role, s.role) = s.role)) AS slots_labelled,
 (SELECT count(*) FROM sel s WHERE s.cohort = co.cohort AND EXISTS (SELECT 1 FROM canon l WHERE l.cohort = s.cohort AND l.entity = s.entity AND l.candidate = s.candidate)) AS selected_canonical,
 (SELECT count(*) FROM k WHERE k.cohort = co.cohort AND EXISTS (SELECT 1 FROM canon l WHERE l.cohort = k.cohort AND l.entity = k.entity AND l.candidate = k.candidate)) AS labelled, (SELECT count(*) FROM canon l WHERE l.cohort = co.cohort AND length(fingerprint) = 71) AS fp, (SELECT count(*) FROM canon l WHERE l.cohort = co.cohort AND safety_class <> 'unclassified_negative') AS safe,
 (SELECT count(*) FROM canon l WHERE l.cohort = co.cohort AND identity = 'wrong') AS neg, (SELECT count(*) FROM canon l WHERE l.cohort = co.cohort AND identity = 'wrong' AND safety_prompt IS NOT NULL AND length(safety_fingerprint) = 71 AND safety_fingerprint = fingerprint) AS neg_ok FROM co),
g AS (SELECT cohort, unnest([{{g: 'results_assigned', f: results_assigned, e: results}}, {{g: 'assignments_answered', f: answered, e: assigned}}, {{g: 'candidates_once', f: n_keys, e: n_candidates}}, {{g: 'labels_of_candidates', f: labels_there, e: n_all}}, {{g: 'canonical_labels_once', f: n_label_keys, e: n_labels}}, {{g: 'role_labels_once', f: role_keys, e: n_roled}}, {{g: 'selections_of_candidates', f: selected_there, e: n_selected}},
 {{g: 'selected_slots_labelled', f: slots_labelled, e: n_selected}}, {{g: 'candidates_labelled', f: labelled, e: n_keys}}, {{g: 'labels_fingerprinted', f: fp, e: n_labels}}, {{g: 'labels_with_concrete_safety', f: safe, e: n_labels}}, {{g: 'negatives_reviewed', f: neg_ok, e: neg}}, {{g: 'selected_slots_canonical', f: selected_canonical, e: n_selected}}, {{g: 'results_of_current_ranking', f: current, e: results}}]) AS x FROM n),
h AS (SELECT cohort, x.g AS gate, CAST(x.f AS BIGINT) AS found, CAST(x.e AS BIGINT) AS expected, x.f = x.e AS passed FROM g),
v AS (SELECT cohort, 'selected_slot_score' AS gate, count(*) FILTER (passed AND gate IN ('results_assigned', 'assignments_answered', 'candidates_once', 'labels_of_candidates', 'canonical_labels_once', 'role_labels_once', 'selections_of_candidates', 'selected_slots_labelled')) + CAST(bool_and(passed OR gate NOT IN ('candidates_labelled', 'selected_slots_canonical')) AS INT) AS f, 9 AS e FROM h GROUP BY 1
 UNION ALL SELECT cohort, 'exhaustive_surface', count(*) FILTER (passed AND gate NOT IN ('selected_slots_labelled', 'results_of_current_ranking')), 12 FROM h GROUP BY 1 UNION ALL SELECT cohort, 'runtime_replay', count(*) FILTER (passed AND gate <> 'selected_slots_labelled'), 13 FROM h GROUP BY 1)
SELECT * FROM h UNION ALL SELECT cohort, gate, CAST(f AS BIGINT), CAST(e AS BIGINT), f = e FROM v""")
def qualification_gates(spark, sf):
    base = {n: t(spark, sf, n) for n in ("customer", "orders")}
    told = {n: spark.sql(q.replace("FROM customer", "FROM {customer}").replace("FROM orders", "FROM {orders}"), **{k: v for k, v in base.items() if f"FROM {k}" in q}) for n, q in TABLES.items()}
    return gates.gates(**told, current_version=12)


@query("""WITH a AS (SELECT DISTINCT user_id AS entity FROM events WHERE user_id % 9 <> 0), s AS (SELECT user_id AS entity, event_type AS stage, bool_or(value >= 10) AS done, count(*) AS n FROM events GROUP BY 1, 2), w AS (SELECT unnest(['view', 'click', 'purchase', 'audit']) AS stage)
SELECT w.stage, (SELECT count(*) FROM a) AS assigned, (SELECT count(*) FROM a JOIN s USING (entity) WHERE s.stage = w.stage AND done) AS complete, (SELECT count(*) FROM a) - (SELECT count(*) FROM a JOIN s USING (entity) WHERE s.stage = w.stage AND done) AS missing, CAST((SELECT coalesce(sum(n), 0) FROM s WHERE s.stage = w.stage AND entity NOT IN (SELECT entity FROM a)) AS BIGINT) AS unknown,
(SELECT count(*) FROM a) = (SELECT count(*) FROM a JOIN s USING (entity) WHERE s.stage = w.stage AND done) AND NOT EXISTS (SELECT 1 FROM s WHERE s.stage = w.stage AND entity NOT IN (SELECT entity FROM a)) AS passed FROM w""")
def stage_coverage(spark, sf):
    e = t(spark, sf, "events")
    stages = e.select(F.col("user_id").alias("entity"), F.col("event_type").alias("stage"), F.when(F.col("value") >= 10, "complete").otherwise("open").alias("status"))
    return gates.stage_coverage(e.filter("user_id % 9 <> 0").select(F.col("user_id").alias("entity")), stages, ["view", "click", "purchase", "audit"])


#: What was seen on a supplier's pages: lines in order of their orders.
SEEN = {
    "entity": "l_suppkey",
    "at": "l_orderkey * 8 + l_linenumber",
    "kind": "CASE l_partkey % 5 WHEN 0 THEN 'inline-svg' WHEN 1 THEN 'img' ELSE 'external' END",
    "url": "CASE l_partkey % 7 WHEN 0 THEN 'ftp://x.example/' || l_partkey % 3 WHEN 1 THEN NULL ELSE 'HTTPS://x.example/' || l_partkey % 11 END",
    "inline_svg": "CASE WHEN l_partkey % 5 = 0 THEN '<svg>' || l_partkey % 4 END",
    "css_background": "CASE WHEN l_partkey % 6 = 0 THEN '{}' END",
    "evidence": "'e' || l_orderkey || '-' || l_linenumber || '-' || l_partkey",
}
SEEN_SQL = f"""s AS (SELECT {', '.join(f'{v} AS "{k}"' for k, v in SEEN.items())} FROM lineitem),
k AS (SELECT *, CASE WHEN kind = 'inline-svg' THEN 'svg:' || inline_svg ELSE 'url:' || coalesce(url, '') || ':' || coalesce(css_background, 'null') END AS asset FROM s WHERE kind <> 'external' OR coalesce(url ILIKE 'http%', false)),
r AS (SELECT *, row_number() OVER (PARTITION BY entity, asset ORDER BY "at", evidence) - 1 AS place, min("at") OVER (PARTITION BY entity, asset) AS first FROM k)"""


def observed(spark, sf):
    rows = t(spark, sf, "lineitem").select(*(F.expr(v).alias(k) for k, v in SEEN.items()))
    return dedupe.merge_rendered(rows, ["entity"], "at", block=512)


@query(f'WITH {SEEN_SQL} SELECT entity, "at", kind, url, inline_svg, css_background, evidence FROM r WHERE place = 0')
def rendered_survivors(spark, sf):
    return observed(spark, sf)[0]


@query(f'WITH {SEEN_SQL} SELECT entity, first AS "at", place, evidence FROM r')
def rendered_evidence(spark, sf):
    return observed(spark, sf)[1]


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[a-z0-9]+') AS w FROM documents), l AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: i = 1 OR w[i] NOT IN ('ag', 'co', 'company', 'corp', 'corporation', 'gmbh', 'inc', 'incorporated', 'ltd', 'limited', 'llc', 'plc')) AS kept FROM w)
SELECT doc_id, array_to_string(w[1:coalesce(list_max(kept), 0)], ' ') AS name FROM l""")
def folded_names(spark, sf):
    return t(spark, sf, "documents").select("doc_id", normalized_name(F.col("text")).alias("name"))
