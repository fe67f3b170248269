"""The whole pick of an icon, on the candidates' stand-in scored as before; the decision is written twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from querncore.functions import scoring
from querncore.operators import frozen, icons
from querncore.plans.candidates import EDGE, EFFECTIVE, SCORED, dealt, in_spark, scored
from querncore.plans.catalogue import query

#: A candidate's number serves as its entity's place too: lines of one number are told apart by supplier and part.
MORE = {
    "file": dealt(2, ["app_icon.png", "logo.svg", "Application-Icon-1.png", "x/appicon", "icon_app.png", "app%5Ficon.png"]),
    "bytes": "k % 97",
    "family": "k % 4",
    "manifest_agrees": "k % 33 = 0",
}
POINTS = "CASE WHEN theme = 'dark' THEN 2 WHEN theme = 'any' THEN 1 WHEN coalesce(theme, 'unknown') <> 'unknown' THEN -2 ELSE 0 END"
UNFIT = "foreground_occupancy < 0.015 OR box_occupancy < 0.08 OR (canvas_background = 'transparent' AND {}) "
DECLARED = "('manifest', 'apple', 'mask-icon', 'ms-tile', 'html-icon', 'google-favicon', 'duckduckgo-favicon', 'root-favicon')"
IMAGES = "('dom-img', 'dom-picture', 'browser-img')"
OF_K = MORE["file"].replace("(l_orderkey * 10 + l_linenumber)", "k")
RANK = f"CASE WHEN {EDGE} <= 64 THEN 40 WHEN {EDGE} <= 128 THEN 25 WHEN {EDGE} <= 256 THEN 10 ELSE 0 END + 0.6 * coalesce(suitability, 0) + CASE WHEN is_icon THEN 8 ELSE 0 END + CASE WHEN source = 'html-icon' THEN 1 ELSE 0 END + CAST(0.01 AS DOUBLE) * favicon_score"
ORDER = "padded, points DESC, effective DESC, bytes DESC, score DESC, bytes DESC, id"


@query(rf"""{SCORED},
u AS (SELECT DISTINCT ON (k) k AS id, k // 10 AS entity, * EXCLUDE (entity), k % 97 AS bytes, k % 4 AS family, k % 33 = 0 AS manifest_agrees, replace({OF_K}, '%5F', '_') AS file, greatest(icon_score, wide_score, favicon_score) AS score, coalesce(content >= 1.8 AND ratio < 1.8, false) AS padded, {POINTS} AS points, {EFFECTIVE} AS effective, CAST({RANK} AS DOUBLE) AS frank,
  NOT coalesce({UNFIT.format("coalesce(contrast_dark, 0) < 0.08")}, false) AS usable, NOT coalesce({UNFIT.format("greatest(coalesce(contrast_light, 0), coalesce(contrast_dark, 0)) < 0.08")}, false) AS fit FROM p),
x AS (SELECT *, is_icon AND usable AND source <> 'social-banner' AS able, home OR exact_company_label OR source IN ('schema', 'og-logo', 'microdata') AS corporate, source IN {IMAGES} AND bar AND (positive_token OR agrees_with_company OR exact_company_label) AS mark, exact_company_label OR agrees_with_company OR manifest_agrees AS named FROM u),
y AS (SELECT *, is_icon AND fit AND (corporate OR mark) AS support, source IN {DECLARED} AND NOT home AND NOT exact_company_label AND regexp_matches(lower(string_split(file, '/')[-1]), '^(app|application)[-_]?(ico|icon)([-_.]|$)') AS app FROM x),
w1 AS (SELECT DISTINCT ON (entity) * FROM y WHERE able ORDER BY entity, {ORDER}),
d AS (SELECT DISTINCT ON (entity) * FROM y WHERE able AND source IN {DECLARED} AND icon_score >= 49 ORDER BY entity, {ORDER}),
f AS (SELECT DISTINCT ON (entity) entity, id FROM y WHERE is_favicon AND usable AND source <> 'social-banner' AND (source <> 'bimi' OR coalesce(content < 1.8 AND square, false)) AND {EDGE} >= 14 ORDER BY entity, frank DESC, bytes DESC, score DESC, bytes DESC, id),
s1 AS (SELECT e.entity, w1.id AS w, d.id AS d, CASE WHEN w1.source IN {IMAGES} AND NOT w1.home AND d.id IS NOT NULL THEN CASE WHEN NOT w1.mark OR d.named OR EXISTS (SELECT 1 FROM y WHERE y.entity = d.entity AND y.family = d.family AND y.id <> d.id AND y.support) THEN 'declared-icon-displaced-page-mark' ELSE 'declared-icon-abstained' END WHEN w1.id IS NOT NULL THEN 'ranked' ELSE 'none' END AS act, w1.mark FROM (SELECT DISTINCT entity FROM y) e LEFT JOIN w1 USING (entity) LEFT JOIN d USING (entity)),
v AS (SELECT s1.*, y.id AS v, y.source, y.width AS vw, y.height AS vh, y.effective FROM s1 LEFT JOIN y ON y.entity = s1.entity AND y.id = CASE WHEN act = 'declared-icon-displaced-page-mark' THEN d ELSE w END),
t AS (SELECT DISTINCT ON (v.entity) v.entity, y.id AS t, y.effective AS te FROM v JOIN y ON y.entity = v.entity WHERE v.source = 'inline-svg' AND y.source = 'browser-inline-svg' AND y.is_icon AND y.usable AND y.generic_reason IS NULL
  AND abs(coalesce(y.width, 0) - coalesce(vw, 0)) <= greatest(4.0, CAST(0.12 AS DOUBLE) * greatest(coalesce(y.width, 0), coalesce(vw, 0))) AND abs(coalesce(y.height, 0) - coalesce(vh, 0)) <= greatest(4.0, CAST(0.12 AS DOUBLE) * greatest(coalesce(y.height, 0), coalesce(vh, 0))) ORDER BY v.entity, y.score DESC, y.bytes DESC, y.id),
z AS (SELECT v.*, t.t, coalesce(te >= effective - 5, false) AS turned FROM v LEFT JOIN t USING (entity)),
q1 AS (SELECT z.entity, w, d, z.v, act, z.mark AS wmark, turned, y.id AS x, coalesce(y.app AND NOT EXISTS (SELECT 1 FROM y o WHERE o.entity = y.entity AND o.id <> y.id AND o.corporate AND (o.family = y.family OR o.is_icon)), false) AS alone FROM z LEFT JOIN y ON y.entity = z.entity AND y.id = CASE WHEN turned THEN z.t ELSE z.v END)
SELECT q1.entity, CASE WHEN alone THEN NULL WHEN x IS NULL THEN f.id ELSE x END AS winner, CASE WHEN alone THEN 'icon-abstained' WHEN x IS NULL AND f.id IS NOT NULL THEN 'favicon-fallback-selected' WHEN turned THEN 'rendered-twin-selected' ELSE act END AS action,
CASE WHEN alone THEN 'uncorroborated-generic-application-icon' WHEN x IS NULL AND f.id IS NOT NULL THEN 'no-qualified-icon' WHEN turned THEN 'rendered-inline-svg-corroboration' WHEN act = 'ranked' THEN 'highest-effective-score' WHEN act = 'declared-icon-abstained' THEN 'declared-icon-lacks-corroboration' WHEN act LIKE 'declared%' THEN CASE WHEN wmark THEN 'declared-icon-corroborated' ELSE 'page-mark-not-corroborated' END END AS reason,
CASE WHEN alone THEN x WHEN x IS NULL THEN NULL WHEN turned THEN v WHEN act = 'declared-icon-displaced-page-mark' THEN w WHEN act = 'declared-icon-abstained' THEN d END AS other FROM q1 LEFT JOIN f USING (entity)""")
def icon_pick(spark, sf):
    rows = scored(spark, sf, once=True).withColumn("id", F.col("k")).withColumn("entity", F.expr("k div 10"))
    s, roles = F.col("role_scores"), F.col("predicted_roles")
    rows = rows.withColumns({n: F.expr(in_spark(v).replace("(l_orderkey * 10 + l_linenumber)", "k")) for n, v in MORE.items()})
    rows = rows.withColumns(
        {
            "url": F.concat(F.lit("https://x.example/i/"), "file"), "resolved_url": F.lit(None).cast("string"), "score": F.greatest(s["icon"], s["wide"], s["favicon"]),
            "padded_wordmark": F.coalesce((scoring.content_ratio() >= 1.8) & (scoring.ratio() < 1.8), F.lit(False)), "points": scoring.preference_score({"theme": "dark"}), "effective": scoring.icon_effective(), "favicon_rank": scoring.favicon_rank(),
            "usable": F.size(scoring.icon_rejections("dark")) == 0, "rejected": scoring.icon_rejections(), "bimi_shape_ok": (F.col("source") != "bimi") | F.coalesce((scoring.content_ratio() < 1.8) & scoring.square(), F.lit(False)),
        }
    )
    return icons.pick_icons(rows)


#: The same candidates by role, for replays: all in the role wide, the others where predicted.
REPLAY = f"""{SCORED},
u AS (SELECT DISTINCT ON (k) *, k // 10 AS e, k % 13 AS place, CAST({RANK} AS DOUBLE) AS frank, CASE WHEN k % 5 = 0 THEN 'foreign named logo' ELSE generic_reason END AS why, k % 3 <> 1 AS here, k % 6 < 2 AS both_themes FROM p),
x AS (SELECT e AS entity, 'icon' AS role, k AS candidate, icon_score AS score, place, source, home, bar, positive_token, agrees_with_company, false AS back, both_themes FROM u WHERE is_icon UNION ALL SELECT e, 'favicon', k, frank, place, source, home, bar, positive_token, agrees_with_company, false, both_themes FROM u WHERE is_favicon
  UNION ALL SELECT e, 'wide', k, wide_score, place, source, home, bar, positive_token, agrees_with_company, coalesce(here AND positive_token AND bar AND why = 'foreign named logo' AND ratio BETWEEN 1.8 AND 12, false) AS back, both_themes FROM u WHERE is_wide OR coalesce(here AND positive_token AND bar AND why = 'foreign named logo' AND ratio BETWEEN 1.8 AND 12, false)),
y AS (SELECT *, score + CASE WHEN back THEN 100 ELSE 0 END - CASE WHEN role = 'icon' AND source IN ('manifest', 'apple', 'mask-icon', 'ms-tile', 'html-icon', 'besticon', 'google-favicon', 'duckduckgo-favicon', 'root-favicon') AND NOT home AND NOT (positive_token AND bar) AND NOT agrees_with_company THEN 10 ELSE 0 END AS effective FROM x),
z AS (SELECT *, CASE WHEN role = 'wide' AND effective >= max(effective) OVER (PARTITION BY entity, role) - 4 THEN CASE WHEN both_themes THEN 0 ELSE 1 END ELSE 2 END AS tier FROM y)"""


@query(f"{REPLAY} SELECT DISTINCT ON (entity, role) entity, role, candidate, effective FROM z ORDER BY entity, role, tier, effective DESC, place")
def profile_winners(spark, sf):
    rows = scored(spark, sf, once=True).withColumn("favicon_rank", scoring.favicon_rank())
    s, roles = F.col("role_scores"), F.col("predicted_roles")
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("role"), s[r].alias("score"), F.array_contains(roles, r).alias("predicted")) for r in ("icon", "wide", "favicon"))))
    own = F.concat(F.lit("https://www.a"), F.col("k").cast("string"), F.lit(".example/x.png"))
    rows = rows.select(
        F.expr("k div 10").alias("entity"), F.col("k").alias("candidate"), (F.col("k") % 13).alias("place"), "source", "favicon_rank", "home_linked", "dom_region", "positive_token", "agrees_with_company", "width", "height", own.alias("url"), each.alias("x"),
        F.when(F.col("k") % 3 == 1, "https://other.example/").otherwise(F.replace(own, F.lit("www."), F.lit(""))).alias("source_url"), F.when(F.col("k") % 5 == 0, "foreign named logo").otherwise(F.col("generic_reason")).alias("generic_reason"), F.when(F.col("k") % 6 < 2, F.array(F.lit("dark"), F.lit("light"))).alias("themes"),
    ).select("*", "x.*").drop("x")
    return frozen.winners(rows, ["favicon-tiny-v1", "icon-evidence-v1", "wide-theme-v1", "wide-header-recovery-v1"])
