"""Queries over selections and captured instances, on the candidates' stand-in; features are dealt alike for both engines, rules are written twice."""

from __future__ import annotations

from pyspark.sql import functions as F

from querncore.functions import capture, scoring
from querncore.functions.columns import settled
from querncore.operators import ranking, sampling, selection
from querncore.plans.candidates import EFFECTIVE, SCORED, C, K, candidates, dealt, of_lines, scored
from querncore.plans.catalogue import query, t


def lines(spark, sf, **features):
    """Lines with features, as ``told`` has them in SQL."""
    return of_lines(spark, sf, {"k": K, "entity": "l_suppkey", **features})


def told(**features) -> str:
    return f"(SELECT {K} AS k, l_suppkey AS entity, " + ", ".join(f"{v} AS {n}" for n, v in features.items()) + " FROM lineitem)"


ROLES = ["icon", "wide", "favicon"]
LABEL = {
    "identity": dealt(1, ["correct", "wrong", "ambiguous", "correct", "unknown"]),
    "roles_text": dealt(2, ["icon", "wide", "icon,wide", "", "favicon", "icon,favicon"]),
    "usability_light": dealt(3, ["good", "conditional", "unusable", None]),
    "usability_dark": dealt(4, ["good", "unusable", "conditional"], 1),
    "slot": dealt(7, ROLES),
    "role": dealt(2, ROLES, 1),
}
PICKED = f"""c AS (SELECT *, list_filter(string_split(roles_text, ','), lambda x: x <> '') AS roles FROM {told(**LABEL)}), l AS (SELECT * FROM c WHERE k % 4 <> 3),
sel AS (SELECT entity, slot AS role, min(k) AS k FROM c WHERE k % 5 = 1 AND NOT (slot = 'wide' AND entity % 3 = 0) GROUP BY 1, 2),
slots AS (SELECT DISTINCT entity, unnest(['icon', 'wide', 'favicon']) AS role FROM c),
o AS (SELECT slots.entity, slots.role, sel.k, l.identity, coalesce(l.identity = 'correct' AND list_contains(l.roles, slots.role), false) AS correct, l.usability_light, l.usability_dark
  FROM slots LEFT JOIN sel ON sel.entity = slots.entity AND sel.role = slots.role LEFT JOIN l ON l.entity = slots.entity AND l.k = sel.k)"""


def picked(spark, sf):
    """(candidates, labels, selections)"""
    c = lines(spark, sf, **LABEL).withColumn("roles", F.filter(F.split("roles_text", ","), lambda x: x != ""))
    sel = c.filter("k % 5 = 1 and not (slot = 'wide' and entity % 3 = 0)").groupBy("entity", F.col("slot").alias("role")).agg(F.min("k").alias("k"))
    return c, c.filter("k % 4 <> 3"), sel


def answered(spark, sf):
    c, labels, sel = picked(spark, sf)
    labels = labels.select("entity", "k", "identity", "roles", "usability_light", "usability_dark")
    return c, labels, selection.outcomes(c, sel, labels, "entity", "k", ROLES)


@query(f"WITH {PICKED} SELECT entity, role, k, identity, CASE WHEN k IS NULL THEN 'no_selection' WHEN correct THEN 'correct_role' WHEN identity = 'correct' THEN 'correct_brand_wrong_role' WHEN identity = 'ambiguous' THEN 'ambiguous' ELSE 'wrong' END AS outcome FROM o")
def selection_outcomes(spark, sf):
    return answered(spark, sf)[2].select("entity", "role", "k", "identity", "outcome")


@query(f"""WITH {PICKED},
h AS (SELECT c.entity, bool_or(coalesce(l.identity = 'correct' AND len(l.roles) > 0, false)) AS positive, bool_or(coalesce(l.identity = 'correct' AND list_contains(l.roles, 'icon'), false)) AS icon, bool_or(coalesce(l.identity = 'correct' AND list_contains(l.roles, 'wide'), false)) AS wide FROM c LEFT JOIN l ON l.entity = c.entity AND l.k = c.k GROUP BY 1),
g AS (SELECT entity, bool_or(correct) AS correct, bool_or(role <> 'favicon' AND coalesce(identity = 'wrong', false)) AS wrong, count(*) FILTER (role <> 'favicon' AND correct) AS n,
  sum(CASE WHEN role <> 'favicon' AND correct THEN (CASE usability_light WHEN 'good' THEN 1.0 WHEN 'conditional' THEN 0.5 ELSE 0 END + CASE usability_dark WHEN 'good' THEN 1.0 WHEN 'conditional' THEN 0.5 ELSE 0 END) / 2 ELSE 0 END) AS usable FROM o GROUP BY 1),
s AS (SELECT count(*) AS entities, count(*) AS with_candidates, count(*) FILTER (positive) AS with_any_positive, count(*) FILTER (correct) AS correct_domains, count(*) FILTER (wrong) AS wrong_domains, count(*) FILTER (icon) AS icons, count(*) FILTER (wide) AS wides, sum(n) AS n, sum(usable) AS usable FROM h JOIN g USING (entity)),
p AS (SELECT *, 15.0 * icons / entities + 15.0 * wides / entities AS candidate_set_coverage, 15.0 * n / entities AS top1_role_correctness, 10.0 * usable / entities AS visual_usability, 10 * greatest(0.0, 1 - wrong_domains / entities / 0.1) AS wrong_brand_safety FROM s)
SELECT entities, with_candidates, with_any_positive, correct_domains, wrong_domains, round(CAST(candidate_set_coverage AS DOUBLE), 6) AS candidate_set_coverage, round(CAST(top1_role_correctness AS DOUBLE), 6) AS top1_role_correctness, round(CAST(visual_usability AS DOUBLE), 6) AS visual_usability,
round(CAST(wrong_brand_safety AS DOUBLE), 6) AS wrong_brand_safety, round(CAST(candidate_set_coverage + top1_role_correctness + visual_usability + wrong_brand_safety AS DOUBLE), 6) AS total FROM p""")
def population_metrics(spark, sf):
    c, labels, rows = answered(spark, sf)
    out = selection.population(c, c, rows, labels, "entity", "k")
    return out.select("entities", "with_candidates", "with_any_positive", "correct_domains", "wrong_domains", *(F.round(x, 6).alias(x) for x in ("candidate_set_coverage", "top1_role_correctness", "visual_usability", "wrong_brand_safety", "total")))


@query(f"WITH {PICKED} SELECT floor(1000.0 * count(k) / count(*) + 0.5) / 10 AS availability FROM o WHERE role <> 'favicon'")
def availability_proxy(spark, sf):
    return selection.availability(answered(spark, sf)[2], "k")


@query(f"""WITH {PICKED} SELECT count(*) AS selected_slots, count(*) FILTER (NOT EXISTS (SELECT 1 FROM l WHERE l.entity = s.entity AND l.k = s.k AND l.role = s.role)) AS missing_role_slots,
count(DISTINCT (s.entity, s.k)) FILTER (NOT EXISTS (SELECT 1 FROM l WHERE l.entity = s.entity AND l.k = s.k)) AS candidates_without_any_label FROM sel s""")
def label_gap_diagnostic(spark, sf):
    _, labels, sel = picked(spark, sf)
    return selection.label_gaps(sel, labels, "entity", "k")


BOX = {"source": dealt(1, ["dom-picture", "inline-svg", "schema", "css-background", "mask-icon", "manifest", "google-favicon", "apple", "dom-img", "text", None]), "kind": dealt(2, ["image", "text", "mask", "favicon", None]), "x": f"CAST({K} % 300 AS DOUBLE) - 40", "y": f"CAST({K} % 210 AS DOUBLE) - 30.5", "w": f"CAST({K} % 190 AS DOUBLE) / 2", "h": f"CASE WHEN {K} % 13 = 0 THEN NULL ELSE CAST({K} % 71 AS DOUBLE) END", "shown": f"{K} % 17 <> 0", "theme": dealt(3, ["dark", "light", "any"])}


@query(f"""WITH a AS (SELECT *, lower(coalesce(source, '')) AS s, CASE WHEN w > 0 AND h > 0 THEN w / h END AS ratio, least(200.0, greatest(x, 0)) AS l, least(150.0, greatest(y, 0)) AS u FROM {told(**BOX)})
SELECT k, CASE WHEN s LIKE '%picture%' THEN 'picture' WHEN s LIKE '%inline%' THEN 'inline_svg' WHEN s IN ('schema', 'og-logo', 'microdata') THEN 'structured_data' WHEN s LIKE '%background%' THEN 'css_background' WHEN s LIKE '%mask%' THEN 'css_mask' WHEN s = 'manifest' THEN 'manifest'
  WHEN s LIKE '%favicon%' OR s IN ('apple', 'ms-tile', 'html-icon', 'besticon') THEN 'favicon' WHEN s LIKE '%img%' OR s LIKE '%image%' THEN 'img' WHEN s LIKE '%text%' THEN 'text_only' ELSE 'other' END AS source_kind,
CASE WHEN kind = 'text' THEN 'other' WHEN kind = 'mask' THEN 'symbol' WHEN kind = 'favicon' OR s LIKE '%favicon%' THEN 'favicon' WHEN ratio >= 1.8 THEN 'horizontal_lockup' WHEN ratio >= 0.72 AND ratio <= 1.4 THEN 'symbol' ELSE 'other' END AS visual_role,
CASE WHEN NOT shown OR w < 2 OR h < 2 THEN 'unusable' WHEN theme IN ('dark', 'light') THEN 'good' ELSE 'conditional' END AS visibility, l AS x, u AS y, least(200 - l, w) AS width, least(150 - u, coalesce(h, 0)) AS height FROM a""")
def capture_classes(spark, sf):
    c, hundred = F.col, (F.lit(200.0), F.lit(150.0))
    box = capture.clamped_box(c("x"), c("y"), c("w"), c("h"), *hundred)
    rows = lines(spark, sf, **BOX)
    return rows.select("k", capture.source_kind(c("source")).alias("source_kind"), capture.visual_role(c("kind"), c("source"), c("w"), c("h")).alias("visual_role"), capture.visibility(c("shown"), c("w"), c("h"), c("theme")).alias("visibility"), *(box[n].alias(n) for n in ("x", "y", "width", "height")))


@query(f"""WITH {C}, i AS (SELECT k, entity, url, k % 50 AS hash FROM c WHERE k % 6 = 0), d AS (SELECT * FROM c WHERE k % 8 = 1),
u AS (SELECT entity, url, min(k) AS k FROM d GROUP BY 1, 2), x AS (SELECT entity, k % 50 AS hash, min(k) AS k FROM d GROUP BY 1, 2)
SELECT i.k AS instance, coalesce(u.k, x.k) AS candidate, CASE WHEN u.k IS NOT NULL THEN 'exact' WHEN x.k IS NOT NULL THEN 'derived' ELSE 'unmapped' END AS confidence FROM i LEFT JOIN u ON u.entity = i.entity AND u.url = i.url LEFT JOIN x ON x.entity = i.entity AND x.hash = i.hash""")
def instance_candidates(spark, sf):
    rows = candidates(spark, sf).select("k", "entity", "url", (F.col("k") % 50).alias("hash"))
    found = rows.filter("k % 8 = 1").withColumnRenamed("k", "candidate")
    return selection.mapped_instances(rows.filter("k % 6 = 0").withColumnRenamed("k", "instance"), found, ["entity"], "candidate").select("instance", "candidate", "confidence")


TIMES = ["+2019-00-00T00:00:00Z", "+2020-02-00T00:00:00Z", "+2021-02-29T00:00:00Z", "+2024-02-29T00:00:00Z", "2020-01-01", "+0000-01-01T00:00:00Z", None, "+1999-12-31T00:00:00Z", "+2020-13-01T00:00:00Z", "+2024-03-00T00:00:00Z"]
CLAIM = {"start_time": dealt(1, TIMES), "end_time": dealt(3, [None, *TIMES], 5), "p": dealt(2, ["9", "10", "11", "8"]), "rank": dealt(5, ["normal", "preferred", "deprecated", "normal"]), "file": dealt(2, ["File:A_b.svg", "a b.SVG", None, "File:C.png"]), "cause": f"{K} % 23 = 0", "point": f"{K} % 3 = 0"}


def sql_dates(column: str, n: str) -> str:
    part = lambda g: rf"regexp_extract({column}, '^\+(\d{{4}})-(\d{{2}})-(\d{{2}})T', {g})"
    first = f"CASE WHEN p BETWEEN 9 AND 11 AND {part(1)} > '0000' THEN try_cast({part(1)} || '-' || CASE WHEN p >= 10 THEN {part(2)} ELSE '01' END || '-' || CASE WHEN p >= 11 THEN {part(3)} ELSE '01' END AS DATE) END"
    return f"{first} AS {n}_first, CASE p WHEN 9 THEN CAST({first} + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE) WHEN 10 THEN last_day({first}) ELSE {first} END AS {n}_last"


CLAIMS = f"""a AS (SELECT * REPLACE (CAST(p AS INTEGER) AS p) FROM {told(**CLAIM)}), b AS (SELECT *, {sql_dates('start_time', 's')}, {sql_dates('end_time', 'e')} FROM a),
d AS (SELECT *, CASE WHEN rank = 'deprecated' OR file IS NULL THEN 'invalid' WHEN cause THEN 'ended' WHEN (start_time IS NOT NULL AND s_first IS NULL) OR (end_time IS NOT NULL AND e_first IS NULL) THEN 'invalid' WHEN s_first > DATE '2020-02-15' THEN 'future' WHEN e_last < DATE '2020-02-15' THEN 'ended'
  WHEN point AND s_first IS NULL AND e_first IS NULL THEN 'historical_point_in_time' ELSE 'current' END AS disposition FROM b)"""


@query(f"WITH {CLAIMS} SELECT k, CAST(s_first AS VARCHAR) AS s_first, CAST(s_last AS VARCHAR) AS s_last, disposition FROM d")
def claim_dispositions(spark, sf):
    c = F.col
    p = c("p").cast("int")
    rows = settled(lines(spark, sf, **CLAIM).withColumn("start", capture.precision_interval(c("start_time"), p)).withColumn("end", capture.precision_interval(c("end_time"), p)))
    out = capture.claim_disposition(c("rank"), c("file"), c("cause"), c("start"), c("end"), c("start_time").isNotNull(), c("end_time").isNotNull(), c("point"), F.to_date(F.lit("2020-02-15")))
    return rows.select("k", c("start")["first"].cast("string").alias("s_first"), c("start")["last"].cast("string").alias("s_last"), out.alias("disposition"))


@query(f"""{SCORED}, x AS (SELECT *, k % 3 = 0 AS padded, k % 97 AS bytes, CASE WHEN theme = 'dark' THEN 2 WHEN theme = 'any' THEN 1 WHEN coalesce(theme, 'unknown') <> 'unknown' THEN -2 ELSE 0 END + CASE WHEN color = 'white' THEN 2 WHEN color = 'any' THEN 1 WHEN coalesce(color, 'unknown') <> 'unknown' THEN -2 ELSE 0 END AS points FROM p)
SELECT entity, 'icon' AS role, k FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY padded, points DESC, {EFFECTIVE} DESC, bytes DESC, k) AS place FROM x WHERE is_icon) WHERE place = 1
UNION ALL SELECT entity, 'wide', k FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY points DESC, wide_score DESC, bytes DESC, k) AS place FROM x WHERE is_wide) WHERE place = 1""")
def role_comparator(spark, sf):
    rows = scored(spark, sf).withColumn("role", F.explode(F.array_intersect("predicted_roles", F.array(F.lit("icon"), F.lit("wide")))))
    icon = F.col("role") == "icon"  # both roles in one pass: padded wordmarks are last among icons alone
    rows = rows.withColumn("padded_wordmark", icon & (F.col("k") % 3 == 0)).withColumn("bytes", F.col("k") % 97)
    points = scoring.preference_score({"theme": "dark", "color": "white", "background": "any"})
    score = F.when(icon, scoring.icon_effective()).otherwise(F.col("role_scores")["wide"])
    return ranking.top(rows, ["entity", "role"], selection.role_order("icon", points, score, "k")).select("entity", "role", "k")


@query(f"""{SCORED} SELECT a.k, min(b.k) AS sibling FROM p a JOIN p b ON a.entity = b.entity AND a.theme = b.theme AND a.color = b.color AND a.k % 4 = b.k % 4 AND a.k <> b.k AND abs(b.width / b.height / (a.width / a.height) - 1) <= 0.01
WHERE a.k % 10 = 3 AND a.theme <> 'unknown' AND a.color <> 'unknown' AND a.width >= 1 AND a.height >= 1 AND b.background = 'transparent' AND b.width > 0 AND b.height > 0 AND CASE WHEN a.k % 3 = 0 THEN b.is_wide ELSE b.is_icon END GROUP BY a.k""")
def transparent_sibling(spark, sf):
    rows = scored(spark, sf).withColumn("family", F.col("k") % 4)
    chosen = candidates(spark, sf).withColumn("family", F.col("k") % 4).filter("k % 10 = 3").withColumn("role", F.when(F.col("k") % 3 == 0, "wide").otherwise("icon"))
    return selection.transparent_siblings(chosen, rows, ["entity", "family"], "k")


@query(f"WITH {C}, u AS (SELECT *, CASE WHEN source IN ('schema', 'og-logo', 'microdata') THEN 100 ELSE 0 END + CASE WHEN home_linked THEN 80 ELSE 0 END + CASE WHEN dom_region IN ('header', 'nav') THEN 60 ELSE 0 END + CASE WHEN positive_token THEN 40 ELSE 0 END AS priority FROM c), once AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY entity, url ORDER BY priority DESC, k) = 1) SELECT entity, url, k, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY priority DESC, url) AS rank FROM once) WHERE rank <= 3")
def unique_by_priority_limit(spark, sf):
    rows = candidates(spark, sf).withColumn("priority", scoring.candidate_priority())
    return selection.unique_by_priority(rows, ["entity"], "url", "priority", "k", 3).select("entity", "url", "k", "rank")


@query(f"WITH {C} SELECT entity, source, k % 7 AS hash, max(k) AS snapshot, arg_max(url, k) AS url FROM c GROUP BY 1, 2, 3")
def latest_snapshot_wins(spark, sf):
    rows = candidates(spark, sf).select("entity", "source", (F.col("k") % 7).alias("hash"), F.col("k").alias("snapshot"), "url")
    return selection.latest_snapshot(rows, ["entity", "source", "hash"], "snapshot")


@query("SELECT o_orderkey, CAST((n - 1) // 4 + 1 AS INTEGER) AS chunk_index, CAST((total - 1) // 4 + 1 AS INTEGER) AS chunk_count FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders)")
def chunk_numbers(spark, sf):
    return selection.chunked(t(spark, sf, "orders"), ["o_custkey"], [F.asc("o_orderkey")], 4).select("o_orderkey", "chunk_index", "chunk_count")


@query(f"WITH {C} SELECT entity, k FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY width * height, k % 3 DESC, length(source) DESC, k) AS place FROM c WHERE width IS NOT NULL) WHERE place = 1")
def smallest_descendant(spark, sf):
    rows = candidates(spark, sf).filter("width is not null").withColumn("strength", F.col("k") % 3)
    return selection.smallest_descendant(rows, ["entity"], F.col("width") * F.col("height"), "strength", "source", "k").select("entity", "k")


COST = {"variant": dealt(1, ["a", "b", "c"]), "proposal": dealt(2, ["x", None, "y"]), "verdict": f"CASE WHEN {dealt(2, ['x', None, 'y'])} IS NOT NULL AND NOT ({dealt(1, ['a', 'b', 'c'])} = 'b' AND {K} % 5 = 0) THEN {dealt(3, ['correct', 'wrong_brand', 'correct', 'ambiguous', 'not_logo', 'related_brand'])} END", "requests": f"{K} % 9", "bytes": f"{K} % 5003", "latency_ms": f"{K} % 997"}


@query(f"""SELECT variant, count(*) AS audited_misses, count(proposal) AS answered, count(proposal) / count(*) AS answer_rate, count(verdict) AS reviewed, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'wrong_brand') AS wrong_brand, count(*) FILTER (verdict = 'related_brand') AS related_brand,
count(*) FILTER (verdict = 'not_logo') AS not_logo, count(*) FILTER (verdict = 'ambiguous') AS ambiguous, CASE WHEN count(verdict) = count(proposal) THEN count(*) FILTER (verdict = 'correct') / count(proposal) END AS strict_precision, CASE WHEN count(verdict) = count(proposal) THEN 100 * count(*) FILTER (verdict = 'correct') / count(*) END AS correct_gains_per_100,
CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(floor(sum(latency_ms) / count(*) + 0.5) AS BIGINT) AS mean_latency_ms, quantile_disc(latency_ms, 0.5) AS p50_latency_ms, quantile_disc(latency_ms, 0.95) AS p95_latency_ms, max(requests) AS max_requests, max(bytes) AS max_bytes, max(latency_ms) AS max_latency_ms FROM {told(**COST)} GROUP BY 1""")
def variant_cost_summary(spark, sf):
    return selection.variant_costs(lines(spark, sf, **COST), "variant")


@query("SELECT l_returnflag, l_linestatus, l_suppkey, count(*) AS n, coalesce(round(avg(CASE WHEN l_linenumber > 2 THEN CAST(l_linenumber AS DOUBLE) END), 9), 0) AS place, max(l_linenumber) AS highest FROM lineitem GROUP BY 1, 2, 3")
def grouped_means(spark, sf):
    rows = t(spark, sf, "lineitem").withColumn("place", F.expr("CASE WHEN l_linenumber > 2 THEN CAST(l_linenumber AS DOUBLE) END")).withColumn("highest", F.col("l_linenumber"))
    return selection.grouped_means(rows, ["l_returnflag", "l_linestatus", "l_suppkey"], ["place"], ["highest"]).withColumn("place", F.round("place", 9))


@query("SELECT c_custkey FROM customer ORDER BY sha256('controls-v1:' || c_name), c_name LIMIT 40")
def deterministic_controls(spark, sf):
    return selection.controls(t(spark, sf, "customer"), "c_name", "controls-v1", 40).select("c_custkey")


FORMS = {"label": dealt(1, ["navBarLogo", "siteHeader topNav", "ABC", "x1Y", None]), "path": dealt(2, ["/a%20b+c", "/%E2%82%AC", "/plain", None]), "data": dealt(3, ["data:image/png;base64,iVBORw==", "https://x.example/y.png", "data:text/plain,abc", None])}


@query(rf"SELECT k, regexp_replace(label, '([a-z])([A-Z])', '\1 \2', 'g') AS words, url_decode(path) AS path, CASE WHEN data LIKE 'data:%;base64,%' THEN lower(hex(from_base64(regexp_extract(data, ';base64,(.*)$', 1)))) END AS bytes FROM {told(**FORMS)}")
def text_forms(spark, sf):
    c = F.col
    return lines(spark, sf, **FORMS).select("k", capture.camel_split(c("label")).alias("words"), capture.percent_decoded(c("path")).alias("path"), F.lower(F.hex(capture.data_url_bytes(c("data")))).alias("bytes"))


TITLE = {"title": dealt(1, ["Acme wordmark.svg", "Acme logo 1998.png", "Old Acme Logotype", "Acme app_icon", "Headquarters of Acme", "Acme 2016 logo", "ACME LOGO 2017.SVG"]), "mime": dealt(2, ["image/svg+xml", "image/png", "image/webp", "image/jpeg", None]), "w": f"CAST({K} % 301 AS DOUBLE)", "h": f"CAST({K} % 103 AS DOUBLE)", "agrees": f"{K} % 5 <> 0", "told": dealt(3, [None, None, "parked_for_sale"]), "asked": dealt(1, ["a.example", "www.a.example", "b.example", ""]), "final": dealt(2, ["a.example", "shop.a.example", "xa.example"])}


@query(rf"""SELECT k, CASE WHEN agrees THEN 50 ELSE -100 END + CASE WHEN lower(title) LIKE '%wordmark%' THEN 30 ELSE 0 END + CASE WHEN regexp_matches(lower(title), 'logo|logotype') THEN 15 ELSE 0 END + CASE WHEN mime = 'image/svg+xml' THEN 18 WHEN mime IN ('image/png', 'image/webp') THEN 8 ELSE 0 END
+ CASE WHEN w > 0 AND h > 0 AND w / h >= 2 THEN 22 WHEN w > 0 AND h > 0 AND w / h >= 1.35 THEN 14 WHEN w > 0 AND h > 0 AND w / h >= 0.8 THEN 4 ELSE -20 END - CASE WHEN regexp_matches(lower(title), '{capture.NO_LOGO}') THEN 55 ELSE 0 END - CASE WHEN regexp_matches(lower(title), '{capture.NOT_CURRENT}') THEN 45 ELSE 0 END
- CASE WHEN regexp_matches(title, '{capture.DATED}') THEN 18 ELSE 0 END AS points, coalesce(told, CASE WHEN asked <> '' AND final <> '' AND asked <> final AND NOT ends_with(asked, '.' || final) AND NOT ends_with(final, '.' || asked) THEN 'redirected_off_domain' ELSE 'live_html' END) AS reached FROM {told(**TITLE)}""")
def title_and_success(spark, sf):
    c = F.col
    return lines(spark, sf, **TITLE).select("k", capture.title_score(c("title"), c("mime"), c("w"), c("h"), c("agrees")).alias("points"), capture.success_class(c("told"), c("asked"), c("final")).alias("reached"))


EVENT = {"name": dealt(1, ["extraction_started", "extraction_finished", "asset_download", "github_clicked", "page_view"]), "outcome": dealt(2, ["success", "empty", "https://secret.example", None]), "placement": dealt(3, ["recommended", "result", "page", "more_assets"])}
#: What may leave.
ALLOWED = {"extraction_started": {}, "extraction_finished": {"outcome": ["success", "empty", "error"]}, "asset_download": {"placement": ["recommended", "more_assets"]}, "github_clicked": {"placement": ["result", "page"]}}


@query(f"""SELECT k, name, CASE WHEN name = 'extraction_finished' AND outcome IN ('success', 'empty', 'error') THEN outcome END AS outcome, CASE WHEN (name = 'asset_download' AND placement IN ('recommended', 'more_assets')) OR (name = 'github_clicked' AND placement IN ('result', 'page')) THEN placement END AS placement FROM {told(**EVENT)} WHERE name <> 'page_view'""")
def allowed_analytics_events(spark, sf):
    fields = F.create_map(F.lit("outcome"), F.col("outcome"), F.lit("placement"), F.col("placement"))
    rows = lines(spark, sf, **EVENT).withColumn("safe", selection.allowed_event(F.col("name"), fields, ALLOWED)).filter("safe is not null")
    return rows.select("k", "name", F.col("safe")["outcome"].alias("outcome"), F.col("safe")["placement"].alias("placement"))


@query("""WITH a AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS id FROM customer), b AS (SELECT *, row_number() OVER (ORDER BY sha256('seed-1' || chr(0) || id), id) - 1 AS ord, count(*) OVER () AS n FROM a)
SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM b WHERE ord >= floor(n * 0.6 + 0.5) AND ord < floor(n * 0.6 + 0.5) + floor(n * 0.2 + 0.5))""")
def orders_of_split(spark, sf):
    assigned = sampling.assign_splits(t(spark, sf, "customer").select("c_custkey"), "c_custkey", "seed-1").withColumnRenamed("c_custkey", "o_custkey")
    return sampling.of_split(t(spark, sf, "orders"), assigned, "o_custkey", "validation").select("o_orderkey")
