"""Queries over a stand-in table of candidates: the scoring expressions of ``functions`` against SQL that states the same rules on its own.

The stand-in is lineitem: a candidate for each line, its features dealt from its number by remainders. Both engines read the same feature texts; the
rules below them are written twice, once as Columns and once as SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from querncore.functions import pages, scoring
from querncore.functions.columns import settled
from querncore.operators import joins
from querncore.plans.catalogue import query, t

K = "(l_orderkey * 10 + l_linenumber)"


#: What Spark reads in place of each text that was dealt: the SQL has the value's number written out in every branch, as a quotient of decimals.
IN_SPARK: dict[str, str] = {}


def dealt(by: int, values: list[str | None], shift: int = 0) -> str:
    """One of the values by the candidate's number: (k + shift) // by modulo their number."""
    shown = ["NULL" if v is None else "'" + v.replace("'", "''").replace("\\", "' || chr(92) || '") + "'" for v in values]  # a backslash means itself in one engine alone
    text = f"CASE CAST(floor(({K} + {shift}) / {by}.0) AS BIGINT) % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(shown)) + " END"
    n = f"({K} + {shift})"
    place = n if by == 1 else f"(({n} - pmod({n}, {by}L)) div {by}L)"  # rounds down below 0 too
    IN_SPARK[text] = f"get(array({', '.join(shown)}), CAST({place} % {len(values)}L AS INT))"
    return text


def in_spark(text: str) -> str:
    """A feature's text with what was dealt as a place in a constant array, worked out once a row in whole numbers. The same values."""
    for sql in sorted((x for x in IN_SPARK if x in text), key=len, reverse=True):
        text = text.replace(sql, IN_SPARK[sql])
    return text


def numbered(spark, sf):
    """A line for each candidate's number: all features but the supplier follow from it alone, so repeats go before anything is worked out."""
    return t(spark, sf, "lineitem").selectExpr(f"{K} AS k").distinct().selectExpr("k div 10 AS l_orderkey", "k % 10 AS l_linenumber", "CAST(NULL AS BIGINT) AS l_suppkey")


def of_lines(spark, sf, features: dict[str, str], once: bool = False):
    """The table's lines with these features alone; once: a line for each number."""
    return (numbered(spark, sf) if once else t(spark, sf, "lineitem")).selectExpr(*(f"{in_spark(v)} AS {n}" for n, v in features.items()))


SOURCES = list(scoring.SOURCE_WEIGHTS) + ["unknown-source"]
URLS = ["https://a.example.com/logo.svg", "https://a.example.com/img/hero.png", "https://cdn.example.net/brand/mark.webp", "data:image/png;base64,AA", "https://b.example.org/x_120x40.png?w=80&v=2", "https://b.example.org/x.png?v=2#top", "https://c.example.org/:/rs=w:200/pic@2x.png", "ftp://d.example.org/logo.png"]
SIZES = ["", "32x32", "any", "16x16 180x180", "512x128", None]
FEATURES = {
    "k": K,
    "entity": "l_suppkey",
    "source": dealt(1, SOURCES),
    "url": dealt(3, URLS),
    "resolved": dealt(5, [*URLS, None], 1),
    "sizes": dealt(7, SIZES),
    "type": dealt(11, ["image/png", "image/svg+xml", None]),
    "declared_width": f"CAST(CASE WHEN {K} % 5 = 0 THEN NULL ELSE {K} % 260 END AS DOUBLE)",
    "declared_height": f"CAST({K} % 130 AS DOUBLE)",
    "width": f"CAST(CASE WHEN {K} % 9 = 0 THEN NULL ELSE {K} % 311 END AS DOUBLE)",
    "height": f"CAST({K} % 113 + 8 AS DOUBLE)",
    "content_width": f"CAST(CASE WHEN {K} % 4 = 0 THEN NULL ELSE {K} % 207 END AS DOUBLE)",
    "content_height": f"CAST({K} % 61 + 4 AS DOUBLE)",
    "positive_token": f"{K} % 3 = 0",
    "home_linked": f"CASE WHEN {K} % 8 = 7 THEN NULL ELSE {K} % 8 < 2 END",
    "dom_region": dealt(2, ["header", "body", "nav", "footer", None]),
    "negative_context": f"{K} % 19 = 0",
    "banner": f"{K} % 23 = 0",
    "theme": dealt(13, ["color", "unknown", "dark", None]),
    "color": dealt(14, ["white", "any", "unknown", "black", None]),
    "background": dealt(15, ["transparent", "opaque", "unknown"]),
    "scalable": f"{K} % 6 = 0",
    "high_resolution": f"{K} % 4 < 2",
    "agrees_with_company": f"{K} % 7 < 3",
    "exact_company_label": f"{K} % 14 = 0",
    "generic_reason": dealt(1, ["hero image", *[None] * 16]),
    "clipping_risk": f"CAST({K} % 10 AS DOUBLE) / 10",
    "likely_clipped": f"{K} % 10 >= 8",
    "stacked": f"{K} % 29 = 0",
    "explicit_symbol": f"{K} % 31 = 0",
    "wide_words": f"{K} % 3 = 1",
    "canvas_background": dealt(1, ["transparent", "opaque"]),
    "foreground_occupancy": f"CAST({K} % 50 AS DOUBLE) / 1000",
    "box_occupancy": f"CAST({K} % 37 AS DOUBLE) / 100",
    "contrast_light": f"CASE WHEN {K} % 11 = 0 THEN NULL ELSE CAST({K} % 21 AS DOUBLE) / 100 END",
    "contrast_dark": f"CAST({K} % 17 AS DOUBLE) / 100",
    "suitability": f"CASE WHEN {K} % 12 = 0 THEN NULL ELSE CAST({K} % 100 AS DOUBLE) END",
    "identity_verified": f"{K} % 41 = 0",
    "wide_evidence": f"{K} % 2 = 0",
}
C = "c AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in FEATURES.items()) + " FROM lineitem)"


def candidates(spark, sf, once: bool = False):
    rows = settled(of_lines(spark, sf, FEATURES, once))
    return rows.withColumn("eligible_roles", F.when(F.col("k") % 6 == 1, F.array(F.lit("icon"))).when(F.col("k") % 6 == 2, F.array(F.lit("wide"))))


FAVICONS = "('bimi', 'html-icon', 'apple', 'mask-icon', 'ms-tile', 'manifest', 'besticon', 'google-favicon', 'duckduckgo-favicon', 'root-favicon')"
OFFICIAL = "('schema', 'og-logo', 'microdata')"
WEIGHT = "CASE source " + " ".join(f"WHEN '{s}' THEN {w}" for s, w in scoring.SOURCE_WEIGHTS.items()) + " ELSE 0 END"

#: m: measures; s: what every score starts from; r: the role scores.
SCORED = f"""
WITH {C},
m AS (SELECT *, CASE WHEN width > 0 AND height > 0 THEN width / height END AS ratio, CASE WHEN content_width > 0 AND content_height > 0 THEN content_width / content_height END AS content, source IN {FAVICONS} AS fav, coalesce(dom_region IN ('header', 'nav'), false) AS bar, coalesce(home_linked, false) AS home, k % 6 NOT IN (2) AS may_icon, k % 6 NOT IN (1) AS may_wide FROM c),
n AS (SELECT *, coalesce(ratio >= 0.72 AND ratio <= 1.4, false) AS square, coalesce(content, ratio) AS broad, home OR bar OR source IN {OFFICIAL} AS strong, canvas_background = 'transparent' AND foreground_occupancy < 0.005 AS empty FROM m),
w AS (SELECT *, NOT empty AND NOT stacked AND NOT explicit_symbol AND NOT coalesce(broad >= 1.8 AND broad < 2.2 AND NOT wide_words, false)
  AND (coalesce(broad >= 1.8 AND (broad <= 12 OR (broad <= 14 AND strong)), false) OR coalesce(ratio >= 1.45 AND ratio < 1.8 AND width >= 120 AND least(width, height) >= 36 AND strong, false)) AS wide FROM n),
s AS (SELECT *, {WEIGHT} + CASE WHEN positive_token OR regexp_matches(lower(url), 'logo|brand|wordmark') THEN 15 ELSE 0 END + CASE WHEN bar THEN 18 ELSE 0 END + CASE WHEN home THEN 12 ELSE 0 END
  + CASE WHEN agrees_with_company THEN 12 ELSE 0 END + CASE WHEN exact_company_label THEN 6 ELSE 0 END - CASE WHEN negative_context THEN 35 ELSE 0 END - CASE WHEN generic_reason IS NOT NULL THEN 100 ELSE 0 END
  - CASE WHEN source = 'social-banner' THEN 30 ELSE 0 END + CASE WHEN high_resolution THEN 8 ELSE 0 END + CASE WHEN scalable THEN 7 ELSE 0 END
  + CASE WHEN theme = 'color' THEN 3 WHEN theme = 'unknown' AND source IN ('official-archive', 'spa-bundle') THEN 2 ELSE 0 END - CASE WHEN width > 0 AND height > 0 AND least(width, height) < 32 THEN 15 ELSE 0 END
  - CASE WHEN likely_clipped THEN 55 WHEN clipping_risk >= 0.5 THEN 3 ELSE 0 END AS base FROM w),
q AS (SELECT *, base + CASE WHEN square THEN 28 ELSE -12 END + CASE WHEN fav THEN 5 ELSE 0 END AS i, base + CASE WHEN wide THEN 30 ELSE -18 END - CASE WHEN fav THEN 18 ELSE 0 END AS b, base + CASE WHEN fav THEN 28 ELSE -22 END + CASE WHEN square THEN 8 ELSE 0 END AS f FROM s),
r AS (SELECT *, CAST(least(greatest(i, 0), 100) AS DOUBLE) AS icon_score, CAST(least(greatest(b, 0), 100) AS DOUBLE) AS wide_score, CAST(least(greatest(f, 0), 100) AS DOUBLE) AS favicon_score FROM q),
p AS (SELECT *, may_icon AND icon_score >= 35 AND NOT negative_context AND generic_reason IS NULL AND (width IS NULL OR width = 0 OR height = 0 OR least(width, height) >= 32 OR (scalable AND (positive_token OR agrees_with_company)))
    AND (square OR ratio IS NULL) AND (source <> 'bimi' OR coalesce(content < 1.8 AND square, false)) AND NOT likely_clipped
    AND (fav OR source IN {OFFICIAL} OR identity_verified OR agrees_with_company OR home OR (positive_token AND bar)) AS is_icon,
  may_wide AND wide_score >= 35 AND NOT negative_context AND generic_reason IS NULL AND NOT empty AND NOT likely_clipped AND (wide OR ratio IS NULL) AND wide_evidence AS is_wide,
  favicon_score >= 35 AND fav AND NOT likely_clipped AS is_favicon FROM r)"""


def scored(spark, sf, once: bool = False):
    return settled(settled(candidates(spark, sf, once).withColumn("role_scores", scoring.role_scores())).withColumn("predicted_roles", scoring.predicted_roles()))


@query(f"{SCORED} SELECT k, icon_score AS icon, wide_score AS wide, favicon_score AS favicon, CASE WHEN greatest(icon_score, wide_score, favicon_score) >= 70 THEN 'high' WHEN greatest(icon_score, wide_score, favicon_score) >= 45 THEN 'medium' ELSE 'low' END AS band FROM r")
def candidate_role_scores(spark, sf):
    s = F.col("role_scores")
    return scored(spark, sf).select("k", s["icon"].alias("icon"), s["wide"].alias("wide"), s["favicon"].alias("favicon"), scoring.confidence_band(F.greatest(s["icon"], s["wide"], s["favicon"])).alias("band"))


@query(f"{SCORED} SELECT k, 'icon' AS role FROM p WHERE is_icon UNION ALL SELECT k, 'wide' FROM p WHERE is_wide UNION ALL SELECT k, 'favicon' FROM p WHERE is_favicon")
def candidate_predicted_roles(spark, sf):
    return scored(spark, sf).select("k", F.explode("predicted_roles").alias("role"))


@query(f"""{SCORED} SELECT entity, role, k, score FROM (SELECT *, row_number() OVER (PARTITION BY entity, role ORDER BY score DESC, k) AS place FROM
(SELECT entity, 'icon' AS role, k, icon_score AS score FROM p WHERE is_icon UNION ALL SELECT entity, 'wide', k, wide_score FROM p WHERE is_wide UNION ALL SELECT entity, 'favicon', k, favicon_score FROM p WHERE is_favicon)) WHERE place = 1""")
def candidate_winners(spark, sf):
    from querncore.operators import ranking

    s = F.col("role_scores")
    score = F.when(F.col("role") == "icon", s["icon"]).when(F.col("role") == "wide", s["wide"]).otherwise(s["favicon"])
    rows = scored(spark, sf).withColumn("role", F.explode("predicted_roles")).withColumn("score", score)
    return ranking.top(rows, ["entity", "role"], [F.desc("score"), F.asc("k")]).select("entity", "role", "k", "score")


EDGE = "least(coalesce(nullif(width, 0), 1e300), coalesce(nullif(height, 0), 1e300))"
BONUS = f"CASE WHEN NOT fav THEN 0 WHEN {EDGE} >= 180 THEN 8 WHEN {EDGE} >= 96 THEN 4 ELSE 0 END"
EFFECTIVE = f"icon_score - CASE WHEN content >= 1.8 AND ratio < 1.8 THEN 40 ELSE 0 END - CASE WHEN stacked THEN 40 ELSE 0 END - CASE WHEN clipping_risk >= 0.5 AND NOT likely_clipped THEN 3 ELSE 0 END + {BONUS}"


@query(f"{SCORED} SELECT k, {BONUS} AS bonus, {EFFECTIVE} AS effective FROM r")
def icon_effective_score(spark, sf):
    return scored(spark, sf).select("k", scoring.icon_size_bonus().alias("bonus"), scoring.icon_effective().alias("effective"))


@query(f"""WITH {C} SELECT k, array_to_string(list_filter([CASE WHEN foreground_occupancy < 0.015 THEN 'negligible foreground occupancy' END, CASE WHEN box_occupancy < 0.08 THEN 'visible content box is too small' END,
CASE WHEN canvas_background = 'transparent' AND greatest(coalesce(contrast_light, 0), coalesce(contrast_dark, 0)) < 0.08 THEN 'insufficient contrast on light and dark surfaces' END], lambda x: x IS NOT NULL), '|') AS reasons,
CASE WHEN canvas_background = 'transparent' AND coalesce(contrast_light, 0) < 0.08 THEN 1 ELSE 0 END AS poor_on_light FROM c""")
def icon_rejections(spark, sf):
    on_light = F.array_contains(scoring.icon_rejections("light"), "insufficient contrast on light surface").cast("int")
    return candidates(spark, sf).select("k", F.array_join(scoring.icon_rejections(), "|").alias("reasons"), on_light.alias("poor_on_light"))


@query(f"""{SCORED} SELECT k, CASE WHEN {EDGE} <= 64 THEN 40 WHEN {EDGE} <= 128 THEN 25 WHEN {EDGE} <= 256 THEN 10 ELSE 0 END + 0.6 * coalesce(suitability, 0) + CASE WHEN is_icon THEN 8 ELSE 0 END
+ CASE WHEN source = 'html-icon' THEN 1 ELSE 0 END + CAST(0.01 AS DOUBLE) * favicon_score AS rank FROM p WHERE is_favicon""")
def favicon_rank(spark, sf):
    return scored(spark, sf).filter(F.array_contains("predicted_roles", "favicon")).select("k", scoring.favicon_rank().alias("rank"))


PIXELS = "CASE WHEN regexp_matches(lower(coalesce(type, '') || ' ' || url), 'svg') THEN 1e12 WHEN sizes = 'any' THEN 1e11 ELSE greatest(coalesce(declared_width * declared_height, 0), CASE sizes WHEN '32x32' THEN 1024 WHEN '16x16 180x180' THEN 32400 WHEN '512x128' THEN 65536 ELSE 0 END) END"


@query(f"""WITH {C}, d AS (SELECT *, {PIXELS} AS pixels FROM c) SELECT k, CAST(pixels AS DOUBLE) AS pixels, ({WEIGHT}) * 10 + CASE WHEN positive_token THEN 90 ELSE 0 END + CASE WHEN home_linked THEN 80 ELSE 0 END + CASE WHEN dom_region IN ('header', 'nav') THEN 55 ELSE 0 END
- CASE WHEN negative_context OR banner THEN 200 ELSE 0 END - CASE WHEN source = 'social-banner' THEN 300 ELSE 0 END + least(40.0, round(2 * log2(greatest(1.0, pixels)), 4)) AS priority FROM d""")
def discovery_priority(spark, sf):
    bonus = F.least(F.lit(40.0), 2 * F.log2(F.greatest(F.lit(1.0), scoring.declared_pixels())))
    return candidates(spark, sf).select("k", scoring.declared_pixels().alias("pixels"), (scoring.discovery_priority() - bonus + F.round(bonus, 4)).alias("priority"))


@query(f"""WITH {C}, d AS (SELECT *, coalesce(CASE sizes WHEN '32x32' THEN 1.0 WHEN '16x16 180x180' THEN 1.0 WHEN '512x128' THEN 4.0 END, CASE WHEN declared_width > 0 AND declared_height > 0 THEN declared_width / declared_height END) AS shape FROM c)
SELECT k, CASE WHEN negative_context OR banner OR source = 'social-banner' THEN NULL WHEN source IN ('dom-img', 'dom-picture', 'noscript-img', 'browser-img') AND NOT positive_token AND NOT coalesce(home_linked, false) AND NOT coalesce(dom_region IN ('header', 'nav'), false) THEN NULL
WHEN shape >= 1.8 THEN 'wide' WHEN source IN {FAVICONS} THEN 'favicon' WHEN source IN ('schema', 'og-logo', 'microdata') THEN 'wide' ELSE 'icon' END AS queue FROM d""")
def provisional_queue(spark, sf):
    return candidates(spark, sf).select("k", scoring.provisional_queue().alias("queue"))


@query(f"""WITH {C} SELECT k, CASE WHEN theme = 'dark' THEN 2 WHEN theme = 'any' THEN 1 WHEN coalesce(theme, 'unknown') <> 'unknown' THEN -2 ELSE 0 END + CASE WHEN color = 'white' THEN 2 WHEN color = 'any' THEN 1 WHEN coalesce(color, 'unknown') <> 'unknown' THEN -2 ELSE 0 END AS points FROM c""")
def preference_scores(spark, sf):
    return candidates(spark, sf).select("k", scoring.preference_score({"theme": "dark", "color": "white", "background": "any"}).alias("points"))


MEMBERS = ["Logos/acme-wordmark.svg", "logo/ACME_logo.png", "__MACOSX/._logo.svg", "press/headshot.webp", "brand/globex claude logo.svg", "icon.png", "img/legacy/acme logotype.png", "readme.txt", "Acme-Widgets/lockup.webp", "kit/powered by acme.svg", "app icon acme.png", "salesforce/acme.png", "kit/acme-horizontal.svg", r"kit\acme\Full Logo.png", "kit/acme%20logo.svg", "analogous.svg", "img/logo primary.webp", "logotype.png", "a+b/primary%2Bacme.svg"]
NAMES = ["Acme Inc", "Globex Technologies", "Salesforce", "AB Co"]
MEMBER = f"SELECT {K} AS k, {dealt(1, MEMBERS)} AS member, {dealt(2, NAMES)} AS company, {dealt(3, ['press-kit.zip', 'files.zip'])} AS context FROM lineitem"
LEGAL = "inc|llc|ltd|corp|corporation|company|co|technologies|technology|tech|center"


@query(rf"""WITH a AS (SELECT *, replace(lower(url_decode(replace(member, '+', '%2B'))), '\', '/') AS m, list_filter(string_split(regexp_replace(regexp_replace(lower(company), '\b({LEGAL})\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS named FROM ({MEMBER})),
b AS (SELECT *, regexp_replace(regexp_replace(m, '\b({LEGAL})\b', ' ', 'g'), '[^a-z0-9]+', '', 'g') AS hay, regexp_extract(m, '(^|[\s/_.-])(copilot|claude|connect|checkout|terminal|atlas|slackbot|salesforce)($|[\s/_.-])', 2) AS product FROM a)
SELECT k, CASE WHEN m LIKE '%.svg' THEN 30 WHEN m LIKE '%.png' THEN 18 WHEN m LIKE '%.webp' THEN 12 END + CASE WHEN regexp_matches(m, '(^|[\s/_.-])(wordmark|lockup|horizontal|primary|full[-_\s]*logo|logo[-_\s]*primary|logo[-_\s]*horizontal)($|[\s/_.-])') THEN 45 WHEN regexp_matches(m, '(^|[\s/_.-])logo($|[\s/_.-])') THEN 18 ELSE 0 END
+ CASE WHEN len(list_filter(named, lambda w: length(w) >= 3 AND contains(hay, w))) > 0 THEN 35 ELSE 0 END + CASE WHEN regexp_matches(context, 'brand|press|media|logo') THEN 8 ELSE 0 END
- CASE WHEN regexp_matches(m, '__macosx|(^|/)\._|badge|powered[-_\s]*by|screenshot|headshot|deprecated|legacy|(^|[\s/_.-])(icon|symbol|glyph|vertical|stacked|favicon|app[-_\s]*icon)($|[\s/_.-])') THEN 80 ELSE 0 END
- CASE WHEN product <> '' AND NOT list_contains(named, product) THEN 100 ELSE 0 END AS score FROM b""")
def archive_member_score(spark, sf):
    return of_lines(spark, sf, {"k": K, "member": dealt(1, MEMBERS), "company": dealt(2, NAMES), "context": dealt(3, ["press-kit.zip", "files.zip"])}).select("k", scoring.archive_member_score(F.col("member"), F.col("company"), F.col("context")).alias("score"))


FIRST, SECOND, THIRD = ["press", "company", "brand", "blog", "en", "about", "newsroom", "media-kit", "2024", "products", "brand-style-guide"], ["press", "information", "logos", "05", "acme", "news.html", "press-information"], ["", "a/b", "story", "05/x"]
PAGE = [f"{K} AS k", f"'https://www.example.com/' || {dealt(1, FIRST)} || '/' || {dealt(3, SECOND)} || '/' || {dealt(2, THIRD)} || {dealt(5, ['', '?q=1'])} AS url", f"CASE WHEN {K} % 4 = 0 THEN NULL ELSE CAST({K} % 1500 AS DOUBLE) END AS age"]
STRONG = "(^|[-_/])(brand(ing)?[-_/](asset|center|guideline|resource|toolkit)|press[-_/]kit|media[-_/]kit|logo[-_/](asset|download|file|kit)|visual[-_/]identity)s?($|[-_/])"


@query(rf"""WITH a AS (SELECT *, regexp_replace(lower(regexp_extract(url, '^https://[^/]*([^?#]*)', 1)), '[.][a-z0-9]{{1,8}}$', '') AS p, list_filter(string_split(regexp_replace(lower(regexp_extract(url, '^https://[^/]*([^?#]*)', 1)), '[.][a-z0-9]{{1,8}}$', ''), '/'), lambda s: s <> '') AS seg FROM (SELECT {', '.join(PAGE)} FROM lineitem)),
b AS (SELECT *, len(seg) AS n, list_has_any(seg, ['brand', 'branding', 'logo', 'logos']) AS focused, list_filter(seg, lambda s: s IN ('newsroom', 'press', 'media', 'company', 'about', 'corporate'))[1] AS token, regexp_matches(p, '{STRONG}') AS named,
  len(seg) <= 4 AND len(list_filter(seg, lambda s: regexp_matches(s, '^(brand[-_])?style[-_]guide$'))) > 0 AS guide FROM a),
d AS (SELECT *, list_position(seg, token) - 1 AS spot, token IN ('newsroom', 'press', 'media') AS news, named OR focused OR guide AS strong FROM b)
SELECT k, CASE WHEN strong THEN 100 - CASE WHEN n > 3 AND NOT focused THEN 30 ELSE 0 END WHEN regexp_matches(p, '(^|[-_/])(newsroom|press|media)[-_/](information|resource|asset|download|about|contact)($|[-_/])') THEN 80
  WHEN token IS NULL THEN 0 WHEN NOT news THEN 25 WHEN spot > 1 OR n - spot - 1 > 0 THEN 15 ELSE 80 END
- CASE WHEN NOT strong AND len(list_filter(seg, lambda s: regexp_matches(s, '^(article|author|blog|careers?|jobs?|events?|legal|privacy|products?|customers?|partners?|support|store|shop|docs?|documentation|developers?|api)$'))) > 0 THEN 45 ELSE 0 END
- CASE WHEN NOT named AND regexp_matches(p, '/(19|20)\d\d/(0?[1-9]|1[0-2])(/|$)') THEN 30 ELSE 0 END - CASE WHEN url LIKE '%?q=1' THEN 5 ELSE 0 END + CASE WHEN age <= 730 THEN 5 ELSE 0 END - CASE WHEN age > 1000 THEN 20 ELSE 0 END AS score FROM d""")
def sitemap_page_score(spark, sf):
    return t(spark, sf, "lineitem").selectExpr(*map(in_spark, PAGE)).select("k", pages.page_url_score(F.col("url"), F.col("age"), 1000).alias("score"))


MAPS = ["sitemap.xml", "page-sitemap.xml", "product_sitemap.xml.gz", "press/sitemap.xml", "media-images.xml", "video-sitemap.xml", "brand_pages.xml.gz", "tags.xml"]


@query(rf"""SELECT k, CASE WHEN regexp_matches(p, '(^|[-_/])(page|newsroom|press|media|brand|corporate)s?([-_.]|$)') THEN 50 ELSE 0 END - CASE WHEN regexp_matches(p, '(^|[-_/])(image|video|product|category|tag|author|event|job)s?([-_.]|$)') THEN 80 ELSE 0 END - CASE WHEN p LIKE '%.gz' THEN 1 ELSE 0 END AS priority
FROM (SELECT {K} AS k, '/' || {dealt(1, MAPS)} AS p FROM lineitem)""")
def sitemap_document_priority(spark, sf):
    rows = of_lines(spark, sf, {"k": K, "url": f"'https://example.com/' || {dealt(1, MAPS)}"})
    return rows.select("k", pages.sitemap_priority(F.col("url")).alias("priority"))


@query(rf"""WITH {C}, a AS (SELECT *, coalesce(resolved, url) AS u, coalesce(CASE WHEN content_width > 0 AND content_height > 0 THEN content_width / content_height END, CASE WHEN width > 0 AND height > 0 THEN width / height END) AS ratio FROM c),
b AS (SELECT *, CASE WHEN ratio IS NULL THEN 'unknown' WHEN ratio >= 1.8 THEN 'wide' WHEN ratio BETWEEN 0.72 AND 1.4 THEN 'square' ELSE 'other' END AS shape, CASE u WHEN 'https://b.example.org/x_120x40.png?w=80&v=2' THEN 'https://b.example.org/x.png?v=2' WHEN 'https://b.example.org/x.png?v=2#top' THEN 'https://b.example.org/x.png?v=2'
  WHEN 'https://c.example.org/:/rs=w:200/pic@2x.png' THEN 'https://c.example.org/pic.png' ELSE u END AS plain FROM a)
SELECT CASE WHEN u LIKE 'http%' THEN shape || ':' || plain ELSE 'unique:' || CAST(k AS VARCHAR) END AS family, count(*) AS n, min(k) AS first FROM b GROUP BY 1""")
def asset_family_keys(spark, sf):
    key = pages.family_key(F.coalesce("resolved", "url"), scoring.family_shape(), F.col("k"))
    return candidates(spark, sf).groupBy(key.alias("family")).agg(F.count("*").alias("n"), F.min("k").alias("first"))


@query(f"""WITH {C}, seen AS (SELECT entity, k % 50 AS h, url, resolved FROM c WHERE k % 40 = 1)
SELECT k FROM c WHERE k % 5 = 2 AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.entity = c.entity AND s.h = c.k % 50) AND NOT EXISTS (SELECT 1 FROM seen s WHERE s.entity = c.entity AND (s.url IN (c.url, c.resolved) OR s.resolved IN (c.url, c.resolved)))""")
def replay_novel_candidates(spark, sf):
    rows = candidates(spark, sf).withColumn("h", F.col("k") % 50).select("k", "entity", "h", "url", "resolved")
    return joins.replay_novel(rows.filter("k % 5 = 2"), rows.filter("k % 40 = 1"), "h", ["url", "resolved"], ["entity"]).select("k")


COMPANIES, TEXTS = ["International Business Machines Corp", "Rock and Roll", "Acme", "Black Box Tech Group"], ["https://x.example/ibm-logo.svg", "rnr_lockup.png", "files/acme.png", "bbg.wordmark", "a/ibmlogo"]


@query(rf"""WITH a AS (SELECT {K} AS k, {dealt(1, COMPANIES)} AS company, {dealt(3, TEXTS)} AS told FROM lineitem),
b AS (SELECT *, array_to_string(list_transform(list_filter(string_split(lower(company), ' '), lambda w: w NOT IN ('inc', 'llc', 'ltd', 'corp', 'corporation', 'company', 'technologies', 'technology', 'tech', 'center')), lambda w: CASE WHEN w = 'and' THEN 'n' ELSE w[1] END), '') AS letters FROM a)
SELECT k, length(letters) >= 3 AND regexp_matches(lower(told), '(^|[/_.-])' || letters || '([/_.-]|logo|wordmark|lockup)') AS agrees FROM b""")
def acronym_agreement(spark, sf):
    rows = of_lines(spark, sf, {"k": K, "company": dealt(1, COMPANIES), "told": dealt(3, TEXTS)})
    return rows.select("k", scoring.acronym_agreement(F.col("told"), F.col("company")).alias("agrees"))
