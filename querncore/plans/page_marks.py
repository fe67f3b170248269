"""Queries over candidates made from pages: a candidate for each link of a page, with the link's own text, target, host and place; what a page does not hold
(sizes, hashes, kinds of sources) is dealt from its number. The rules are written twice: as Columns in ``functions``, and here as SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from querncore.functions import domains, evidence, vetoes
from querncore.operators import joins
from querncore.plans.catalogue import query, t


def pick(by: int, values: list[str | None], shift: int = 0) -> str:
    """One of the expressions by the candidate's number."""
    return f"CASE CAST(floor((n + {shift}) / {by}.0) AS BIGINT) % {len(values)} " + " ".join(f"WHEN {k} THEN {v or 'NULL'}" for k, v in enumerate(values)) + " END"


def texts(*values: str | None) -> list[str | None]:
    return [None if v is None else "'" + v.replace("'", "''") + "'" for v in values]


#: Reviewed hashes stand in for a landed catalogue: the page's number, its reason, owners, and the domains of owners.
REVIEWED = [("page-7", "builder default favicon", ["acme"], ["free-bets.example.com"]), ("page-11", "template hero mark", ["globex"], []), ("page-11", "template hero mark", ["globex"], []), ("page-23", "theme placeholder", [], None)]
HASHES = texts("33c1436f8c40ca2582d091c449fccc34ed9bf73f02526c5fdef44f4f06c6321b", "788f0397eb26c7151af4afc25d5478ef692b39c10035774158b500b187b4a431", "c386396ec70db3608075b5fbfaac4ab1ccaa86ba05a68ab393ec551eb66c3e00")
#: Words that set off a rule, with more places where nothing is said, so that the later rules of the chain are reached.
SAID = ["nav-item-icon", "Powered by Netlify", "default-piwik-logo", "logo soc 2 type", "customer-logos strip", "investor logos", "fa-search", "social-icon list", "hero", "carousel slide", "team-member", "dashboard", "product-image", "play-circle", "award badge", "works-with-logos", "wix favicon", "profile photo", "chakra-icon", "matomo logo", "enterprise-logo-4", "logo editor", "twitter"]
MARKS = {
    "source": pick(1, texts("dom-img", "browser-img", "inline-svg", "schema", "html-icon", "dom-picture", "official-archive", "noscript-img", "spa-bundle", "wikimedia-commons", "og-logo", "bimi", "apple")),
    "company": pick(5, ["word", *texts("Acme Inc", None), "word || ' Labs Ltd.'", *texts("", "Globex Corporation", "Wix")]),
    "stated_company": pick(7, [None, "word", None, "'Acme'"]),
    "alt": pick(3, ["word || ' logo'", None, "'The official ' || word || ' company wordmark'", *texts("Partner Labs logo", None, "Menu", "Our whole team at work, the logo on the building", "Instagram", None), "word || ' home'", *texts("G2 badge", "picture of a city", "header logo", "Scenes of a big new campus, brand mark at the top", "ACME logo", "Globex wordmark")]),
    "aria_label": pick(4, [None, "word", "'example logo'", None, "'Example  Home'", None, None]),
    "semantic_text": pick(2, [x for s in SAID for x in (*texts(s), None, "word", None)]),
    "local_semantic": pick(6, texts(None, "Wordmark of the site", None, "view our brand book", None, "logo", None, "download the logo", None, None, None)),
    "class_words": pick(2, texts("", "logo,dark", "", "nav,menu-item-icon", "", "partner,card-x", "", "backed-by,marks", "", "", "img"), 1),
    "dom_region": pick(2, texts("body", "header", "body", None, "nav", "body", "footer")),
    "home_linked": "CASE WHEN n % 8 = 7 THEN NULL ELSE n % 8 < 1 END",
    "positive_token": "n % 3 = 0",
    "width": "CAST(CASE WHEN n % 9 = 0 THEN NULL ELSE n % 311 END AS DOUBLE)",
    "height": "CAST(CASE WHEN n % 2 = 0 THEN n % 311 + n % 7 ELSE n % 113 + 8 END AS DOUBLE)",
    "scalable": "n % 6 = 0",
    "format": pick(3, texts("png", "svg", None, "WEBP")),
    "content_hash": f"CASE WHEN n % 29 = 0 THEN {pick(1, HASHES)} WHEN n % 17 = 0 THEN 'page-' || (page_id % 30) END",
    "requires_rendering": "n % 97 = 0",
    "rendered": "n % 2 = 0",
    "archive_member": pick(1, [None, "'kit/claude logo.svg'", "'brand/' || word || '.svg'"]),
    "seen_reason": f"CASE WHEN n % 43 = 0 THEN {pick(1, texts('Wix default favicon', 'builder mark', ''))} END",
    "seen_owner": pick(1, texts("wix", "acme", None)),
    "seen_domain": pick(2, texts(None, "example.com", None)),
    "url": pick(
        3,
        [
            "'https://' || host || '/img/' || word || '-logo.png'", "'https://' || host || href", "'https://static.parastorage.com/client/pfavico.ico?v=1'", "'https://' || host || '/media/Anna_Schmidt-2.jpg'",
            "'https://cdn.example.net/og-default.png'", "'https://' || host || '/a/og_image.jpg'", "'https://cdn.example.net/untitled-ui-logo.svg'", "'https://' || host || '/brand/mark.webp'", "'data:image/png;base64,AA'",
            "'https://x.example.net/sloane-logo-2.webp'", "'https://' || host || '/big_Hero_Image.png'", "'https://a.example.net/plugins/morpheus/images/logo.svg?matomo'", "'https://img1.wsimg.com/isteam/ip/static/pwa-app/logo-default.png'",
            "'https://' || host || '/789bet/' || word || '.svg'", "'https://' || host || '/%E2%82%AC/Logo.SVG'", "'https://' || host || '/bad%zz/wordmark.svg'", "'https://www.' || host || '/nav/logo/' || word || '.png'", "'https://' || host || '/img/' || word", "'https://' || host || '/face.jpg'",
        ],
    ),
    "resolved_url": pick(11, [None, None, "'https://' || host || '/final/' || word || '.png'"]),
    "wikidata_identity_verified": "n % 4 = 1",
    "deep_official": "n % 5 = 2",
    "archive_score": "CAST(n % 80 AS DOUBLE)",
    "sitemap_official_page": "n % 7 = 3",
    "sitemap_exact_identity": "n % 3 = 1",
    "spa_bundle_entry": "n % 2 = 0",
    "same_origin": "n % 4 < 3",
    "strong_logo_filename": "n % 5 < 4",
    "spa_identity_agreement": "n % 3 < 2",
}
SHOWN = ", ".join(f"{v} AS {k}" for k, v in MARKS.items())


def links(spark, sf):
    """n long, page_id, source_page, host, href, word: the links of the pages in order."""
    found = F.arrays_zip(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">'), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1)).alias("word"))
    rows = t(spark, sf, "pages").select("page_id", F.col("url").alias("source_page"), F.lower(F.regexp_extract("url", "^[A-Za-z]+://([^/?#:]*)", 1)).alias("host"), F.posexplode(found).alias("place", "a"))
    return rows.select((F.col("page_id") * 100 + F.col("place")).alias("n"), "page_id", "source_page", "host", F.col("a.href").alias("href"), F.col("a.word").alias("word"))


def marks(spark, sf):
    rows = links(spark, sf).selectExpr("*", *(f"{v} AS {k}" for k, v in MARKS.items()))
    rows = rows.withColumn("class_tokens", F.filter(F.split("class_words", ","), lambda w: w != "")).withColumn("site_label", F.element_at(F.split("host", r"\."), -2))
    seen = F.when(F.col("seen_reason").isNotNull(), F.struct(F.col("seen_reason").alias("reason"), F.array_compact(F.array("seen_owner")).alias("owners"), F.when(F.col("seen_domain").isNotNull(), F.array("seen_domain")).alias("owner_domains"), F.lit(None).cast("string").alias("method")))
    catalogue = spark.createDataFrame(REVIEWED, "sha256 string, reason string, owners array<string>, owner_domains array<string>")
    return joins.reviewed_hashes(rows.withColumn("generic_asset", seen), "content_hash", catalogue)


WORDS = "regexp_extract_all({}, '[a-z0-9]+')"
IMAGES = "('dom-img', 'dom-picture', 'browser-img')"
#: f: features; g: texts put together; h: what they say; v: the chain.
MARKS_SQL = rf"""
l AS (SELECT page_id * 100 + place AS n, page_id, url AS source_page, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host, href, word FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href,
  unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS word, unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">', 1)))) AS place FROM pages)),
f AS (SELECT *, {SHOWN} FROM l),
g AS (SELECT *, coalesce(alt, '') || ' ' || coalesce(aria_label, '') AS labels, lower(coalesce(semantic_text, '') || ' ' || array_to_string(list_filter(string_split(class_words, ','), lambda w: w <> ''), ' ')) AS structural,
  lower(coalesce(semantic_text, '') || ' ' || coalesce(alt, '') || ' ' || coalesce(aria_label, '')) AS semantic, coalesce(resolved_url, url) AS u, CASE WHEN coalesce(company, '') <> '' THEN company ELSE coalesce(stated_company, '') END AS asked_text,
  regexp_replace(host, '^www[.]', '') AS bare, string_split(host, '.')[-2] AS site_label, CASE WHEN width > 0 AND height > 0 THEN width / height END AS ratio FROM f),
g2 AS (SELECT *, CASE WHEN u LIKE '%bad\%zz%' ESCAPE '\' OR u LIKE 'data:%' THEN '' ELSE replace(regexp_extract(u, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '%E2%82%AC', '€') END AS u_path, CASE WHEN url LIKE '%bad\%zz%' ESCAPE '\' OR url LIKE 'data:%' THEN '' ELSE replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '%E2%82%AC', '€') END AS own_path,
  regexp_replace(lower(regexp_extract(u, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www[.]', '') AS u_bare, {WORDS.format('lower(asked_text)')} AS asked, {WORDS.format("lower(regexp_replace(lower(asked_text), '\\b(inc|llc|ltd|corp|corporation|company|co)\\b\\.?', ' ', 'g'))")} AS tokens,
  list_filter({WORDS.format(r"lower(regexp_extract(trim(labels), '(?i)^\s*(.+?)\s+(?:company\s+)?(?:logo|wordmark|brandmark|logomark)\s*$', 1))")}, lambda w: w NOT IN ('the', 'official')) AS subject, semantic || ' ' || lower(u) AS told, lower(u) AS ul FROM g),
g3 AS (SELECT *, list_filter(asked, lambda w: w NOT IN ('inc', 'llc', 'ltd', 'corp', 'corporation', 'company', 'co')) AS named, list_concat(asked, {WORDS.format('host')}) AS own,
  len(list_filter(tokens, lambda w: length(w) >= 3 AND contains(lower(own_path || ' ' || labels), w))) > 0 AS agrees, coalesce(ratio >= 0.72 AND ratio <= 1.4, false) AS square, source IN {IMAGES} AS image, coalesce(dom_region = 'body', false) AND NOT coalesce(home_linked, false) AS loose,
  coalesce(home_linked, false) AS home, coalesce(dom_region IN ('header', 'nav'), false) AS bar, regexp_matches(told, 'logo|wordmark|brandmark|logomark') AND NOT regexp_matches(semantic, 'logo[-_\s]*editor') AS branded,
  list_filter(string_split(array_to_string(list_filter(regexp_split_to_array(regexp_replace(list_last(string_split(u_path, '/')), '\.[^.]+$', ''), '[-_\s]+'), lambda w: w <> ''), '|'), '|'), lambda w: true) AS parts FROM g2),
g4 AS (SELECT *, len(subject) > 0 AND len(named) > 0 AND subject = named AS exact_label, CASE WHEN asked_text <> '' THEN named ELSE [site_label] END AS against, regexp_matches(u_path || ' ' || semantic, '(?i)(?:^|[^a-z0-9])(?:avatar|headshot|portrait|profile[-_\s]*(?:image|photo|picture)|team[-_\s]*member|(?:staff|employee|founder|author|speaker)[-_\s]*(?:image|photo|picture))(?:[^a-z0-9]|$)') AS about,
  len(list_filter(range(1, len(parts)), lambda i: regexp_matches(parts[i], '^[A-Z][a-z][a-z]+$') AND regexp_matches(parts[i + 1], '^[A-Z][a-z][a-z]+$') AND NOT regexp_matches(lower(parts[i] || '|' || parts[i + 1]), '(^|\|)(bg|background|big|desktop|final|hero|image|img|large|main|new|photo|pic|picture|site|small|web|website)(\||$)'))) > 0 AS person FROM g3),
g5 AS (SELECT *, len(subject) > 0 AND len(against) > 0 AND (home OR regexp_matches(structural, 'carousel|customer|partner|investor|sponsor|backed(?:[-_\s]*by)?|testimonial|card[-_\s]|dropdown|menuitem|listitem|product|subbrand'))
   AND len(list_filter(subject, lambda s: length(s) >= 3 AND len(list_filter(against, lambda a: length(a) >= 3 AND (starts_with(s, a) OR starts_with(a, s)))) > 0)) = 0 AS foreign_org,
  coalesce(list_filter([{', '.join(f"CASE WHEN NOT list_contains(own, '{p}') AND regexp_matches(semantic, '(^|[^a-z0-9]){p}[\\s_-]+(logo|favicon|brand)([^a-z0-9]|$)|(powered|hosted|secured)[\\s_-]+by[\\s_-]+{p}([^a-z0-9]|$)') THEN '{p}' END" for p in vetoes.PLATFORMS)}], lambda x: x IS NOT NULL)[1], '') AS platform,
  (image OR source = 'noscript-img') AND NOT scalable AND coalesce(dom_region, 'body') = 'body' AND NOT home AND square AND u_path <> '' AND (regexp_matches(lower(u_path), '[.](avif|jpe?g|png|webp)$') OR coalesce(lower(format) IN ('avif', 'jpeg', 'jpg', 'png', 'webp'), false))
   AND (about OR (NOT exact_label AND NOT (regexp_matches(lower(u_path), '(^|[/_.-])(logo|wordmark|brandmark|logomark)([/_.-]|$)') AND agrees) AND NOT agrees AND person)) AS face FROM g4),
v AS (SELECT *, CASE
WHEN requires_rendering AND NOT rendered THEN 'unresolved SVG document styles'
WHEN regexp_matches(lower(coalesce(local_semantic, '')), '\b(open|download|view)\b.{{0,50}}\b(brand|logo|wordmark)\b') THEN 'brand-asset utility control'
WHEN NOT positive_token AND regexp_matches(structural, '(navigation|nav|menu)[-_\s]*item[-_\s]*icon') THEN 'navigation item icon'
WHEN content_hash = 'page-7' AND NOT (bare = 'free-bets.example.com' AND (len(asked) = 0 OR list_contains(asked, 'acme'))) THEN 'builder default favicon'
WHEN content_hash = 'page-11' THEN 'template hero mark'
WHEN content_hash = 'page-23' THEN 'theme placeholder'
WHEN content_hash LIKE '33c1436f%' AND NOT (list_contains(asked, 'wix') OR (len(asked) = 0 AND (host = 'wix.com' OR host LIKE '%.wix.com'))) THEN 'Wix default favicon'
WHEN content_hash LIKE '788f0397%' THEN 'photographic avatar mislabeled as logo'
WHEN content_hash LIKE 'c386396e%' AND NOT list_contains(asked, 'react') THEN 'Create React App default logo'
WHEN seen_reason <> '' AND NOT coalesce(CASE WHEN seen_domain IS NOT NULL THEN bare = seen_domain AND (len(asked) = 0 OR list_contains(asked, seen_owner)) WHEN len(asked) > 0 THEN list_contains(asked, seen_owner) ELSE seen_owner = 'wix' AND (host = 'wix.com' OR host LIKE '%.wix.com') END, false) THEN seen_reason || ' via visual fingerprint'
WHEN platform <> '' THEN 'foreign platform brand: ' || platform
WHEN NOT list_contains(own, 'wix') AND regexp_matches(ul, 'static[.]parastorage[.]com/client/pfavico[.]ico([?#]|$)') THEN 'Wix default favicon'
WHEN NOT list_has_any(own, ['matomo', 'piwik']) AND (regexp_matches(semantic, '(^|[-_\s])default-piwik-logo($|[-_\s])') OR regexp_matches(ul, '/plugins/morpheus/images/logo[.]svg([?]matomo)?$|/plugins/corehome/images/(applogo_\d+|favicon)[.](png|ico|svg)([?#]|$)')) THEN 'Matomo default application logo'
WHEN NOT list_contains(own, 'godaddy') AND contains(ul, 'img1.wsimg.com/isteam/ip/static/pwa-app/logo-default.png') THEN 'GoDaddy default PWA logo'
WHEN NOT list_has_any(own, ['789bet', 'meriamhoki', '90phut']) AND regexp_matches(told, '789bet|dewancash|meriamhoki|90phut') THEN 'foreign gambling brand'
WHEN regexp_matches(told, '(^|[-_\s])(logo[-_\s]*)?soc[-_\s]*2($|[-_\s])') THEN 'SOC 2 compliance badge'
WHEN dom_region = 'footer' AND regexp_matches(semantic, 'badge|award|certified|certification|compliant|trustmark|trustpilot') THEN 'footer trust badge'
WHEN NOT list_has_any(own, ['g2', 'capterra', 'trustpilot', 'getapp']) AND regexp_matches(told, '(^|[^a-z0-9])(g2|capterra|trustpilot|getapp|software advice)([-_\s]*(badge|logo|icon|review|rating))?([^a-z0-9]|$)') THEN 'third-party review platform'
WHEN regexp_matches(semantic, '(^|[-_\s])fa[-_\s]*(language|magnifying-glass|search|bars|xmark|close|(chevron|arrow)-(left|right|up|down)|whatsapp)($|[-_\s])') THEN 'Font Awesome UI control'
WHEN regexp_matches(told, '(^|[^a-z0-9])(instagram|twitter|facebook|linkedin|youtube|tiktok|pinterest)([-_\s]*(logo|icon|glyph))?([^a-z0-9]|$)') OR (NOT positive_token AND regexp_matches(semantic, '(^|[-_\s])social([-_\s]*(icon|logo|link|item|list|nav|media))?($|[-_\s])')) THEN 'social-media glyph'
WHEN image AND loose AND alt IN ('Our whole team at work, the logo on the building', 'Scenes of a big new campus, brand mark at the top') THEN 'logo embedded in body content image'
WHEN source = 'inline-svg' AND regexp_matches(semantic, 'icon[-_\s]*play|play[-_\s]*(circle|video)|video[-_\s]*(wrapper|column)|e-far-play|tabler[-_\s]*icon[-_\s]*(copyright|menu|search|play)|chakra[-_\s]*icon|kb[-_\s]*svg[-_\s]*icon|exp[-_\s]*selector[-_\s]*icon') THEN 'inline UI control'
WHEN image AND lower(trim(alt)) = 'menu' THEN 'menu UI control'
WHEN regexp_matches(ul, 'untitled[-_\s]*ui[-_\s]*logo') THEN 'Untitled UI template logo'
WHEN source = 'official-archive' AND archive_member = 'kit/claude logo.svg' AND NOT list_contains({WORDS.format("lower(coalesce(company, ''))")}, 'claude') THEN 'product or subbrand archive member'
WHEN regexp_matches(told, 'works[-_\s]*with[-_\s]*logos|enterprises?[-_\s]*logo[-_\s]*\d+') OR (NOT agrees AND regexp_matches(told, '(customer|partner)[-_\s]*logo')) THEN 'customer or partner logo'
WHEN NOT agrees AND regexp_matches(structural, '(investor|sponsor|backed([-_\s]*by)?)[-_\s]*(logo|mark)') THEN 'investor, sponsor, or backer logo'
WHEN foreign_org THEN 'foreign organization named in product or partner context'
WHEN regexp_matches(ul, 'sloane[-_\s]*logo[-_\s]*2[.]webp') THEN 'photographic avatar mislabeled as logo'
WHEN face THEN 'portrait or team-member body photo'
WHEN image AND loose AND NOT positive_token AND square AND NOT branded THEN 'unlinked square body illustration'
WHEN image AND loose AND NOT scalable AND square AND NOT branded THEN 'unlinked square body image'
WHEN loose AND NOT positive_token AND NOT branded AND regexp_matches(told, '(^|[-_\s])hero($|[-_\s])') THEN 'hero image'
WHEN image AND loose AND NOT scalable AND regexp_matches(told, 'app[-_\s]*demo|screenshot|dashboard|mockup|hero[-_\s]*photo|homepage[-_\s]*hero|adobestock|main[-_\s]*story[-_\s]*image|cover__image-background|picture of (a|an|the)|inbox with uploaded|logo[-_\s]*(editor|color[-_\s]*selection)|editable[-_\s]*brand[-_\s]*palette') THEN 'body content image'
WHEN regexp_matches(told, 'product[-_\s]*image|featured[-_\s]*products') THEN 'product image'
WHEN ratio >= 1.8 AND ratio <= 2.1 AND NOT branded AND regexp_matches(ul, '(^|[/_-])og[-_\s]*default([./_-]|$)') THEN 'default social-card image'
WHEN source = 'schema' AND NOT branded AND regexp_matches(ul, '(^|[/_-])og[-_\s]*image([./_-]|$)') THEN 'generic social-card image'
WHEN NOT home AND NOT (positive_token AND bar AND u_bare = bare) AND NOT agrees AND regexp_matches(lower(coalesce(alt, '')) || ' ' || ul, '(^|[^a-z0-9])logos?([^a-z0-9]|$)')
  AND len(list_filter({WORDS.format("lower(coalesce(alt, ''))")}, lambda w: length(w) >= 3 AND NOT list_contains(own, w) AND w NOT IN ('logo', 'icon', 'brand', 'header', 'footer', 'light', 'dark', 'white', 'black', 'mode') AND len(list_filter(own, lambda o: length(o) >= 4 AND (starts_with(o, w) OR starts_with(w, o)))) = 0)) > 0 THEN 'foreign named logo'
END AS reason,
source IN ('schema', 'og-logo', 'microdata') OR (source = 'wikimedia-commons' AND wikidata_identity_verified) OR agrees OR home OR (positive_token AND bar)
 OR (regexp_matches(lower(coalesce(local_semantic, '')), 'wordmark') AND array_to_string({WORDS.format("lower(coalesce(aria_label, ''))")}, ' ') IN (site_label, site_label || ' home', site_label || ' logo', site_label || ' wordmark'))
 OR (source = 'browser-img' AND bar AND u_bare = bare AND regexp_matches(lower(u_path), '(^|[/_.-])(logo|brand|wordmark)([/_.-]|$)')) OR (deep_official AND (archive_score >= 40 OR agrees)) OR (sitemap_official_page AND sitemap_exact_identity)
 OR (source = 'spa-bundle' AND spa_bundle_entry AND same_origin AND strong_logo_filename AND spa_identity_agreement) AS wide_evidence FROM g5)"""


@query(f"WITH {MARKS_SQL} SELECT n, reason FROM v")
def generic_asset_reasons(spark, sf):
    return vetoes.described(marks(spark, sf)).select("n", F.col("generic_reason").alias("reason"))


@query(f"WITH {MARKS_SQL} SELECT n, agrees, exact_label, foreign_org, wide_evidence FROM v")
def company_evidence(spark, sf):
    return evidence.prepared(marks(spark, sf)).select("n", evidence.agrees_with_company().alias("agrees"), evidence.exact_company_label().alias("exact_label"), evidence.names_foreign_organization().alias("foreign_org"), evidence.wide_evidence().alias("wide_evidence"))


#: Suffix rules of every kind that the hosts at hand meet, with some that they do not.
SUFFIXES = ["com", "org", "net", "example.net", "*.example.org", "!thther.example.org", "co.uk", "*.ck", "!www.ck", "", "com"]


@query("""
WITH h AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host FROM pages), p AS (SELECT *, string_split(host, '.') AS s FROM h),
w AS (SELECT *, CASE WHEN host = 'thther.example.org' OR host LIKE '%.thther.example.org' THEN 2 WHEN host LIKE '%.example.org' THEN 3 WHEN host = 'example.net' OR host LIKE '%.example.net' THEN 2 ELSE 1 END AS k FROM p)
SELECT page_id, CASE WHEN len(s) > k THEN array_to_string(s[-(k + 1):], '.') END AS registrable FROM w""")
def registrable_domains(spark, sf):
    rules = spark.createDataFrame([(s,) for s in SUFFIXES], "rule string")
    return domains.with_registrable(t(spark, sf, "pages").select("page_id", "url"), "url", rules).select("page_id", "registrable")
