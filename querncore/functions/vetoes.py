"""Generic assets: an ordered chain of rules, of which the first that holds gives a candidate its reason; null where none does.

A rule is a reason and a condition, both Columns, so the chain is one CASE that Catalyst sees whole; conditions read the candidate's columns
(``functions.evidence``, made ready by its ``prepared``) and, besides: width, height, scalable, format, content_hash, requires_rendering, rendered, archive_member, generic_asset
(struct<reason, owners array, owner_domains array, method>: what a fingerprint matched), and reviewed (the same, joined by ``operators.joins.reviewed_hashes``).
An owner of an asset is exempt from the rules that call it generic.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querncore.functions import evidence as ev
from querncore.functions.evidence import sure, txt, yes
from querncore.operators.replay import describes_embedded_logo

# Hashes of assets that come with a product, why they are none's mark, whose they are, and where these owners live.
KNOWN_HASHES = [
    ("33c1436f8c40ca2582d091c449fccc34ed9bf73f02526c5fdef44f4f06c6321b", "Wix default favicon", ["wix"]),
    ("c965a500f698483526faf92ac286047cecd825608cd1d83276de392b30a13a83", "WordPress default favicon", ["wordpress"]),
    ("9ea4f4da7050c0cc408926f6a39c253624e9babb1d43c7977cd821445a60b461", "Create React App default logo", ["react"]),
    ("dddd3a41217d3acee3effdec02946e4a26eba182c5994398e7d9dde4d585cebe", "repurposed casino favicon", ["leon", "casino"]),
    ("788f0397eb26c7151af4afc25d5478ef692b39c10035774158b500b187b4a431", "photographic avatar mislabeled as logo", []),
    ("3646840f40e10d4b14e9d62f41087a09ffe0384628d093f47337580305b18353", "foreign RealReports app icon", ["realreports"]),
    ("2f3184d54e08fe74380ab6618c1e03390638714f074b6b63fc0f9ae40212b72a", "foreign JWSatInfo favicon", ["jwsatinfo"]),
    ("242351f0a1c0aee2c1d819844cdb6334140058b4487b4bbe9477c3cc33707616", "foreign RealReports app icon", ["realreports"]),
    ("edf01f937bdf9c38ebcd30d84cb5acde5e2101e9c64c1c9b3a4a1351ea7886a0", "foreign RealReports favicon", ["realreports"]),
    ("c386396ec70db3608075b5fbfaac4ab1ccaa86ba05a68ab393ec551eb66c3e00", "Create React App default logo", ["react"]),
]
OWNER_DOMAINS = {"wix": ["wix.com"], "wordpress": ["wordpress.org", "wordpress.com"]}
PLATFORMS = ["namecheap", "matomo", "piwik", "wix", "vercel", "lovable", "webflow", "squarespace", "shopify", "godaddy", "netlify", "framer"]
PAGE_IMAGES = ["dom-img", "dom-picture", "browser-img"]
# What texts and paths say of an asset that is no company's mark.
UTILITY = r"\b(?:open|download|view)\b.{0,50}\b(?:brand|logo|wordmark)\b"
MENU_ITEM = r"(?:navigation|nav|menu)[-_\s]*item[-_\s]*icon"
MATOMO_TEXT = r"(?:^|[-_\s])default-piwik-logo(?:$|[-_\s])"
MATOMO_URL = r"/plugins/morpheus/images/logo\.svg(?:\?matomo)?$|/plugins/corehome/images/(?:applogo_\d+|favicon)\.(?:png|ico|svg)(?:[?#]|$)"
WIX_URL = r"static\.parastorage\.com/client/pfavico\.ico(?:[?#]|$)"
GODADDY_URL = r"img1\.wsimg\.com/isteam/ip/static/pwa-app/logo-default\.png"
GAMBLING = r"(?:789bet|dewancash|meriamhoki|90phut)"
SOC2 = r"(?:^|[-_\s])(?:logo[-_\s]*)?soc[-_\s]*2(?:$|[-_\s])"
TRUST_BADGE = r"(?:badge|award|certif(?:ied|ication)|compliant|trustmark|trustpilot)"
REVIEWS = r"(?:^|[^a-z0-9])(?:g2|capterra|trustpilot|getapp|software advice)(?:[-_\s]*(?:badge|logo|icon|review|rating))?(?:[^a-z0-9]|$)"
FONT_AWESOME = r"(?:^|[-_\s])fa[-_\s]*(?:language|magnifying-glass|search|bars|xmark|close|chevron-(?:left|right|up|down)|arrow-(?:left|right|up|down)|whatsapp)(?:$|[-_\s])"
NETWORKS = r"(?:^|[^a-z0-9])(?:instagram|twitter|facebook|linkedin|youtube|tiktok|pinterest)(?:[-_\s]*(?:logo|icon|glyph))?(?:[^a-z0-9]|$)"
SOCIAL = r"(?:^|[-_\s])social(?:[-_\s]*(?:icon|logo|link|item|list|nav|media))?(?:$|[-_\s])"
SVG_CONTROL = r"(?:icon[-_\s]*play|play[-_\s]*circle|play[-_\s]*video|video[-_\s]*(?:wrapper|column)|e-far-play|tabler[-_\s]*icon[-_\s]*(?:copyright|menu|search|play)|chakra[-_\s]*icon|kb[-_\s]*svg[-_\s]*icon|fxfa[-_\s]*icon[\s\S]*menuitem|pointer-events-off[^\n]{0,80}nav[-_\s]*main[-_\s]*link|exp[-_\s]*selector[-_\s]*icon)"
VECTOR_IMAGE = r"presentation[^\n]{0,240}wixui[-_\s]*vector[-_\s]*image"
MENU_ALT = r"^\s*menu\s*$"
MENU_TEXT = r"menu[-_\s]*item__icon|ico[-_\s]*gnb[-_\s]*menu|userpilot[-_\s]*enterprise[-_\s]*icon"
UNTITLED = r"untitled[-_\s]*ui[-_\s]*logo"
PRODUCT_MEMBER = r"(?i)(?:^|[\s/_.-])(copilot|claude|connect|checkout|terminal|atlas|slackbot|salesforce)(?:$|[\s/_.-])"
WORKS_WITH = r"(?:works[-_\s]*with[-_\s]*logos|enterprises?[-_\s]*logo[-_\s]*\d+)"
CUSTOMERS = r"(?:customer[-_\s]*logos?|partner[-_\s]*logos?)"
BACKERS = r"(?:investor|sponsor|backed(?:[-_\s]*by)?)[-_\s]*(?:logos?|marks?)"
SLOANE = r"sloane[-_\s]*logo[-_\s]*2\.webp"
PORTRAIT = r"(?:^|[^a-z0-9])(?:avatar|headshot|portrait|profile[-_\s]*(?:image|photo|picture)|team[-_\s]*member|staff[-_\s]*(?:image|photo|picture)|employee[-_\s]*(?:image|photo|picture)|founder[-_\s]*(?:image|photo|picture)|author[-_\s]*(?:image|photo|picture)|speaker[-_\s]*(?:image|photo|picture))(?:[^a-z0-9]|$)"
MARK_FILE = r"(?:^|[/_.-])(?:logo|wordmark|brandmark|logomark)(?:[/_.-]|$)"
RASTER_FILE = r"\.(?:avif|jpe?g|png|webp)$"
NO_NAMES = ["bg", "background", "big", "desktop", "final", "hero", "image", "img", "large", "main", "new", "photo", "pic", "picture", "site", "small", "web", "website"]
MARK_WORD = r"(?:logo|wordmark|brandmark|logomark)"
EDITOR = r"logo[-_\s]*editor"
HERO = r"(?:^|[-_\s])hero(?:$|[-_\s])"
BODY_CONTENT = r"(?:app[-_\s]*demo|screenshot|dashboard|mockup|hero[-_\s]*photo|homepage[-_\s]*hero|adobestock|main[-_\s]*story[-_\s]*image|cover__image-background|picture of (?:a|an|the)|inbox with uploaded|logo[-_\s]*(?:editor|color[-_\s]*selection)|editable[-_\s]*brand[-_\s]*palette)"
PRODUCT_IMAGE = r"(?:product[-_\s]*image|featured[-_\s]*products)"
OG_DEFAULT = r"(?:^|[/_-])og[-_\s]*default(?:[./_-]|$)"
OG_IMAGE = r"(?:^|[/_-])og[-_\s]*image(?:[./_-]|$)"
LOGO_WORD = r"(?:^|[^a-z0-9])logos?(?:[^a-z0-9]|$)"
LOGO_NOISE = ["logo", "icon", "brand", "header", "footer", "light", "dark", "white", "black", "mode"]


@dataclass(frozen=True)
class Rule:
    reason: Column | str
    when: Column


def first_reason(rules: list[Rule]) -> Column:
    """The reason of the first rule that holds; a condition that is null does not hold."""
    shown = lambda r: F.lit(r.reason) if isinstance(r.reason, str) else r.reason
    chain = F.when(sure(rules[0].when), shown(rules[0]))
    return reduce(lambda c, r: c.when(sure(r.when), shown(r)), rules[1:], chain)


def has(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + pattern)


def any_of(names: Column, held: Column) -> Column:
    return sure(F.arrays_overlap(names, held))


def reviewed_owner(match: Column, asked: Column) -> Column:
    """An owner by name and by the page's own domain, as far as either is known."""
    named = any_of(match["owners"], asked)
    at_home = sure(F.array_contains(match["owner_domains"], F.regexp_replace("_ev_host", "^www[.]", "")))
    return ((F.size(asked) == 0) | named) & F.when(txt("source_page") != "", at_home).otherwise(named)


def owner_by_name(owners: Column, asked: Column) -> Column:
    """An owner by name; where no company is asked for, by the page's domain or one above it."""
    host = F.col("_ev_host")
    under = [any_of(owners, F.array(F.lit(o))) & reduce(lambda a, b: a | b, ((host == d) | host.endswith("." + d) for d in domains)) for o, domains in OWNER_DOMAINS.items()]
    return F.when(F.size(asked) > 0, any_of(owners, asked)).otherwise(reduce(lambda a, b: a | b, under))


def portrait(square: Column) -> Column:
    """A raster picture of a person in the body: by what is said of it, or by a First_Last file name."""
    path, agrees = F.col("_ev_path"), ev.agrees_with_company()
    about = has(F.concat(path, F.lit(" "), F.col("_ev_semantic")), PORTRAIT)
    own = ev.exact_company_label() | (has(path, MARK_FILE) & agrees)
    raster = has(path, RASTER_FILE) | sure(F.lower("format").isin("avif", "jpeg", "jpg", "png", "webp"))
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")
    parts = F.filter(F.split(base, r"[-_\s]+"), lambda w: w != "")
    titled = lambda w: w.rlike("^[A-Z][a-z]{2,}$") & ~F.lower(w).isin(NO_NAMES)
    pairs = F.arrays_zip(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))).alias("a"), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).alias("b"))
    person = F.exists(pairs, lambda p: titled(p["a"]) & titled(p["b"]))
    placed = sure(F.col("source").isin(*PAGE_IMAGES, "noscript-img")) & ~yes("scalable") & (txt("dom_region").isin("", "body")) & ~yes("home_linked")
    return placed & square & (path != "") & ~(own & ~about) & raster & (about | (~agrees & person))


def generic_reason() -> Column:
    """Why a candidate is no company's own mark. For tables that ``evidence.prepared`` has been through."""
    source, agrees, c = F.col("source"), ev.agrees_with_company(), lambda n: F.col("_ev_" + n)
    structural, semantic, url, told, asked, own = map(c, ("structure", "semantic", "url", "told", "asked", "own"))
    mine = lambda *names: any_of(F.array(*map(F.lit, names)), own)
    ratio = F.when((F.col("width") > 0) & (F.col("height") > 0), F.col("width") / F.col("height"))
    square = sure(ratio.between(0.72, 1.4))
    page_image = sure(source.isin(PAGE_IMAGES))
    loose = sure(F.col("dom_region") == "body") & ~yes("home_linked")
    raster = page_image & ~yes("scalable") & loose
    branded = has(told, MARK_WORD) & ~has(semantic, EDITOR)
    known = F.coalesce(*(F.when(F.col("content_hash") == h, F.struct(F.lit(r).alias("reason"), F.array(*map(F.lit, o)).cast("array<string>").alias("owners"))) for h, r, o in KNOWN_HASHES))
    seen = F.col("generic_asset")
    seen_owner = F.when(seen["owner_domains"].isNotNull(), reviewed_owner(seen, asked)).otherwise(owner_by_name(seen["owners"], asked))
    platform = F.coalesce(*(F.when(~mine(p) & (has(semantic, rf"(?:^|[^a-z0-9]){p}(?:[\s_-]+)(?:logo|favicon|brand)(?:[^a-z0-9]|$)") | has(semantic, rf"(?:powered|hosted|secured)[\s_-]+by[\s_-]+{p}(?:[^a-z0-9]|$)")), F.lit(p)) for p in PLATFORMS))
    product = F.lower(F.regexp_extract(txt("archive_member"), PRODUCT_MEMBER, 1))
    kin = lambda w: F.exists(own, lambda c: (F.length(c) >= 4) & (c.startswith(w) | w.startswith(c)))
    stranger = F.exists(ev.words(F.col("alt")), lambda w: (F.length(w) >= 3) & ~F.array_contains(own, w) & ~kin(w) & ~w.isin(LOGO_NOISE))
    placed_here = yes("positive_token") & ev.in_bar() & ev.same_site()
    return first_reason(
        [
            Rule("unresolved SVG document styles", yes("requires_rendering") & ~yes("rendered")),
            Rule("brand-asset utility control", has(txt("local_semantic"), UTILITY)),
            Rule("navigation item icon", ~yes("positive_token") & has(structural, MENU_ITEM)),
            Rule(F.col("reviewed")["reason"], F.col("reviewed").isNotNull() & ~reviewed_owner(F.col("reviewed"), asked)),
            Rule(known["reason"], known.isNotNull() & ~owner_by_name(known["owners"], asked)),
            Rule(F.concat(seen["reason"], F.lit(" via "), F.coalesce(seen["method"], F.lit("visual fingerprint"))), (F.coalesce(seen["reason"], F.lit("")) != "") & seen["owners"].isNotNull() & ~seen_owner),
            Rule(F.concat(F.lit("foreign platform brand: "), platform), platform.isNotNull()),
            Rule("Wix default favicon", ~mine("wix") & has(url, WIX_URL)),
            Rule("Matomo default application logo", ~mine("matomo", "piwik") & (has(semantic, MATOMO_TEXT) | has(url, MATOMO_URL))),
            Rule("GoDaddy default PWA logo", ~mine("godaddy") & has(url, GODADDY_URL)),
            Rule("foreign gambling brand", ~mine("789bet", "meriamhoki", "90phut") & has(told, GAMBLING)),
            Rule("SOC 2 compliance badge", has(told, SOC2)),
            Rule("footer trust badge", (F.col("dom_region") == "footer") & has(semantic, TRUST_BADGE)),
            Rule("third-party review platform", has(told, REVIEWS) & ~mine("g2", "capterra", "trustpilot", "getapp")),
            Rule("Font Awesome UI control", has(semantic, FONT_AWESOME)),
            Rule("social-media glyph", has(told, NETWORKS) | (has(semantic, SOCIAL) & ~yes("positive_token"))),
            Rule("logo embedded in body content image", page_image & loose & describes_embedded_logo(F.col("alt"))),
            Rule("inline UI control", (source == "inline-svg") & (has(semantic, SVG_CONTROL) | (square & has(semantic, VECTOR_IMAGE)))),
            Rule("menu UI control", page_image & (has(txt("alt"), MENU_ALT) | has(told, MENU_TEXT))),
            Rule("Untitled UI template logo", has(url, UNTITLED)),
            Rule("product or subbrand archive member", (source == "official-archive") & (product != "") & ~F.array_contains(ev.words(F.col("company")), product)),
            Rule("customer or partner logo", has(told, WORKS_WITH) | (has(told, CUSTOMERS) & ~agrees)),
            Rule("investor, sponsor, or backer logo", has(structural, BACKERS) & ~agrees),
            Rule("foreign organization named in product or partner context", ev.names_foreign_organization()),
            Rule("photographic avatar mislabeled as logo", has(url, SLOANE)),
            Rule("portrait or team-member body photo", portrait(square)),
            Rule("unlinked square body illustration", page_image & loose & ~yes("positive_token") & square & ~branded),
            Rule("unlinked square body image", raster & square & ~branded),
            Rule("hero image", loose & ~yes("positive_token") & ~branded & has(told, HERO)),
            Rule("body content image", raster & has(told, BODY_CONTENT)),
            Rule("product image", has(told, PRODUCT_IMAGE)),
            Rule("default social-card image", ratio.between(1.8, 2.1) & has(url, OG_DEFAULT) & ~branded),
            Rule("generic social-card image", (source == "schema") & has(url, OG_IMAGE) & ~branded),
            Rule("foreign named logo", ~yes("home_linked") & ~placed_here & has(F.concat(F.lower(txt("alt")), F.lit(" "), url), LOGO_WORD) & stranger & ~agrees),
        ]
    )


def described(df: DataFrame) -> DataFrame:
    """df with what the scores take from a candidate's texts: generic_reason, agrees_with_company, exact_company_label, wide_evidence."""
    df = ev.prepared(df).withColumns({"generic_reason": generic_reason(), "agrees_with_company": ev.agrees_with_company(), "exact_company_label": ev.exact_company_label(), "wide_evidence": ev.wide_evidence()})
    return ev.finished(df)
