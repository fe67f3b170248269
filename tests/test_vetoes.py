"""The veto chain: a literal case for each rule and for who is exempt; evidence of a company; registrable domains."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from querncore.functions import domains, evidence, vetoes
from querncore.operators import joins

SCHEMA = """source string, company string, stated_company string, site_label string, source_page string, url string, resolved_url string, alt string, aria_label string, semantic_text string, local_semantic string,
class_tokens array<string>, dom_region string, home_linked boolean, positive_token boolean, width double, height double, scalable boolean, format string, content_hash string, requires_rendering boolean, rendered boolean,
archive_member string, generic_asset struct<reason:string,owners:array<string>,owner_domains:array<string>,method:string>, wikidata_identity_verified boolean, deep_official boolean, archive_score double,
sitemap_official_page boolean, sitemap_exact_identity boolean, spa_bundle_entry boolean, same_origin boolean, strong_logo_filename boolean, spa_identity_agreement boolean"""
NAMES = [x.split()[0] for x in SCHEMA.replace("struct<reason:string,owners:array<string>,owner_domains:array<string>,method:string>", "struct").split(",")]
WIX, REACT = "33c1436f8c40ca2582d091c449fccc34ed9bf73f02526c5fdef44f4f06c6321b", "9ea4f4da7050c0cc408926f6a39c253624e9babb1d43c7977cd821445a60b461"
IMG = {"source": "dom-img", "company": "Acme", "source_page": "https://acme.test/", "url": "https://cdn.test/a/file.png", "width": 240.0, "height": 80.0, "site_label": "acme"}
SVG = IMG | {"source": "inline-svg", "url": "data:image/svg+xml;base64,AA", "scalable": True}
SEEN = ("builder mark", ["builder"], None, None)

CASES = [
    (IMG, None),
    (IMG | {"requires_rendering": True}, "unresolved SVG document styles"),
    (IMG | {"requires_rendering": True, "rendered": True}, None),
    (IMG | {"local_semantic": "Download our full brand book"}, "brand-asset utility control"),
    (IMG | {"local_semantic": "reopening the brand"}, None),
    (IMG | {"class_tokens": ["nav", "menu-item-icon"]}, "navigation item icon"),
    (IMG | {"class_tokens": ["menu-item-icon"], "positive_token": True}, None),
    (IMG | {"content_hash": "aa"}, "reviewed mark"),
    (IMG | {"content_hash": "aa", "company": "Owner"}, "reviewed mark"),
    (IMG | {"content_hash": "aa", "company": "Owner", "source_page": "https://www.owner.test/x"}, None),
    (IMG | {"content_hash": "aa", "company": None, "source_page": "https://owner.test/"}, None),
    (IMG | {"content_hash": "aa", "company": None, "source_page": "https://sub.owner.test/"}, "reviewed mark"),
    (IMG | {"content_hash": "aa", "company": "Owner", "source_page": None}, None),
    (IMG | {"content_hash": WIX}, "Wix default favicon"),
    (IMG | {"content_hash": WIX, "company": "Wix Ltd"}, None),
    (IMG | {"content_hash": WIX, "company": None, "source_page": "https://shop.wix.com/"}, None),
    (IMG | {"content_hash": WIX, "company": None, "source_page": "https://notwix.com/"}, "Wix default favicon"),
    (IMG | {"content_hash": REACT}, "Create React App default logo"),
    (IMG | {"content_hash": "3646840f40e10d4b14e9d62f41087a09ffe0384628d093f47337580305b18353", "company": "RealReports"}, None),
    (IMG | {"generic_asset": SEEN}, "builder mark via visual fingerprint"),
    (IMG | {"generic_asset": (*SEEN[:3], "pixels")}, "builder mark via pixels"),
    (IMG | {"generic_asset": SEEN, "company": "Builder"}, None),
    (IMG | {"generic_asset": ("builder mark", ["builder"], ["builder.test"], None), "company": "Builder"}, "builder mark via visual fingerprint"),
    (IMG | {"generic_asset": ("builder mark", ["builder"], ["builder.test"], None), "company": "Builder", "source_page": "https://builder.test/"}, None),
    (IMG | {"alt": "Powered by Lovable logo"}, "foreign platform brand: lovable"),
    (IMG | {"alt": "Powered by Lovable logo", "company": "Lovable", "source_page": "https://lovable.dev/", "dom_region": "header"}, None),
    (IMG | {"semantic_text": "Namecheap Logo", "source_page": "https://www.namecheap.com/"}, None),
    (IMG | {"url": "https://static.parastorage.com/client/pfavico.ico#x"}, "Wix default favicon"),
    (IMG | {"url": "https://x.test/plugins/CoreHome/images/applogo_256.png"}, "Matomo default application logo"),
    (IMG | {"semantic_text": "default-piwik-logo Matomo"}, "foreign platform brand: piwik"),
    (IMG | {"semantic_text": "default-piwik-logo", "company": "Piwik"}, None),
    (IMG | {"url": "https://img1.wsimg.com/isteam/ip/static/pwa-app/logo-default.png/:/rs=w:512"}, "GoDaddy default PWA logo"),
    (IMG | {"url": "https://x.test/logo-789bet.png", "home_linked": True}, "foreign gambling brand"),
    (IMG | {"url": "https://x.test/logo-soc-2.svg"}, None),
    (IMG | {"semantic_text": "logo soc 2 type"}, "SOC 2 compliance badge"),
    (IMG | {"semantic_text": "certified partner of the year", "dom_region": "footer"}, "footer trust badge"),
    (IMG | {"semantic_text": "certified partner of the year", "dom_region": "header"}, None),
    (IMG | {"url": "https://x.test/g2-badge.svg"}, "third-party review platform"),
    (IMG | {"url": "https://x.test/g2-badge.svg", "company": "G2"}, None),
    (IMG | {"semantic_text": "svg-inline--fa fa-language navbar", "home_linked": True}, "Font Awesome UI control"),
    (IMG | {"url": "https://x.test/instagram.svg", "home_linked": True}, "social-media glyph"),
    (SVG | {"semantic_text": "navbar-social-link", "home_linked": True}, "social-media glyph"),
    (SVG | {"semantic_text": "navbar-social-link", "positive_token": True}, None),
    (IMG | {"alt": "Phone, rear view, Acme logo in the center", "dom_region": "body", "positive_token": True}, "logo embedded in body content image"),
    (IMG | {"alt": "Acme logo with honey dripping", "dom_region": "body", "positive_token": True}, None),
    (SVG | {"semantic_text": "icon_play lightbox", "home_linked": True}, "inline UI control"),
    (SVG | {"semantic_text": "presentation wixui-vector-image", "width": 64.0, "height": 64.0}, "inline UI control"),
    (SVG | {"semantic_text": "presentation wixui-vector-image"}, None),
    (IMG | {"alt": " MENU "}, "menu UI control"),
    (IMG | {"url": "https://cdn.test/untitled-ui-logo.png", "home_linked": True}, "Untitled UI template logo"),
    (IMG | {"source": "official-archive", "archive_member": "kit/Claude logo.svg"}, "product or subbrand archive member"),
    (IMG | {"source": "official-archive", "archive_member": "kit/Claude logo.svg", "company": "Claude Inc"}, None),
    (IMG | {"alt": "Enterprises logo 9"}, "customer or partner logo"),
    (IMG | {"semantic_text": "customer-logos"}, "customer or partner logo"),
    (IMG | {"semantic_text": "customer-logos", "url": "https://cdn.test/acme.png"}, None),
    (IMG | {"class_tokens": ["backed-by", "logos"]}, "investor, sponsor, or backer logo"),
    (IMG | {"alt": "Partner Labs logo", "semantic_text": "product dropdown menuitem", "dom_region": "nav"}, "foreign organization named in product or partner context"),
    (IMG | {"alt": "Partner Labs logo", "home_linked": True}, "foreign organization named in product or partner context"),
    (IMG | {"alt": "Acme Deutschland logo", "semantic_text": "product dropdown menuitem"}, None),
    (IMG | {"alt": "Rival logo", "company": None, "home_linked": True}, "foreign organization named in product or partner context"),
    (IMG | {"url": "https://x.test/Sloane logo_2.webp", "home_linked": True}, "photographic avatar mislabeled as logo"),
    (IMG | {"url": "https://cdn.test/697_Ronel_Veksler_WB_small_BG.JPG", "width": 800.0, "height": 800.0, "positive_token": True}, "portrait or team-member body photo"),
    (IMG | {"url": "https://cdn.test/Main_Image.jpg", "width": 800.0, "height": 800.0, "positive_token": True}, None),
    (IMG | {"url": "https://cdn.test/Founder_Institute_logo.jpg", "width": 512.0, "height": 512.0, "company": "Founder Institute", "dom_region": "body", "positive_token": True}, None),
    (IMG | {"url": "https://acme.test/image/123", "format": "JPEG", "width": 600.0, "height": 600.0, "alt": "Acme founder portrait", "dom_region": "body"}, "portrait or team-member body photo"),
    (IMG | {"alt": "How to grow", "dom_region": "body", "width": 700.0, "height": 650.0}, "unlinked square body illustration"),
    (IMG | {"alt": "How to grow", "dom_region": "body", "width": 700.0, "height": 650.0, "positive_token": True}, "unlinked square body image"),
    (IMG | {"alt": "How to grow", "dom_region": "body", "width": 700.0, "height": 650.0, "positive_token": True, "scalable": True}, None),
    (IMG | {"semantic_text": "hero-section", "dom_region": "body", "width": 1200.0, "height": 500.0}, "hero image"),
    (IMG | {"alt": "Dashboard screenshot", "dom_region": "body"}, "body content image"),
    (IMG | {"semantic_text": "featured-products", "dom_region": "header"}, "product image"),
    (IMG | {"source": "schema", "url": "https://x.test/images/og-default.png", "width": 1200.0, "height": 630.0}, "default social-card image"),
    (IMG | {"source": "schema", "url": "https://x.test/og_image.png"}, "generic social-card image"),
    (IMG | {"alt": "MGH Logo", "dom_region": "header", "positive_token": True}, "foreign named logo"),
    (IMG | {"alt": "Sponsor Logo", "dom_region": "header", "positive_token": True, "url": "https://www.acme.test/images/logo-dark.png"}, None),
    (IMG | {"alt": "Watershed Logo", "company": "Watershed Informatics", "url": "https://x.test/watershed-logo.svg"}, None),
]


@pytest.fixture(scope="module")
def judged(spark):
    rows = spark.createDataFrame([tuple(c.get(n) for n in NAMES) for c, _ in CASES], SCHEMA)
    rows = rows.withColumn("k", F.monotonically_increasing_id()).repartition(2)
    catalogue = spark.createDataFrame([("aa", "reviewed mark", ["owner"], ["owner.test"]), (None, "x", None, None)], "sha256 string, reason string, owners array<string>, owner_domains array<string>")
    rows = joins.reviewed_hashes(rows, "content_hash", catalogue)
    return evidence.prepared(rows).select("k", vetoes.generic_reason().alias("reason"), evidence.wide_evidence().alias("wide"), evidence.exact_company_label().alias("exact"), evidence.agrees_with_company().alias("agrees")).orderBy("k").collect()


@pytest.mark.parametrize("k", range(len(CASES)))
def test_reason(judged, k):
    assert judged[k].reason == CASES[k][1], CASES[k][0]


def test_every_rule_has_a_case(spark):
    import inspect
    import re

    told = set(re.findall(r'Rule\("([^"]+)"', inspect.getsource(vetoes.generic_reason)))
    assert len(told) > 25 and told <= {r for _, r in CASES}


def test_first_reason_ignores_null_conditions(spark):
    chain = vetoes.first_reason([vetoes.Rule("a", F.col("x") > 1), vetoes.Rule("b", F.col("x").isNull()), vetoes.Rule(F.col("y"), F.lit(True))])
    got = spark.createDataFrame([(2, "p"), (None, "p"), (1, "p"), (1, None)], "x int, y string").select(chain.alias("r")).collect()
    assert [r.r for r in got] == ["a", "b", "p", None]


WIDE = [
    ({}, False),
    ({"source": "og-logo"}, True),
    ({"source": "wikimedia-commons"}, False),
    ({"source": "wikimedia-commons", "wikidata_identity_verified": True}, True),
    ({"alt": "the ACME building"}, True),
    ({"company": "Co Inc", "alt": "co"}, False),
    ({"home_linked": True}, True),
    ({"positive_token": True, "dom_region": "body"}, False),
    ({"positive_token": True, "dom_region": "nav"}, True),
    ({"local_semantic": "Wordmark", "aria_label": "Site  HOME", "site_label": "site"}, True),
    ({"local_semantic": "Wordmark", "aria_label": "home", "site_label": ""}, False),
    ({"source": "browser-img", "dom_region": "header", "url": "https://www.acme.test/a/Brand.png"}, True),
    ({"source": "browser-img", "dom_region": "header", "url": "https://cdn.test/a/brand.png"}, False),
    ({"source": "browser-img", "dom_region": "header", "url": "https://acme.test/a/branding.png", "company": None}, False),
    ({"deep_official": True, "archive_score": 39.0}, False),
    ({"deep_official": True, "archive_score": 40.0}, True),
    ({"sitemap_official_page": True}, False),
    ({"sitemap_official_page": True, "sitemap_exact_identity": True}, True),
    ({"source": "spa-bundle", "spa_bundle_entry": True, "same_origin": True, "strong_logo_filename": True}, False),
    ({"source": "spa-bundle", "spa_bundle_entry": True, "same_origin": True, "strong_logo_filename": True, "spa_identity_agreement": True}, True),
]


def test_wide_evidence(spark):
    rows = spark.createDataFrame([(k, *((IMG | c).get(n) for n in NAMES)) for k, (c, _) in enumerate(WIDE)], "k int, " + SCHEMA)
    assert [r.w for r in evidence.prepared(rows).select("k", evidence.wide_evidence().alias("w")).orderBy("k").collect()] == [w for _, w in WIDE]


HOSTS = {
    "www.acme.com": "acme.com", "acme.com": "acme.com", "com": None, "a.b.acme.co.uk": "acme.co.uk", "co.uk": None, "uk": None, "b.uk": "b.uk", "x.y.ck": "x.y.ck", "y.ck": None, "a.x.y.ck": "x.y.ck", "www.ck": "www.ck", "a.www.ck": "www.ck",
    "a.b.unlisted": "b.unlisted", "localhost": None, "10.0.0.1": None, "ACME.Com.": "acme.com", "acme.com:8080": "acme.com", "[::1]": None, "": None, "a..com": None, "me.github.example": "me.github.example", "www.github.example": "www.github.example", "deep.a.kobe.jp": "deep.a.kobe.jp", "city.kobe.jp": "city.kobe.jp", "x.city.kobe.jp": "city.kobe.jp",
}
RULES = ["com", "uk", "co.uk", "*.ck", "!www.ck", "github.example", "jp", "*.kobe.jp", "!city.kobe.jp", None, "", "CO.UK "]


@pytest.mark.parametrize("limit", [domains.BROADCAST_RULES, 0])
def test_registrable_domains(spark, monkeypatch, limit):
    monkeypatch.setattr(domains, "BROADCAST_RULES", limit)
    rules = spark.createDataFrame([(r,) for r in RULES], "rule string")
    rows = spark.createDataFrame([(h, 1) for h in [*HOSTS, None]], "host string, _labels int")
    got = {r.host: r.registrable for r in domains.with_registrable(rows.drop("_labels"), "host", rules, is_host=True).collect()}
    assert got == HOSTS | {None: None}
    none = domains.with_registrable(rows.drop("_labels"), "host", rules.limit(0), is_host=True).collect()
    assert {r.host: r.registrable for r in none}["a.b.acme.co.uk"] == "co.uk"
