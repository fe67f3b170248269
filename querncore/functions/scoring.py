"""Candidate features and scores as Column expressions: no UDF, so Catalyst prunes and folds them.

Columns of a candidate that the expressions read: source, url, sizes, type, declared_width, declared_height, width, height, content_width,
content_height, positive_token, home_linked, dom_region, negative_context, banner, theme, scalable, high_resolution, agrees_with_company,
exact_company_label, generic_reason, clipping_risk, likely_clipped, stacked, explicit_symbol, wide_words, canvas_background,
foreground_occupancy, box_occupancy, contrast_light, contrast_dark, suitability, identity_verified, eligible_roles, wide_evidence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from querncore.functions.capture import percent_decoded
from querncore.functions.numbers import clamp, half_up

# How much a discovery source says for itself.
SOURCE_WEIGHTS = {
    "schema": 30, "og-logo": 27, "microdata": 26, "inline-svg": 24, "browser-inline-svg": 24, "browser-img": 12,
    "browser-css-background": 8, "browser-css-sprite": 8, "dom-img": 10, "dom-picture": 10, "noscript-img": 8,
    "manifest": 22, "apple": 20, "mask-icon": 20, "bimi": 18, "ms-tile": 17, "html-icon": 16, "jina-screenshot": 18,
    "besticon": 12, "google-favicon": 10, "duckduckgo-favicon": 9, "root-favicon": 5, "social-banner": -30,
    "wikimedia-commons": 24, "linkedin": 20,
}
FAVICON_SOURCES = ("manifest", "apple", "mask-icon", "bimi", "ms-tile", "html-icon", "besticon", "google-favicon", "duckduckgo-favicon", "root-favicon")
AUTHORITATIVE_SOURCES = ("schema", "og-logo", "microdata")
DOM_SOURCES = ("dom-img", "dom-picture", "noscript-img", "browser-img")


def c(name: str) -> Column:
    return F.col(name)


def yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def in_bar() -> Column:
    return F.coalesce(c("dom_region").isin("header", "nav"), F.lit(False))


def source_weight() -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in SOURCE_WEIGHTS.items() for x in kv])[c("source")], F.lit(0)).cast("double")


def _pairs() -> Column:
    """Products of the WxH sizes of a declaration."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c("sizes"), F.lit(""))), F.lit("([0-9]+x[0-9]+)"), F.lit(1))
    return F.transform(found, lambda s: F.split(s, "x")[0].cast("double") * F.split(s, "x")[1].cast("double"))


def declared_pixels() -> Column:
    vector = F.lower(F.concat_ws(" ", F.coalesce(c("type"), F.lit("")), c("url"))).contains("svg")
    rendered = F.coalesce(c("declared_width") * c("declared_height"), F.lit(0.0)).cast("double")
    return F.when(vector, F.lit(1e12)).when(F.lower(c("sizes")) == "any", F.lit(1e11)).otherwise(F.greatest(rendered, F.coalesce(F.array_max(_pairs()), F.lit(0.0))))


def discovery_priority() -> Column:
    """Order in which candidates are looked at."""
    bonus = F.least(F.lit(40.0), 2 * F.log2(F.greatest(F.lit(1.0), declared_pixels())))
    points = F.when(yes("positive_token"), 90).otherwise(0) + F.when(yes("home_linked"), 80).otherwise(0) + F.when(in_bar(), 55).otherwise(0)
    return source_weight() * 10 + points - F.when(yes("negative_context") | yes("banner"), 200).otherwise(0) - F.when(c("source") == "social-banner", 300).otherwise(0) + bonus


def provisional_queue() -> Column:
    """wide, favicon, icon, or null for candidates that are not looked at."""
    bare = c("source").isin(*DOM_SOURCES) & ~yes("positive_token") & ~yes("home_linked") & ~in_bar()
    first = F.regexp_extract(F.lower(F.coalesce(c("sizes"), F.lit(""))), "([0-9]+)x([0-9]+)", 1), F.regexp_extract(F.lower(F.coalesce(c("sizes"), F.lit(""))), "([0-9]+)x([0-9]+)", 2)
    declared = F.when((c("declared_width") > 0) & (c("declared_height") > 0), c("declared_width") / c("declared_height"))
    ratio = F.coalesce(F.try_divide(first[0].try_cast("double"), first[1].try_cast("double")), declared)
    return (
        F.when(yes("negative_context") | yes("banner") | (c("source") == "social-banner") | bare, F.lit(None).cast("string"))
        .when(ratio >= 1.8, "wide")
        .when(c("source").isin(*FAVICON_SOURCES), "favicon")
        .when(c("source").isin(*AUTHORITATIVE_SOURCES), "wide")
        .otherwise("icon")
    )


def ratio() -> Column:
    return F.when((c("width") > 0) & (c("height") > 0), c("width") / c("height"))


def content_ratio() -> Column:
    return F.when((c("content_width") > 0) & (c("content_height") > 0), c("content_width") / c("content_height"))


def square() -> Column:
    return F.coalesce(ratio().between(0.72, 1.4), F.lit(False))


def near_empty() -> Column:
    return F.coalesce((c("canvas_background") == "transparent") & (c("foreground_occupancy") < 0.005), F.lit(False))


def strong_wide_evidence() -> Column:
    return yes("home_linked") | in_bar() | c("source").isin(*AUTHORITATIVE_SOURCES)


def wide() -> Column:
    r = F.coalesce(content_ratio(), ratio())
    relaxed = (ratio() >= 1.45) & (ratio() < 1.8) & (c("width") >= 120) & (F.least("width", "height") >= 36) & strong_wide_evidence()
    compact = (r >= 1.8) & (r < 2.2) & ~yes("wide_words")
    shaped = (r >= 1.8) & ((r <= 12) | ((r <= 14) & strong_wide_evidence()))
    return F.coalesce(~near_empty() & ~yes("stacked") & ~yes("explicit_symbol") & ~F.coalesce(compact, F.lit(False)) & (F.coalesce(shaped, F.lit(False)) | F.coalesce(relaxed, F.lit(False))), F.lit(False))


def confidence() -> Column:
    """What all role scores start from."""
    p = lambda cond, n: F.when(cond, n).otherwise(0)
    small = F.coalesce((c("width") > 0) & (c("height") > 0) & (F.least("width", "height") < 32), F.lit(False))
    return (
        source_weight()
        + p(yes("positive_token") | F.lower(c("url")).rlike("logo|brand|wordmark"), 15)
        + p(in_bar(), 18)
        + p(yes("home_linked"), 12)
        + p(yes("agrees_with_company"), 12)
        + p(yes("exact_company_label"), 6)
        + p(yes("negative_context"), -35)
        + p(c("generic_reason").isNotNull(), -100)
        + p(c("source") == "social-banner", -30)
        + p(yes("high_resolution"), 8)
        + p(yes("scalable"), 7)
        + F.when(c("theme") == "color", 3).when((c("theme") == "unknown") & c("source").isin("official-archive", "spa-bundle"), 2).otherwise(0)
        + p(small, -15)
        + F.when(yes("likely_clipped"), -55).when(c("clipping_risk") >= 0.5, -3).otherwise(0)
    )


def role_scores() -> Column:
    """icon, wide and favicon scores of 0 to 100 with one decimal."""
    r = lambda x: half_up(clamp(x.cast("double"), 0.0, 100.0), 1)
    fav, base = c("source").isin(*FAVICON_SOURCES), confidence()
    icon = base + F.when(square(), 28).otherwise(-12) + F.when(fav, 5).otherwise(0)
    broad = base + F.when(wide(), 30).otherwise(-18) + F.when(fav, -18).otherwise(0)
    tiny = base + F.when(fav, 28).otherwise(-22) + F.when(square(), 8).otherwise(0)
    return F.struct(r(icon).alias("icon"), r(broad).alias("wide"), r(tiny).alias("favicon"))


def predicted_roles(scores: str = "role_scores") -> Column:
    """The roles that a scored candidate may take, in the order icon, wide, favicon."""
    s = F.col(scores)
    fav = c("source").isin(*FAVICON_SOURCES)
    safe = ~yes("negative_context") & c("generic_reason").isNull()
    may = lambda role: c("eligible_roles").isNull() | F.array_contains("eligible_roles", role)
    placed = yes("home_linked") | (yes("positive_token") & in_bar())
    sized = F.coalesce(~((c("width") > 0) & (c("height") > 0)), F.lit(True)) | (F.least("width", "height") >= 32) | (yes("scalable") & (yes("positive_token") | yes("agrees_with_company")))
    shape_ok = (c("source") != "bimi") | F.coalesce((content_ratio() < 1.8) & square(), F.lit(False))
    backed = fav | c("source").isin(*AUTHORITATIVE_SOURCES) | yes("identity_verified") | yes("agrees_with_company") | placed
    icon = may("icon") & (s["icon"] >= 35) & safe & sized & (square() | ratio().isNull()) & shape_ok & ~yes("likely_clipped") & backed
    broad = may("wide") & (s["wide"] >= 35) & safe & ~near_empty() & ~yes("likely_clipped") & (wide() | ratio().isNull()) & yes("wide_evidence")
    tiny = (s["favicon"] >= 35) & fav & ~yes("likely_clipped")
    return F.array_compact(F.array(F.when(icon, "icon"), F.when(broad, "wide"), F.when(tiny, "favicon")))


def confidence_band(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 45, "medium").otherwise("low")


def icon_rejections(surface: str | None = None) -> Column:
    """Why a measured candidate cannot be an icon; empty if it can."""
    clear = c("canvas_background") == "transparent"
    if surface in ("light", "dark"):
        poor = F.when(clear & (F.coalesce(c(f"contrast_{surface}"), F.lit(0.0)) < 0.08), f"insufficient contrast on {surface} surface")
    else:
        best = F.greatest(F.coalesce("contrast_light", F.lit(0.0)), F.coalesce("contrast_dark", F.lit(0.0)))
        poor = F.when(clear & (best < 0.08), "insufficient contrast on light and dark surfaces")
    return F.array_compact(F.array(F.when(c("foreground_occupancy") < 0.015, "negligible foreground occupancy"), F.when(c("box_occupancy") < 0.08, "visible content box is too small"), poor))


def edge() -> Column:
    """The shorter side; a side that is missing or 0 is no bound."""
    side = lambda n: F.when(c(n) > 0, c(n).cast("double")).otherwise(float("inf"))
    return F.least(side("width"), side("height"))


def icon_size_bonus() -> Column:
    return F.when(~c("source").isin(*FAVICON_SOURCES), 0).when(edge() >= 180, 8).when(edge() >= 96, 4).otherwise(0)


def icon_effective(scores: str = "role_scores") -> Column:
    padded = F.coalesce((content_ratio() >= 1.8) & (ratio() < 1.8), F.lit(False))
    soft = F.coalesce((c("clipping_risk") >= 0.5) & ~yes("likely_clipped"), F.lit(False))
    return F.coalesce(F.col(scores)["icon"], F.lit(0.0)) - F.when(padded, 40).otherwise(0) - F.when(yes("stacked"), 40).otherwise(0) - F.when(soft, 3).otherwise(0) + icon_size_bonus()


def favicon_rank(scores: str = "role_scores", roles: str = "predicted_roles") -> Column:
    size = F.when(edge() <= 64, 40).when(edge() <= 128, 25).when(edge() <= 256, 10).otherwise(0)
    return size + 0.6 * F.coalesce("suitability", F.lit(0.0)) + F.when(F.array_contains(roles, "icon"), 8).otherwise(0) + F.when(c("source") == "html-icon", 1).otherwise(0) + 0.01 * F.coalesce(F.col(scores)["favicon"], F.lit(0.0))


def variant_theme(semantic: Column, themes: Column, background: Column) -> Column:
    """light, dark, any or unknown: measured contrast, then what is declared, then words of the file's name and context."""
    light, dark = c("contrast_light"), c("contrast_dark")
    hi, lo = F.greatest(light, dark), F.least(light, dark)
    measured = (background == "transparent") & (hi >= 0.3) & (lo <= 0.15) & (hi >= 3 * lo)
    told = F.array_distinct(F.filter(F.coalesce(themes, F.array().cast("array<string>")), lambda t: t.isin("light", "dark")))
    s = F.lower(semantic)
    return (
        F.when(measured, F.when(light > dark, "light").otherwise("dark"))
        .when(F.size(told) > 1, "any")
        .when(F.size(told) == 1, F.get(told, F.lit(0)))
        .when(s.rlike("(^|[-_ ./])(white|ivory|light|reversed?)($|[-_ ./])"), "dark")
        .when(s.rlike("(^|[-_ ./])(black|slate|dark)($|[-_ ./])"), "light")
        .otherwise("unknown")
    )


def variant_color(semantic: Column, told: Column) -> Column:
    s = F.lower(semantic)
    return (
        F.when(told.isin("color", "white", "black"), told)
        .when(s.rlike("(^|[-_ ./])(white|ivory|reversed?)($|[-_ ./])"), "white")
        .when(s.rlike("(^|[-_ ./])(black|slate)($|[-_ ./])"), "black")
        .when(s.rlike("(^|[-_ ./])(colou?r|full-?colou?r)($|[-_ ./])"), "color")
        .otherwise("unknown")
    )


def preference_score(wanted: dict[str, str]) -> Column:
    """+2 for each variant column (theme, color, background) as wanted, +1 for any, -2 for another known one; "any" wants nothing."""
    total = F.lit(0)
    for key in ("theme", "color", "background"):
        want = wanted.get(key, "any")
        if want != "any":
            total = total + F.when(c(key) == want, 2).when(c(key) == "any", 1).when(F.coalesce(c(key), F.lit("unknown")) != "unknown", -2).otherwise(0)
    return total


def company_agreement(text: Column, company: Column) -> Column:
    """Every word of the company's name (without legal suffixes) is a word of the text."""
    words = lambda t: F.filter(F.split(F.regexp_replace(F.lower(t), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    name = F.filter(words(company), lambda w: ~w.isin("inc", "llc", "ltd", "corp", "co", "gmbh", "plc", "ag", "sa", "company", "corporation", "limited"))
    return (F.size(name) > 0) & (F.size(F.array_except(name, words(text))) == 0)


# What an archive's members are called, what they are not, products that are no company's logo, and words that companies share.
WORDMARK_MEMBER = r"(^|[\s/_.-])(wordmark|lockup|horizontal|primary|full[-_\s]*logo|logo[-_\s]*(primary|horizontal))($|[\s/_.-])"
LOGO_MEMBER = r"(^|[\s/_.-])(logo|wordmark|lockup)($|[\s/_.-])"
NOT_A_LOGO = r"__macosx|(^|/)\._|badge|powered[-_\s]*by|screenshot|headshot|deprecated|legacy|(^|[\s/_.-])(icon|symbol|glyph|vertical|stacked|favicon|app[-_\s]*icon)($|[\s/_.-])"
PRODUCT = r"(^|[\s/_.-])(copilot|claude|connect|checkout|terminal|atlas|slackbot|salesforce)($|[\s/_.-])"
LEGAL_WORDS = ("inc", "llc", "ltd", "corp", "corporation", "company", "technologies", "technology", "tech", "center")


def _named(text: Column) -> Column:
    """Words of a name without those that companies share."""
    left = F.regexp_replace(F.lower(text), r"\b(" + "|".join((*LEGAL_WORDS, "co")) + r")\b", " ")
    return F.filter(F.split(F.regexp_replace(left, "[^a-z0-9]+", " "), " "), lambda w: w != "")


def archive_member_score(member: Column, company: Column, context: Column) -> Column:
    """How likely an archive's member is a company's wordmark, by its percent-decoded path: less 80 for what is no logo, 100 for another product's. Null
    for other kinds of files and where a percent sign starts no byte."""
    m, name = F.lower(F.replace(percent_decoded(member), F.lit("\\"), F.lit("/"))), _named(company)
    kind = F.when(m.endswith(".svg"), 30).when(m.endswith(".png"), 18).when(m.endswith(".webp"), 12)
    role = F.when(m.rlike(WORDMARK_MEMBER), 45).when(m.rlike(LOGO_MEMBER), 18).otherwise(0)
    hay = F.array_join(_named(m), "")
    agrees = F.exists(name, lambda w: (F.length(w) >= 3) & F.contains(hay, w))
    product = F.regexp_extract(m, PRODUCT, 2)
    against = F.when(m.rlike(NOT_A_LOGO), 80).otherwise(0) + F.when((product != "") & ~F.array_contains(name, product), 100).otherwise(0)
    return kind + role + F.when(agrees, 35).otherwise(0) + F.when(F.lower(context).rlike("brand|press|media|logo"), 8).otherwise(0) - against


def acronym_agreement(text: Column, company: Column) -> Column:
    """The first letters of the company's words (n for and), three at least, stand in the text as a word or before logo, wordmark or lockup."""
    words = F.filter(F.split(F.regexp_replace(F.lower(company), "[^a-z0-9]+", " "), " "), lambda w: (w != "") & ~w.isin(*LEGAL_WORDS))
    letters = F.array_join(F.transform(words, lambda w: F.when(w == "and", "n").otherwise(F.substring(w, 1, 1))), "")
    return (F.length(letters) >= 3) & F.rlike(F.lower(text), F.concat(F.lit("(^|[/_.-])"), letters, F.lit("([/_.-]|logo|wordmark|lockup)")))


def candidate_priority() -> Column:
    """Which of a page's candidates go first: 100 for what the site says of itself, 80 for the home link, 60 for the header or menu, 40 for a mark's word."""
    points = [(c("source").isin(*AUTHORITATIVE_SOURCES), 100), (yes("home_linked"), 80), (in_bar(), 60), (yes("positive_token"), 40)]
    return sum((F.when(cond, n).otherwise(0) for cond, n in points), F.lit(0))


def family_shape() -> Column:
    r = F.coalesce(content_ratio(), ratio())
    return F.when(r.isNull(), "unknown").when(r >= 1.8, "wide").when(r.between(0.72, 1.4), "square").otherwise("other")
