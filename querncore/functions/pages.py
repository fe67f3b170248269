"""URLs and pages: normal forms, scores, record grammars. ASCII patterns without look-around, the same in Spark and in SQL engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only pick a rendition of an asset.
DELIVERY_PARAMS = "w h width height size s dpr q quality fit resize format fm".split()


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[A-Za-z]+://([^/?#:]*)", 1))


def domain(url: Column) -> Column:
    return F.regexp_replace(host(url), "^www[.]", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z]+://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, "^[^?#]*[?]([^#]*)", 1)


def normalized(url: Column) -> Column:
    """Scheme added where there is none, host lowered, leading www. dropped; null unless http or https with a host that has a dot."""
    u = F.trim(url)
    u = F.when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), u).otherwise(F.concat(F.lit("https://"), u))
    ok = scheme(u).isin("http", "https") & domain(u).contains(".") & ~domain(u).rlike("^[0-9.]+$")
    return F.when(ok, F.concat(scheme(u), F.lit("://"), domain(u), F.when(path(u) == "", "/").otherwise(path(u))))


def segments(p: Column) -> Column:
    return F.filter(F.split(p, "/"), lambda s: s != "")


# Patterns of paths that hold brand assets, that inform the press, and classes of other pages and sitemaps.
STRONG_PAGE = "(^|[-_/])(brand(ing)?[-_/](asset|center|guideline|resource|toolkit)|press[-_/]kit|media[-_/]kit|logo[-_/](asset|download|file|kit)|visual[-_/]identity)s?($|[-_/])"
NEWSROOM_INFORMATION = "(^|[-_/])(newsroom|press|media)[-_/](information|resource|asset|download|about|contact)($|[-_/])"
OTHER_PAGE = "^(article|author|blog|careers?|jobs?|events?|legal|privacy|products?|customers?|partners?|support|store|shop|docs?|documentation|developers?|api)$"
NEGATIVE_SITEMAP = "(^|[-_/])(image|video|product|category|tag|author|event|job)s?([-_.]|$)"
POSITIVE_SITEMAP = "(^|[-_/])(page|newsroom|press|media|brand|corporate)s?([-_.]|$)"


def decoded_path(url: Column) -> Column:
    """The path, percent-decoded where that is possible, in lower case."""
    raw = path(url)
    return F.lower(F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw))


def page_url_score(url: Column, age_days: Column | None = None, max_age_days: float | None = None) -> Column:
    """How likely a page holds brand assets, by its path; and by how many days ago it changed, where that is known."""
    p = F.regexp_replace(decoded_path(url), "[.][a-z0-9]{1,8}$", "")
    seg = segments(p)
    n = F.size(seg)
    focused = F.exists(seg, lambda s: s.isin("brand", "branding", "logo", "logos"))
    guide = (n <= 4) & F.exists(seg, lambda s: s.rlike("^(brand[-_])?style[-_]guide$"))
    named = p.rlike(STRONG_PAGE)
    strong = named | focused | guide
    told = F.get(F.filter(seg, lambda s: s.isin("newsroom", "press", "media", "company", "about", "corporate")), F.lit(0))
    at = F.array_position(seg, told)
    news = F.when((at > 2) | (n - at > 0), 15).otherwise(80)
    weak = F.when(told.isNull(), 0).when(told.isin("newsroom", "press", "media"), news).otherwise(25)
    base = F.when(strong, 100 - F.when((n > 3) & ~focused, 30).otherwise(0)).when(p.rlike(NEWSROOM_INFORMATION), 80).otherwise(weak)
    other = F.exists(seg, lambda s: s.rlike(OTHER_PAGE)) & ~strong
    dated = p.rlike("/(19|20)[0-9][0-9]/(0?[1-9]|1[0-2])(/|$)") & ~named
    score = base - F.when(other, 45).otherwise(0) - F.when(dated, 30).otherwise(0) - F.when(query(url) != "", 5).otherwise(0)
    if age_days is not None:
        score = score + F.when(age_days <= 730, 5).otherwise(0)
        if max_age_days is not None:
            score = score - F.when(age_days > max_age_days, 20).otherwise(0)
    return score.cast("int")


def sitemap_priority(url: Column) -> Column:
    """The order in which the documents of a sitemap index are read."""
    p = decoded_path(url)
    return F.when(p.rlike(POSITIVE_SITEMAP), 50).otherwise(0) - F.when(p.rlike(NEGATIVE_SITEMAP), 80).otherwise(0) - F.when(p.endswith(".gz"), 1).otherwise(0)


def link_priority(semantic: Column, heading: Column | None = None) -> Column:
    """5 under a heading that says logo or logos alone, then by the words of the link."""
    s = F.lower(semantic)
    alone = F.lit(False) if heading is None else F.coalesce(F.lower(heading).rlike("^logos?$"), F.lit(False))
    return (
        F.when(alone, 5)
        .when(s.rlike("press[-_ ]*kit|media[-_ ]*kit|brand[-_ ]*(asset|toolkit)|logo"), 4)
        .when(s.rlike("press|media|brand|newsroom"), 3)
        .when(s.rlike("(^|[/_-])news($|[/?#_-])"), 2)
        .when(s.rlike("company|about"), 1)
        .otherwise(0)
    )


def family_url(url: Column) -> Column:
    """A URL without what only picks a rendition: fragment, delivery parameters, size suffixes, pixel-ratio suffixes."""
    names = "|".join(DELIVERY_PARAMS)
    plain = F.regexp_replace(url, "#.*$", "")
    base = F.regexp_replace(plain, "[?].*$", "")
    base = F.regexp_replace(base, "[_-][0-9]{2,4}x[0-9]{2,4}([.][A-Za-z0-9]+)$", "$1")
    base = F.regexp_replace(base, "@[23]x([.][A-Za-z0-9]+)$", "$1")
    kept = F.filter(F.split(query(plain), "&"), lambda q: (q != "") & ~F.lower(q).rlike(f"^({names})(=|$)"))
    return F.concat(base, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def robots_sitemaps(text: Column, most: int = 8) -> Column:
    """The first distinct Sitemap lines of a robots file, in order."""
    lines = F.transform(F.split(text, "\n"), lambda s: F.regexp_extract(s, "^[ \t]*[Ss][Ii][Tt][Ee][Mm][Aa][Pp][ \t]*:[ \t]*([^ \t\r#]+)", 1))
    return F.slice(F.array_distinct(F.filter(lines, lambda s: s != "")), 1, most)


def txt_record(raw: Column) -> Column:
    """Status of a tag=value assertion record, first rule that fails: malformed_record, duplicate_tag, version_not_first, not_bimi1,
    missing_logo_location, empty_logo_location, invalid_logo_url, unsafe_logo_url, or ok."""
    parts = F.filter(F.split(raw, ";"), lambda s: F.trim(s) != "")
    well = F.forall(parts, lambda s: s.rlike("^[ \t]*[A-Za-z][A-Za-z0-9_-]*[ \t]*="))
    keys = F.transform(parts, lambda s: F.lower(F.regexp_extract(s, "^[ \t]*([A-Za-z][A-Za-z0-9_-]*)", 1)))
    value = lambda k: F.trim(F.regexp_extract(F.get(F.filter(parts, lambda s: F.lower(F.regexp_extract(s, "^[ \t]*([A-Za-z][A-Za-z0-9_-]*)", 1)) == k), F.lit(0)), "=(.*)$", 1))
    logo = value("l")
    return (
        F.when(F.coalesce(raw, F.lit("")) == "", "malformed_record")
        .when(~well, "malformed_record")
        .when(F.size(F.array_distinct(keys)) < F.size(keys), "duplicate_tag")
        .when(~F.get(keys, F.lit(0)).eqNullSafe("v"), "version_not_first")
        .when(F.upper(value("v")) != "BIMI1", "not_bimi1")
        .when(~F.array_contains(keys, "l"), "missing_logo_location")
        .when(logo == "", "empty_logo_location")
        .when(~logo.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "invalid_logo_url")
        .when(~logo.rlike("^[Hh][Tt][Tt][Pp][Ss]://[^/@:?#]+([/?#]|$)"), "unsafe_logo_url")
        .otherwise("ok")
    )


def asset_literals(code: Column, most: int = 4) -> Column:
    """The first distinct quoted asset paths of a script."""
    found = F.regexp_extract_all(code, F.lit("[\"']([A-Za-z0-9_./-]+[.](svg|png|webp))[\"']"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(found, lambda s: F.lower(s).rlike("logo|brand|icon"))), 1, most)


def family_key(url: Column, shape: Column, own: Column) -> Column:
    """The renditions of one asset: its shape and its address without delivery parameters; candidates without a web address stand alone."""
    plain = family_url(F.regexp_replace(url, "/:/rs=[^/]+", ""))
    web = F.coalesce(scheme(url).isin("http", "https"), F.lit(False))
    return F.when(web, F.concat(shape, F.lit(":"), plain)).otherwise(F.concat(F.lit("unique:"), own.cast("string")))
