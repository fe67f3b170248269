"""What a candidate's own texts say about whose mark it is, as Column expressions.

Columns of a candidate that they read: source, url, resolved_url, source_page, company (asked for), stated_company (found with the candidate), site_label (first
label of the page's registrable domain), alt, aria_label, semantic_text, local_semantic, class_tokens (array), dom_region, home_linked, positive_token,
archive_score, deep_official, sitemap_official_page, sitemap_exact_identity, spa_bundle_entry, same_origin, strong_logo_filename, spa_identity_agreement,
wikidata_identity_verified. Nulls say nothing. The expressions are for tables that ``prepared`` has been through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querncore.functions import pages
from querncore.functions.capture import percent_decoded

# What a company's name has besides its name, and sources that speak for the site itself.
LEGAL_SUFFIXES = ("inc", "llc", "ltd", "corp", "corporation", "company", "co")
SELF_DESCRIBED = ("schema", "og-logo", "microdata")


def txt(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def sure(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def words(text: Column) -> Column:
    """Runs of a-z and 0-9 of the text in lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def joined(*names: str) -> Column:
    """Texts beside each other, a space between two even where one is missing."""
    return reduce(lambda a, b: F.concat(a, F.lit(" "), b), map(txt, names))


def asset_url() -> Column:
    return F.coalesce("resolved_url", "url", F.lit(""))


def file_path(url: Column) -> Column:
    """The decoded path; empty where the URL has none or a percent sign starts no byte."""
    return F.coalesce(percent_decoded(pages.path(url)), F.lit(""))


def without_legal(found: Column) -> Column:
    return F.filter(found, lambda w: ~w.isin(*LEGAL_SUFFIXES))


FOREIGN_CONTEXT = r"(?i)(?:carousel|customer|partner|investor|sponsor|backed(?:[-_\s]*by)?|testimonial|card[-_\s]|dropdown|menuitem|listitem|product|subbrand)"
LABEL = r"(?i)^\s*(.+?)\s+(?:company\s+)?(?:logo|wordmark|brandmark|logomark)\s*$"


def prepared(df: DataFrame) -> DataFrame:
    """df with what the rules share, worked out once a row, in columns of the prefix _ev_ (which ``finished`` drops):

    asked, words of the company asked for, else of the one stated; named, these without legal suffixes; own, these and the page's host; structure, semantic, told, texts;
    url, path, own_path; subject, words of X where the labels read "X logo" or "X company wordmark"; agrees, exact.
    """
    c = lambda n: F.col("_ev_" + n)
    requested = F.coalesce(F.nullif("company", F.lit("")), F.nullif("stated_company", F.lit("")), F.lit(""))
    df = df.withColumns(
        {
            "_ev_requested": F.lower(requested),
            "_ev_labels": joined("alt", "aria_label"),
            "_ev_structure": F.lower(F.concat(txt("semantic_text"), F.lit(" "), F.coalesce(F.array_join("class_tokens", " "), F.lit("")))),
            "_ev_semantic": F.lower(joined("semantic_text", "alt", "aria_label")),
            "_ev_url": F.lower(asset_url()),
            "_ev_path": file_path(asset_url()),
            "_ev_own_path": file_path(F.col("url")),
            "_ev_host": pages.host(txt("source_page")),
        }
    )
    left = F.regexp_replace(c("requested"), r"\b(" + "|".join(LEGAL_SUFFIXES) + r")\b\.?", " ")
    df = df.withColumns(
        {
            "_ev_asked": words(c("requested")),
            "_ev_tokens": F.filter(words(left), lambda w: F.length(w) >= 3),
            "_ev_told": F.concat(c("semantic"), F.lit(" "), c("url")),
            "_ev_subject": F.filter(words(F.regexp_extract(F.trim(c("labels")), LABEL, 1)), lambda w: ~w.isin("the", "official")),
            "_ev_hay": F.lower(F.concat(c("own_path"), F.lit(" "), c("labels"))),
        }
    )
    df = df.withColumns({"_ev_named": without_legal(c("asked")), "_ev_own": F.array_union(c("asked"), words(c("host"))), "_ev_agrees": F.exists(c("tokens"), lambda w: F.contains(c("hay"), w))})
    return df.withColumn("_ev_exact", (F.size(c("named")) > 0) & (c("subject") == c("named")))


def finished(df: DataFrame) -> DataFrame:
    return df.drop(*(n for n in df.columns if n.startswith("_ev_")))


def agrees_with_company() -> Column:
    """A word of the company's name, of three letters at least, stands anywhere in the file's path or in its labels."""
    return F.col("_ev_agrees")


def exact_company_label() -> Column:
    """The labels name the company and nothing else."""
    return F.col("_ev_exact")


def names_foreign_organization() -> Column:
    """The labels name a subject that shares no word's beginning with the company, in a place where others are named, or as the home link. The company is
    the one asked for, else the stated one, else the site's own label."""
    subject = F.col("_ev_subject")
    asked = F.when(F.col("_ev_requested") != "", F.col("_ev_named")).otherwise(without_legal(words(F.col("site_label"))))
    kin = F.exists(subject, lambda w: F.exists(asked, lambda c: (F.length(w) >= 3) & (F.length(c) >= 3) & (w.startswith(c) | c.startswith(w))))
    return (F.size(subject) > 0) & (yes("home_linked") | F.col("_ev_structure").rlike(FOREIGN_CONTEXT)) & (F.size(asked) > 0) & ~kin


def in_bar() -> Column:
    return sure(F.col("dom_region").isin("header", "nav"))


def same_site() -> Column:
    """Asset and page have one host, but for www."""
    a, p = pages.domain(asset_url()), F.regexp_replace("_ev_host", "^www[.]", "")
    return (a != "") & (a == p)


def first_party_placed_path() -> Column:
    named = F.lower("_ev_path").rlike(r"(?:^|[/_.-])(?:logo|brand|wordmark)(?:[/_.-]|$)")
    return sure(F.col("source") == "browser-img") & in_bar() & same_site() & named


def wide_evidence() -> Column:
    """Whether anything ties a wide mark to the company: who describes it, what it is called, where it stands, or how it was found."""
    site = txt("site_label")
    spoken = F.array_join(words(F.col("aria_label")), " ")
    wordmark = (site != "") & txt("local_semantic").rlike("(?i)wordmark") & reduce(lambda a, b: a | b, (spoken == F.concat(site, F.lit(x)) for x in ("", " home", " logo", " wordmark")))
    agrees = agrees_with_company()
    terms = [
        sure(F.col("source").isin(*SELF_DESCRIBED)),
        sure(F.col("source") == "wikimedia-commons") & yes("wikidata_identity_verified"),
        agrees,
        yes("home_linked") | (yes("positive_token") & in_bar()),
        wordmark,
        first_party_placed_path(),
        yes("deep_official") & (sure(F.col("archive_score") >= 40) | agrees),
        yes("sitemap_official_page") & yes("sitemap_exact_identity"),
        sure(F.col("source") == "spa-bundle") & yes("spa_bundle_entry") & yes("same_origin") & yes("strong_logo_filename") & yes("spa_identity_agreement"),
    ]
    return reduce(lambda a, b: a | b, terms)
