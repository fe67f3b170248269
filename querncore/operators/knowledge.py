"""A lookup of marks in landed tables of a knowledge base: from a domain, over search hits, entities and their claims, to one file; or the reason why none is told.

Tables (columns that are read):

* asked: domain (registrable), roles array
* hits: domain, entity, place; of a search by name, in order
* site_hits: domain, entity; of the search by website, which counts only for domains that no entity found by name has as its website
* site_searches: domain, truncated
* claims: entity, property (website or logo), statement, rank, value, start_time, start_precision, end_time, end_precision, point_in_time, end_cause
* files: title, redirect_to, url, description_url, width, height, license_name, license_url, usage_terms
* suffixes: rule (see ``functions.domains``)

Each step is a join or a count by key over all domains at once; where more than one answer is left, or a search was cut off, the lookup abstains and says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from querncore.functions import capture, domains, pages

WEBSITE, LOGO = "P856", "P154"
CORPORATE = ("corporate", "company", "about")


def current(claims: DataFrame, now: Column) -> DataFrame:
    """Claims that hold at a date: of an entity's and property's current ones the preferred, else the normal ones."""
    interval = lambda side: capture.precision_interval(F.col(f"{side}_time"), F.col(f"{side}_precision"))
    rows = claims.withColumns({"_start": interval("start"), "_end": interval("end")})
    told = capture.claim_disposition(F.col("rank"), F.col("value"), F.coalesce("end_cause", F.lit(False)), F.col("_start"), F.col("_end"), F.col("start_time").isNotNull(), F.col("end_time").isNotNull(), F.coalesce("point_in_time", F.lit(False)), now)
    rows = rows.filter(told == "current").drop("_start", "_end")
    best = rows.groupBy("entity", "property").agg(F.bool_or(F.col("rank") == "preferred").alias("_preferred"))
    return rows.join(best, ["entity", "property"]).filter(F.col("rank") == F.when(F.col("_preferred"), "preferred").otherwise("normal")).drop("_preferred")


def language_codes(spark: SparkSession) -> list[str]:
    """Two-letter codes of ISO 639, as the Java platform lists them."""
    return sorted(c for c in spark._jvm.java.util.Locale.getISOLanguages() if len(c) == 2)


def websites(claims: DataFrame, suffixes: DataFrame, languages: list[str] | None = None) -> DataFrame:
    """entity, domain: entities whose current website claim is the domain's own front: its bare host, www, a corporate or a language host, and its root, a
    language, a corporate or a default page. Products share their owner's domain; their paths and hosts tell nothing of the owner. Needs ``current`` claims."""
    codes = languages or language_codes(claims.sparkSession)
    rows = claims.filter((F.col("property") == WEBSITE) & F.col("value").rlike(r"^(?i)https?://[^/@\s]+([/?#]|$)")).select("entity", "value")
    rows = domains.with_registrable(rows, "value", suffixes, out="domain").filter("domain IS NOT NULL")
    host = domains.clean_host(pages.host(F.col("value")))
    under = F.when(host == F.col("domain"), "").otherwise(F.expr("substring(_host, 1, length(_host) - length(domain) - 1)"))
    rows = rows.withColumn("_host", host).withColumn("_under", under).withColumn("_path", pages.segments(pages.path(F.col("value"))))
    tag = lambda c: F.lower(c).rlike("^[a-z]{2}(-[a-z]{2})?$") & F.substring(F.lower(c), 1, 2).isin(codes)
    page = F.get("_path", F.lit(0))
    front = F.col("_under").isin("", "www", *CORPORATE) | tag(F.col("_under"))
    landing = (F.size("_path") == 0) | ((F.size("_path") == 1) & (tag(page) | F.lower(page).isin("about-us", *CORPORATE) | F.lower(page).rlike(r"^(index|default)\.[a-z0-9]{1,5}$")))
    return rows.filter(front & landing & ~F.col("value").rlike("[?#].")).select("entity", "domain").distinct()


def title_key(c: Column) -> Column:
    return F.lower(F.trim(F.replace(F.regexp_replace(F.trim(c), "^(?i)File:", ""), F.lit("_"), F.lit(" "))))


def logos(claims: DataFrame) -> DataFrame:
    """entity, n_files, file (the smallest key), statements, rank: an entity's current logo claims. Needs ``current`` claims."""
    rows = claims.filter((F.col("property") == LOGO) & (F.trim("value") != "")).withColumn("file", title_key(F.col("value")))
    by = rows.groupBy("entity", "file").agg(F.array_sort(F.collect_set("statement")).alias("statements"), F.min("rank").alias("rank"))  # the statements of one file
    return by.groupBy("entity").agg(F.count("*").alias("n_files"), F.min(F.struct("file", "statements", "rank")).alias("_one")).select("entity", "n_files", "_one.*")


def resolved_files(files: DataFrame) -> DataFrame:
    """A row for each title and each redirect: key, and the file that it leads to (null where there is none)."""
    keyed = files.withColumns({"key": title_key(F.col("title")), "to": title_key(F.col("redirect_to"))})
    held = ["url", "description_url", "width", "height", "license_name", "license_url", "usage_terms"]
    real = keyed.filter("redirect_to IS NULL").groupBy("key").agg(F.min(F.struct(*held)).alias("info"))
    moved = keyed.filter("redirect_to IS NOT NULL").groupBy("key").agg(F.min("to").alias("to")).join(real.withColumnRenamed("key", "to"), "to", "left").select("key", "info")
    return moved.unionByName(real.join(moved.select("key"), "key", "left_anti"))


def lookup(asked: DataFrame, hits: DataFrame, site_hits: DataFrame, site_searches: DataFrame, claims: DataFrame, files: DataFrame, suffixes: DataFrame, now: Column, most: int = 20, languages: list[str] | None = None) -> DataFrame:
    """A row for each domain asked for: domain, status, reason, entity, file, statements, url, eligible_roles.

    status: no_search_candidates; search_candidates_truncated; ambiguous_entities; no_verified_current_logo (no_domain_match, no_current_logo_claim);
    ambiguous_logo_claims; unsafe_or_missing_file (missing_page, unsafe_url, insufficient_license, incompatible_role); or ok, which alone has a url.
    By name, only the first ``most`` entities count; with one match among more hits than that, a rival may be hidden, so nothing is told. Domains that
    repeat count once; null domains are left out.
    """
    held = current(claims, now)
    fronts = websites(held, suffixes, languages)
    asked = asked.filter("domain IS NOT NULL").groupBy("domain").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("roles")))).alias("roles"))
    named = hits.join(asked.select("domain"), "domain", "left_semi").groupBy("domain", "entity").agg(F.min("place").alias("place"))
    named = named.withColumn("_n", F.row_number().over(Window.partitionBy("domain").orderBy("place", "entity")))  # a domain's hits: what one search gave
    found = named.groupBy("domain").agg(F.count("*").alias("n_named"))
    near = named.filter(F.col("_n") <= most).select("domain", "entity")
    matched = near.join(fronts, ["domain", "entity"]).groupBy("domain").agg(F.count("*").alias("n1"), F.min("entity").alias("e1"))
    open_ = asked.select("domain").join(matched, "domain", "left_anti")
    wide = site_hits.select("domain", "entity").distinct().join(open_, "domain", "left_semi")
    n_wide = wide.groupBy("domain").agg(F.count("*").alias("n_wide"))
    late = wide.join(fronts, ["domain", "entity"]).groupBy("domain").agg(F.count("*").alias("n2"), F.min("entity").alias("e2"))
    cut = site_searches.groupBy("domain").agg(F.bool_or("truncated").alias("cut"))
    d = asked
    for side in (found, matched, n_wide, late, cut):
        d = d.join(side, "domain", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    n = F.coalesce("n1", "n2", F.lit(0))
    d = d.select("domain", "roles", zero(F.col("n_named")).alias("n_named"), zero(F.col("n_wide")).alias("n_wide"), n.alias("n"), F.when(n == 1, F.coalesce("e1", "e2")).alias("entity"), (F.col("n1").isNull() & F.coalesce("cut", F.lit(False))).alias("cut"))
    d = d.join(logos(held), "entity", "left").join(resolved_files(files).withColumnRenamed("key", "file"), "file", "left")
    ratio = F.try_divide(F.col("info.width").cast("double"), F.col("info.height").cast("double"))
    roles = F.filter("roles", lambda r: r.isin("icon", "wide") & ((r != "icon") | ratio.isNull() | ratio.between(0.72, 1.4)))
    safe = F.coalesce(F.col("info.url").rlike("^https://upload[.]wikimedia[.]org/wikipedia/commons/") & F.col("info.description_url").rlike("^https://commons[.]wikimedia[.]org/wiki/File:"), F.lit(False))
    free = F.coalesce((F.col("info.license_name") != "") & (F.coalesce("info.license_url", "info.usage_terms", F.lit("")) != ""), F.lit(False))
    against = F.when(F.col("info").isNull(), "missing_page").when(~safe, "unsafe_url").when(~free, "insufficient_license").when(F.size(roles) == 0, "incompatible_role")
    files_n = zero(F.col("n_files"))
    status = (
        F.when(F.col("cut"), "search_candidates_truncated")
        .when(F.col("n_named") + F.col("n_wide") == 0, "no_search_candidates")
        .when((F.col("n_named") > most) & (F.col("n") == 1), "search_candidates_truncated")
        .when(F.col("n") > 1, "ambiguous_entities")
        .when(F.col("n") == 0, "no_verified_current_logo")
        .when(files_n > 1, "ambiguous_logo_claims")
        .when(files_n == 0, "no_verified_current_logo")
        .when(against.isNotNull(), "unsafe_or_missing_file")
        .otherwise("ok")
    )
    d = d.withColumn("status", status)
    is_ = lambda s: F.col("status") == s
    reason = F.when(is_("ambiguous_entities"), "multiple_domain_matches").when(is_("no_verified_current_logo"), F.when(F.col("n") == 0, "no_domain_match").otherwise("no_current_logo_claim")).when(is_("unsafe_or_missing_file"), against)
    ok, chosen = is_("ok"), F.col("status").isin("ok", "unsafe_or_missing_file")
    return d.select("domain", "status", reason.alias("reason"), F.when(chosen, F.col("entity")).alias("entity"), F.when(chosen, F.col("file")).alias("file"), F.when(chosen, F.col("statements")).alias("statements"), F.when(ok, F.col("info.url")).alias("url"), F.when(ok, roles).alias("eligible_roles"))
