"""Replays over frozen candidates: named profiles change how candidates rank, and a replay runs only on the very rows it was made for.

Rows of a replay: entity, role, candidate, score (of the role), place (order among equals), and what the profiles read: source, favicon_rank, home_linked, dom_region, positive_token, agrees_with_company,
themes (array), width, height, url, source_url, generic_reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querncore.functions import pages
from querncore.functions.canonical import canonical

# The profiles' names; sources of favicons without any other standing; points.
PROFILES = ("stored", "favicon-tiny-v1", "icon-evidence-v1", "wide-theme-v1", "wide-header-recovery-v1")
FAVICON_FAMILY = ("manifest", "apple", "mask-icon", "ms-tile", "html-icon", "besticon", "google-favicon", "duckduckgo-favicon", "root-favicon")
UNSEEN, RECOVERED, THEME_SLACK = -10, 100, 4


def table_digest(df: DataFrame) -> str:
    """sha256 of a table's rows, whatever their order and their columns' order: of how many there are and of sums of their own digests. Equal for equal tables; a row that is
    changed, added, left out or repeated changes it. Values count by their canonical text (``functions.canonical``). One pass, summed in parts."""
    names = sorted(df.columns)
    row = F.sha2(F.concat_ws("\n", *(canonical(F.col(f"`{c}`"), df.schema[c].dataType) for c in names)), 256)
    part = lambda k: F.conv(F.substring(F.col("h"), 1 + 16 * k, 16), 16, 10).cast("decimal(38,0)")
    got = df.select(row.alias("h")).agg(F.count("*").alias("n"), *(F.sum(part(k)).cast("string").alias(f"s{k}") for k in range(4))).select(F.sha2(F.concat_ws(":", F.lit(",".join(names)), F.col("n").cast("string"), *(F.coalesce(f"s{k}", F.lit("0")) for k in range(4))), 256))
    return got.first()[0]


def recoverable() -> Column:
    """A wide mark of the page's own host in its header, that was left out as a foreign named logo."""
    ratio = F.when((F.col("width") > 0) & (F.col("height") > 0), F.col("width") / F.col("height"))
    here = pages.domain(F.col("url")) == pages.domain(F.col("source_url"))
    return F.coalesce(ratio.between(1.8, 12) & here & (pages.host(F.col("url")) != "") & F.col("positive_token") & F.col("dom_region").isin("header", "nav") & (F.col("generic_reason") == "foreign named logo"), F.lit(False))


def under(rows: DataFrame, profiles: list[str]) -> DataFrame:
    """rows with effective, and only those that may win under the profiles. rows: candidates in roles that they may take (predicted), or any in the role wide.

    favicon-tiny-v1: favicons by their rank; icon-evidence-v1: icons of favicon sources lose 10 points where nothing visible or named stands behind; wide-theme-v1: of wide marks within 4 points
    of the best those told for light and dark come first; wide-header-recovery-v1: recoverable marks may be wide again, and gain 100.
    """
    unknown = set(profiles) - set(PROFILES)
    if unknown:
        raise ValueError(f"no such profiles: {sorted(unknown)}")
    role, yes = F.col("role"), lambda n: F.coalesce(F.col(n), F.lit(False))
    score = F.coalesce("score", F.lit(0.0))
    gained = (role == "wide") & recoverable()
    score = score + F.when(gained, RECOVERED).otherwise(0)
    if "icon-evidence-v1" in profiles:
        seen = yes("home_linked") | (yes("positive_token") & F.coalesce(F.col("dom_region").isin("header", "nav"), F.lit(False)))
        score = score + F.when((role == "icon") & F.col("source").isin(*FAVICON_FAMILY) & ~seen & ~yes("agrees_with_company"), UNSEEN).otherwise(0)
    if "favicon-tiny-v1" in profiles:
        score = F.when(role == "favicon", F.coalesce("favicon_rank", F.lit(0.0))).otherwise(score)
    may = yes("predicted") | gained if "wide-header-recovery-v1" in profiles else yes("predicted")
    return rows.filter(may).withColumn("effective", score)


def winners(rows: DataFrame, profiles: list[str]) -> DataFrame:
    """entity, role, candidate, effective: the best of each entity and role under the profiles; ties end at the smaller place. One aggregate, in parts; for wide-theme-v1
    another before it, for the best score."""
    rows = under(rows, profiles)
    both = F.lit(0)
    if "wide-theme-v1" in profiles:
        top = rows.filter("role = 'wide'").groupBy(F.col("entity").alias("_e")).agg(F.max("effective").alias("_top"))
        rows = rows.join(top, F.col("entity").eqNullSafe(F.col("_e")), "left")
        themed = F.array_contains("themes", "light") & F.array_contains("themes", "dark")
        both = F.when((F.col("role") == "wide") & (F.col("effective") >= F.col("_top") - THEME_SLACK), F.when(F.coalesce(themed, F.lit(False)), -2).otherwise(-1)).otherwise(0)
    order = F.struct(both.alias("a"), (-F.col("effective")).alias("b"), F.col("place").alias("c"))
    return rows.withColumn("_order", order).groupBy("entity", "role").agg(F.min_by(F.struct("candidate", "effective"), "_order").alias("_w")).select("entity", "role", "_w.*")


def frozen_rerank(rows: DataFrame, profiles: list[str], before: DataFrame, expected: dict[str, str], ranking_version: int) -> tuple[DataFrame, dict]:
    """The winners under the profiles and the replay's record: digests of what went in and came out, version, profiles, results, and slots that changed, by role.

    before: entity, role, candidate of the run that was frozen. expected: digests by name (candidates, selections); if either differs from the table's, nothing is replayed and
    ValueError says which.
    """
    inputs = {"candidates": table_digest(rows), "selections": table_digest(before)}
    wrong = sorted(n for n, d in inputs.items() if expected.get(n) != d)
    if wrong:
        raise ValueError(f"not the frozen rows: {', '.join(wrong)}")
    after = winners(rows, profiles)
    changed = {r.role: r.n for r in changes(before, after).groupBy("role").agg(F.count("*").alias("n")).collect()}  # a row for each role
    record = {"inputs": inputs, "output": table_digest(after), "ranking_version": ranking_version, "profiles": sorted(profiles), "result_count": after.count(), "changed_selected_slots_by_role": changed, "changed_selected_slots": sum(changed.values())}
    return after, record


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """entity, role, was, now: slots whose candidate is another one, or is there in one of the two alone."""
    a = before.select(F.col("entity").alias("_e"), F.col("role").alias("_r"), F.col("candidate").alias("was"))
    both = after.select("entity", "role", F.col("candidate").alias("now")).join(a, F.col("entity").eqNullSafe(F.col("_e")) & F.col("role").eqNullSafe(F.col("_r")), "full_outer")
    return both.filter(~F.col("was").eqNullSafe(F.col("now"))).select(F.coalesce("entity", "_e").alias("entity"), F.coalesce("role", "_r").alias("role"), "was", "now")


def veto_profile(rows: DataFrame, profiles: dict[str, list[tuple[str, Column]]], name: str) -> tuple[DataFrame, DataFrame]:
    """rows that no rule of the named profile leaves out, and the exclusions with all their reasons. A rule: reason and condition; a null condition does not hold."""
    if name not in profiles:
        raise ValueError(f"no such profile: {name}")
    reasons = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(r)) for r, c in profiles[name]))) if profiles[name] else F.array().cast("array<string>")
    told = rows.withColumn("reasons", reasons)
    return told.filter(F.size("reasons") == 0).drop("reasons"), told.filter(F.size("reasons") > 0)
