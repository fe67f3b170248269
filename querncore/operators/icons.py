"""The icon of an entity: the best candidate, looked at once more against what the page declares, its rendered twin, and what else speaks for it.

Columns of candidates: entity, id (unique in its entity), url, resolved_url, source, score (overall), bytes, width, height, role_scores, predicted_roles, effective (``scoring.icon_effective``),
padded_wordmark, points (of the preference), usable (no rejections under the preference, and eligible where it is strict), rejected (icon quality rejections), home_linked, dom_region,
positive_token, agrees_with_company, exact_company_label, generic_reason, manifest_agrees, family, favicon_rank, bimi_shape_ok.

All is counted and compared by entity in parts, and the few chosen rows meet in joins by entity, so an entity with most candidates is no single task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querncore.functions import pages, scoring
from querncore.functions.capture import percent_decoded
from querncore.functions.columns import settled

# Sources of icons that a page declares, of images in pages; scores and sides.
DECLARED = ("manifest", "apple", "mask-icon", "ms-tile", "html-icon", "google-favicon", "duckduckgo-favicon", "root-favicon")
PAGE_IMAGES = ("dom-img", "dom-picture", "browser-img")
DECLARED_LEAST, TWIN_SLACK, LEAST_EDGE = 49, 5, 14


def yes(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def near(a: Column, b: Column) -> Column:
    """Sides that differ by 4 or by 12 % of the larger at most; missing ones count as 0."""
    x, y = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
    return F.abs(x - y) <= F.greatest(F.lit(4.0), 0.12 * F.greatest(x, y))


def application_icon() -> Column:
    """A file named after an application's icon in general."""
    path = F.coalesce(percent_decoded(pages.path(F.coalesce("resolved_url", "url"))), F.lit(""))
    return F.element_at(F.split(path, "/"), -1).rlike("(?i)^(?:app|application)[-_]?(?:ico|icon)(?:[-_.]|$)")


def flagged(df: DataFrame) -> DataFrame:
    """Candidates with what the decision asks of each."""
    role = lambda r: F.coalesce(F.array_contains("predicted_roles", r), F.lit(False))
    mine = yes("positive_token") | yes("agrees_with_company") | yes("exact_company_label")
    df = df.withColumns(
        {
            "_icon": role("icon") & yes("usable") & (F.col("source") != "social-banner"),
            "_corporate": yes("home_linked") | yes("exact_company_label") | F.col("source").isin("schema", "og-logo", "microdata"),
            "_mark": F.col("source").isin(*PAGE_IMAGES) & F.coalesce(F.col("dom_region").isin("header", "nav"), F.lit(False)) & mine,
            "_named": yes("exact_company_label") | yes("agrees_with_company") | yes("manifest_agrees"),
            "_predicted": role("icon"),
            "_favicon": role("favicon") & yes("usable") & (F.col("source") != "social-banner") & F.coalesce(F.col("bimi_shape_ok"), F.lit(True)) & (scoring.edge() >= LEAST_EDGE),
            "_app": F.col("source").isin(*DECLARED) & ~yes("home_linked") & application_icon() & ~yes("exact_company_label"),
        }
    )
    df = df.withColumns({"_support": F.col("_predicted") & (F.size(F.coalesce("rejected", F.array().cast("array<string>"))) == 0) & (F.col("_corporate") | F.col("_mark"))})
    # of rows that compare alike the one that stands first among all candidates
    overall = [-F.col("score"), -F.col("bytes"), F.col("id")]
    best = F.struct(F.coalesce("padded_wordmark", F.lit(False)).alias("a"), (-F.col("points")).alias("b"), (-F.col("effective")).alias("c"), (-F.col("bytes")).alias("d"), *(x.alias(f"e{i}") for i, x in enumerate(overall)))
    tiny = F.struct((-F.col("favicon_rank")).alias("a"), (-F.col("bytes")).alias("b"), *(x.alias(f"e{i}") for i, x in enumerate(overall)))
    place = F.struct(*(x.alias(f"e{i}") for i, x in enumerate(overall)))
    row = F.struct("id", "source", "width", "height", "effective", "family", "_corporate", "_mark", "_named", "_support", "_app", "_predicted", yes("home_linked").alias("_home"))
    return settled(df.withColumns({"_best": best, "_tiny": tiny, "_place": place, "_row": row}))


def pick_icons(candidates: DataFrame) -> DataFrame:
    """A row for each entity: winner (an id, or null), action, reason, and other, the id that was passed over.

    action: ranked; declared-icon-displaced-page-mark, where the best is an unlinked image of the page and a declared icon scores enough, unless the image is a
    first-party mark that nothing of the declared one answers (declared-icon-abstained); rendered-twin-selected, for an inline drawing whose first rendered twin of
    near size scores hardly less; icon-abstained, for an application's icon that nothing corporate stands behind; favicon-fallback-selected; none.
    Null flags are no; ties end at the smaller id; an empty table gives no rows.
    """
    rows = flagged(candidates)
    first = lambda cond, order: F.min_by(F.when(cond, F.col("_row")), F.when(cond, F.col(order)))
    declared = F.col("_icon") & F.col("source").isin(*DECLARED) & (F.col("role_scores")["icon"] >= DECLARED_LEAST)
    by = rows.groupBy("entity").agg(first(F.col("_icon"), "_best").alias("w"), first(declared, "_best").alias("d"), first(F.col("_favicon"), "_tiny").alias("f"), F.count_if(F.col("_predicted") & F.col("_corporate")).alias("_corporate_icons"))
    families = rows.groupBy("entity", "family").agg(F.count_if("_support").alias("_supports"), F.count_if("_corporate").alias("_corporates"), F.count_if(F.col("_predicted") & F.col("_corporate")).alias("_own_icons"))

    def beside(df: DataFrame, of: str) -> DataFrame:
        """df with what is known of the family of the row in column ``of``."""
        known = families.withColumnsRenamed({"entity": "_e", "family": "_f"})
        return df.join(known, (F.col("entity") == F.col("_e")) & F.col(of)["family"].eqNullSafe(F.col("_f")), "left").drop("_e", "_f")

    c = F.col
    by = beside(by, "d")
    answered = c("d")["_named"] | (F.coalesce("_supports", F.lit(0)) - c("d")["_support"].cast("int") > 0)
    weak = c("w")["source"].isin(*PAGE_IMAGES) & ~c("w")["_home"] & c("d").isNotNull()
    moved = weak & (~c("w")["_mark"] | answered)
    by = by.withColumns({"v": F.when(moved, c("d")).otherwise(c("w")), "act": F.when(moved, "declared-icon-displaced-page-mark").when(weak, "declared-icon-abstained").when(c("w").isNotNull(), "ranked").otherwise("none")})
    why = F.when(c("act") == "declared-icon-displaced-page-mark", F.when(c("w")["_mark"], "declared-icon-corroborated").otherwise("page-mark-not-corroborated")).when(c("act") == "declared-icon-abstained", "declared-icon-lacks-corroboration").when(c("act") == "ranked", "highest-effective-score")
    other = F.when(c("act") == "declared-icon-displaced-page-mark", c("w")["id"]).when(c("act") == "declared-icon-abstained", c("d")["id"])
    by = settled(by.select("entity", "v", "f", "act", "_corporate_icons", why.alias("why"), other.alias("other")))

    drawn = by.filter(c("v")["source"] == "inline-svg").select(c("entity").alias("_e"), c("v")["width"].alias("_w"), c("v")["height"].alias("_h"))
    twins = rows.filter((c("source") == "browser-inline-svg") & c("_predicted") & yes("usable") & c("generic_reason").isNull())
    twins = twins.join(drawn, (c("entity") == c("_e")) & near(c("width"), c("_w")) & near(c("height"), c("_h")))
    twins = twins.groupBy(c("_e")).agg(F.min_by("_row", "_place").alias("t"))  # the first of them alone
    by = by.join(twins, c("entity") == c("_e"), "left").drop("_e")
    turned = F.coalesce(c("t")["effective"] >= c("v")["effective"] - TWIN_SLACK, F.lit(False))
    by = by.withColumn("x", F.when(turned, c("t")).otherwise(c("v"))).withColumns({"act": F.when(turned, "rendered-twin-selected").otherwise(c("act")), "why": F.when(turned, "rendered-inline-svg-corroboration").otherwise(c("why")), "other": F.when(turned, c("v")["id"]).otherwise(c("other"))})

    by = beside(by, "x")
    own = F.coalesce("_corporates", F.lit(0)) - c("x")["_corporate"].cast("int")
    elsewhere = c("_corporate_icons") - F.coalesce("_own_icons", F.lit(0))
    alone = F.coalesce(c("x")["_app"] & (own == 0) & (elsewhere == 0), F.lit(False))
    fall = c("x").isNull() & c("f").isNotNull()
    return by.select(
        "entity",
        F.when(alone, F.lit(None)).when(fall, c("f")["id"]).otherwise(c("x")["id"]).alias("winner"),
        F.when(alone, "icon-abstained").when(fall, "favicon-fallback-selected").otherwise(c("act")).alias("action"),
        F.when(alone, "uncorroborated-generic-application-icon").when(fall, "no-qualified-icon").otherwise(c("why")).alias("reason"),
        F.when(alone, c("x")["id"]).otherwise(c("other")).alias("other"),
    )
